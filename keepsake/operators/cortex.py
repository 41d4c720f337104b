"""Rollups: statistics of an archive and the map of documents, concepts and domains."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decay
from ..functions.numbers import r4, ratio
from ..functions.text import content_domain
from . import graph, lifecycle


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def storage(documents: DataFrame) -> DataFrame:
    """Per tenant: documents, bytes of content, megabytes in two decimals."""
    size = F.sum(F.octet_length("content")).cast("long")
    return documents.groupBy("user_id").agg(F.count(F.lit(1)).alias("documents"), size.alias("bytes"), (F.floor(size / 1048576.0 * 100 + 0.5).cast("double") / 100).alias("megabytes"))


def knowledge_state(buckets: DataFrame, documents: DataFrame, edges: DataFrame) -> DataFrame:
    """Per tenant: memories, documents, edges, and whether there is anything to ask."""
    b = buckets.groupBy("user_id").agg(F.count(F.lit(1)).alias("memories"))
    d = documents.groupBy("user_id").agg(F.count(F.lit(1)).alias("documents"))
    e = edges.join(buckets.select(F.col("bucket_id").alias("source_bucket_id"), "user_id"), "source_bucket_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("edges"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return b.join(d, "user_id", "full").join(e, "user_id", "left").select("user_id", zero("memories"), zero("documents"), zero("edges"), (F.coalesce("memories", F.lit(0)) + F.coalesce("documents", F.lit(0)) > 0).alias("has_knowledge"))


def documents_with_counts(documents: DataFrame, buckets: DataFrame) -> DataFrame:
    n = buckets.groupBy("document_id").agg(F.count(F.lit(1)).alias("memory_count"))
    return documents.select("document_id", "user_id", "filename").join(n, "document_id", "left").withColumn("memory_count", F.coalesce("memory_count", F.lit(0)).cast("long"))


def top_concepts(buckets: DataFrame, most: int = 3) -> DataFrame:
    """The first concepts of each document by importance, strength and id."""
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("importance"), F.desc("strength"), "bucket_id"))
    return buckets.filter(F.col("document_id").isNotNull()).withColumn("n", rank).filter(F.col("n") <= most)


def archive(documents: DataFrame, buckets: DataFrame) -> DataFrame:
    """Documents with their number of memories and the names of their first concepts."""
    names = top_concepts(buckets).groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "canonical"))), lambda x: x["canonical"]), "; ").alias("top_concepts"))
    return documents_with_counts(documents, buckets).join(names, "document_id", "left").withColumn("top_concepts", F.coalesce("top_concepts", F.lit("")))


def high_importance(buckets: DataFrame, per_document: int = 4) -> DataFrame:
    """The first memories of each document, those without one counting as one."""
    group = F.coalesce(F.col("document_id").cast("string"), F.lit("none"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("importance"), F.desc("strength"), F.desc("last_accessed"), "bucket_id"))
    return buckets.withColumn("n", rank).filter(F.col("n") <= per_document).select("bucket_id", "document_id", "importance", "strength", "n")


def shared_concepts(edges: DataFrame, buckets: DataFrame) -> DataFrame:
    """Unordered pairs of documents with an edge between their concepts, and the number of distinct source concepts."""
    end = lambda side: buckets.select(F.col("bucket_id").alias(f"{side}_bucket_id"), F.col("document_id").alias(f"{side}_doc"))
    rows = edges.join(end("source"), "source_bucket_id").join(end("target"), "target_bucket_id").filter("source_doc is not null and target_doc is not null and source_doc <> target_doc")
    return rows.groupBy(F.least("source_doc", "target_doc").alias("document_a"), F.greatest("source_doc", "target_doc").alias("document_b")).agg(F.count_distinct("source_bucket_id").alias("shared"))


def document_nodes(documents: DataFrame, buckets: DataFrame, edges: DataFrame) -> DataFrame:
    """A row per document: concepts, mean strength, critical, connected and isolated ones, first concepts, related documents, whether it stands alone."""
    concepts = buckets.join(graph.degrees(edges, buckets), "bucket_id").filter(F.col("document_id").isNotNull())
    rolled = concepts.groupBy("document_id").agg(F.count(F.lit(1)).alias("concepts"), F.avg("strength").alias("average_strength"), F.count_if(decay.category(F.col("strength")) == "critical").alias("critical"), F.count_if(F.col("degree") > 0).alias("connected"), F.count_if(F.col("degree") == 0).alias("isolated"))
    score = F.col("importance") * 10 + F.col("strength")
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc(score), "bucket_id"))
    top = buckets.filter(F.col("document_id").isNotNull()).withColumn("n", rank).filter("n <= 3").groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "canonical"))), lambda x: x["canonical"]), "; ").alias("top_concepts"))
    pairs = shared_concepts(edges, buckets)
    near = pairs.select(F.col("document_a").alias("document_id")).unionByName(pairs.select(F.col("document_b").alias("document_id"))).groupBy("document_id").agg(F.count(F.lit(1)).alias("related"))
    out = documents.select("document_id", "filename").join(rolled, "document_id", "left").join(top, "document_id", "left").join(near, "document_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("document_id", "filename", zero("concepts"), F.coalesce("average_strength", F.lit(0.0)).alias("average_strength"), zero("critical"), zero("connected"), zero("isolated"), F.coalesce("top_concepts", F.lit("")).alias("top_concepts"), zero("related"), F.col("related").isNull().alias("solo"))


def domains(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """Documents by domain: concepts, strength averaged by concepts, critical ones."""
    rows = nodes.join(documents.select("document_id", content_domain(F.col("content"), F.col("filename")).alias("domain")), "document_id")
    n = F.sum("concepts")
    return rows.groupBy("domain").agg(F.count(F.lit(1)).alias("documents"), n.alias("concepts"), F.when(n > 0, F.sum(F.col("average_strength") * F.col("concepts")) / n).otherwise(0.0).alias("average_strength"), F.sum("critical").alias("critical"))


def core(nodes: DataFrame, buckets: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for the whole map."""
    a = nodes.agg(F.count(F.lit(1)).alias("documents"), F.count_if("solo").alias("solo_documents"))
    b = buckets.agg(F.count(F.lit(1)).alias("concepts"), F.coalesce(F.avg("strength"), F.lit(0.0)).alias("average_strength"), F.count_if(decay.category(F.col("strength")) == "critical").alias("critical"))
    return a.crossJoin(b).crossJoin(edges.agg(F.count(F.lit(1)).alias("relationships")))  # one row by one row


def hierarchy(documents: DataFrame, buckets: DataFrame) -> DataFrame:
    """part_of edges from concepts to documents and from documents to domains, as text ids."""
    d = documents.select("document_id", content_domain(F.col("content"), F.col("filename")).alias("domain"))
    up = d.select(F.concat(F.lit("document:"), F.col("document_id").cast("string")).alias("child"), F.concat(F.lit("domain:"), F.col("domain")).alias("parent"))
    down = buckets.join(d.select("document_id"), "document_id", "left_semi").select(F.concat(F.lit("concept:"), F.col("bucket_id").cast("string")).alias("child"), F.concat(F.lit("document:"), F.col("document_id").cast("string")).alias("parent"))
    return up.unionByName(down).withColumn("relation", F.lit("part_of"))


def statistics(buckets: DataFrame, documents: DataFrame, edges: DataFrame, as_of: datetime) -> DataFrame:
    """One row a tenant: totals, tiers of current strength, mean."""
    rows = lifecycle.with_current(buckets, as_of)
    per = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("memories"), *(F.count_if(F.col("tier") == t).alias(t) for t in ("strong", "fading", "critical", "forgotten")), r4(F.avg("current")).alias("average_strength"))
    state = knowledge_state(buckets, documents, edges).select("user_id", "documents", "edges")
    return per.join(state, "user_id")


def source_documents(selected: DataFrame, most: int = 5) -> DataFrame:
    """Of selected memories (question_id, bucket_id, document_id): the documents most come from."""
    grouped = selected.filter(F.col("document_id").isNotNull()).groupBy("question_id", "document_id").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("n"), "document_id"))
    return grouped.withColumn("place", rank).filter(F.col("place") <= most)


def connection_confidence(selected: DataFrame) -> DataFrame:
    """Of selected memories with a connectivity: mean and largest of those above 0, and how many there are."""
    positive = F.when(F.col("connectivity") > 0, F.col("connectivity"))
    return selected.groupBy("question_id").agg(F.coalesce(F.avg(positive), F.lit(0.0)).alias("mean"), F.coalesce(F.max(positive), F.lit(0.0)).alias("largest"), F.count(positive).alias("connected"))


def rates(results: DataFrame) -> DataFrame:
    """Ingestion results added up, with their rates."""
    total = results.agg(*(F.sum(c).cast("long").alias(c) for c in ("chunks", "concepts", "created", "merged", "failed")))
    return total.withColumn("concepts_per_chunk", ratio(F.col("concepts"), F.col("chunks"))).withColumn("created_rate", ratio(F.col("created"), F.col("concepts"))).withColumn("success_rate", ratio(F.col("chunks") - F.col("failed"), F.col("chunks")))


def view(nodes: DataFrame, edges: DataFrame, types: list[str] | None = None, show: str = "all", cross_domain: bool = True) -> tuple[DataFrame, DataFrame]:
    """What a view of the map shows: concepts of some types, all or only linked ones or islands, and edges between them; nodes have bucket_id, concept_type, degree and domain."""
    kept = nodes.filter(F.col("concept_type").isin(types)) if types else nodes
    kept = kept.filter({"all": F.lit(True), "linked": F.col("degree") > 0, "islands": F.col("degree") == 0}[show])
    end = lambda side: kept.select(F.col("bucket_id").alias(f"{side}_bucket_id"), F.col("domain").alias(f"{side}_domain"))
    shown = edges.join(end("source"), "source_bucket_id").join(end("target"), "target_bucket_id")
    return kept, shown if cross_domain else shown.filter(F.col("source_domain").eqNullSafe(F.col("target_domain")))


def most_frequent_document(selected: DataFrame) -> DataFrame:
    """For each question the document most of its selection comes from; the one that came first at a tie."""
    grouped = selected.filter(F.col("document_id").isNotNull()).groupBy("question_id", "document_id").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    return grouped.groupBy("question_id").agg(F.max_by("document_id", F.struct("n", -F.col("first"))).alias("document_id"))


def node_importance(concepts):
    """Size class of a domain or document node."""
    return F.least(F.greatest(F.floor(concepts / 6 + 0.5) + 3, F.lit(3)), F.lit(10)).cast("int")


def node_radius(importance):
    return 18 + 3.5 * importance


def detail(buckets: DataFrame, items: DataFrame, edges: DataFrame, bucket_id: int, as_of: datetime, days: int = 30) -> DataFrame:
    """One memory with its evidence, neighbours, connectivity, foreign documents and the course of its strength."""
    own = lifecycle.with_current(buckets.filter(F.col("bucket_id") == bucket_id), as_of)
    evidence = items.filter(F.col("bucket_id") == bucket_id).groupBy("bucket_id").agg(F.sort_array(F.collect_list(F.struct("item_ts", "item_id", "label", "definition"))).alias("items"))
    touching = edges.filter((F.col("source_bucket_id") == bucket_id) | (F.col("target_bucket_id") == bucket_id))
    near = graph.neighbours(touching, buckets, bucket_id).groupBy().agg(F.sort_array(F.collect_list(F.struct("other_id", "canonical", "relation_type", "confidence", "direction"))).alias("neighbours")).withColumn("bucket_id", F.lit(bucket_id).cast("long"))
    linked = graph.memory_connectivity(touching, buckets).filter(F.col("bucket_id") == bucket_id).select("bucket_id", F.col("score").alias("connectivity"), F.col("documents").alias("foreign_documents"))
    return own.withColumn("curve", decay.curve(F.col("strength"), F.col("decay_rate"), days)).join(evidence, "bucket_id", "left").join(near, "bucket_id", "left").join(linked, "bucket_id", "left")
