"""The weighted graph of memories: neighbours, expansion, connectivity, links of documents, clean-up.

Edges have source_bucket_id, target_bucket_id, relation_type and confidence. Every operator is a join on an end's id;
edges are turned into half-edges (own end, other end) once, so that a hot memory is one key of a plain aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import unit
from ..settle import settled


def halves(edges: DataFrame) -> DataFrame:
    """Two rows an edge: own and other end, and the direction seen from the own end."""
    out = edges.select(F.col("source_bucket_id").alias("bucket_id"), F.col("target_bucket_id").alias("other_id"), "relation_type", "confidence", F.lit("out").alias("direction"))
    return out.unionByName(edges.select(F.col("target_bucket_id").alias("bucket_id"), F.col("source_bucket_id").alias("other_id"), "relation_type", "confidence", F.lit("in").alias("direction")))


def other_end(edges: DataFrame, bucket_id: int) -> Column:
    return F.when(edges["source_bucket_id"] == bucket_id, edges["target_bucket_id"]).otherwise(edges["source_bucket_id"])


def neighbours(edges: DataFrame, buckets: DataFrame, bucket_id: int) -> DataFrame:
    """Both directions of one memory, with the neighbour's name and type."""
    near = halves(edges.filter((F.col("source_bucket_id") == bucket_id) | (F.col("target_bucket_id") == bucket_id))).filter(F.col("bucket_id") == bucket_id)
    return near.drop("bucket_id").join(buckets.select(F.col("bucket_id").alias("other_id"), "canonical", "concept_type"), "other_id")


def neighbours_by_name(edges_by_name: DataFrame, buckets: DataFrame, name: str, by_id: DataFrame) -> DataFrame:
    """Older edges that know names only (source_name, target_name); used where ``by_id`` has nothing."""
    out = edges_by_name.filter(F.col("source_name") == name).select(F.col("target_name").alias("canonical"), "relation_type", "confidence", F.lit("out").alias("direction"))
    into = edges_by_name.filter(F.col("target_name") == name).select(F.col("source_name").alias("canonical"), "relation_type", "confidence", F.lit("in").alias("direction"))
    found = out.unionByName(into).join(buckets.groupBy("canonical").agg(F.min("bucket_id").alias("other_id"), F.min_by("concept_type", "bucket_id").alias("concept_type")), "canonical")
    return found.join(by_id.limit(1).select(F.lit(1).alias("some")), F.lit(True), "left_anti")


def expand(edges: DataFrame, seeds: DataFrame, limit: int = 40) -> DataFrame:
    """Neighbours of the seeds that are no seeds, by their best edge; ``seeds`` has bucket_id."""
    own = seeds.select("bucket_id").distinct()
    near = halves(edges).join(own, "bucket_id", "left_semi").groupBy("other_id").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("hits"))
    return near.join(own.withColumnRenamed("bucket_id", "other_id"), "other_id", "left_anti").orderBy(F.desc("confidence"), "other_id").limit(limit).withColumnRenamed("other_id", "bucket_id")


def hops(edges: DataFrame, seeds: DataFrame, depth: int = 2, per_hop: int = 100) -> DataFrame:
    """bucket_id and hop: breadth first, at most ``per_hop`` new memories a hop, the best edges first.

    What a hop has seen is written before the next one starts (``per_hop`` rows a hop and the seeds), so a hop's plan is
    the same whatever its depth, and edges are joined to few rows."""
    both = halves(edges).select("bucket_id", "other_id", "confidence")
    seen = settled(seeds.select("bucket_id").distinct().withColumn("hop", F.lit(0)))
    for hop in range(1, depth + 1):
        last = seen.filter(F.col("hop") == hop - 1).select("bucket_id")
        near = both.join(last, "bucket_id", "left_semi").groupBy(F.col("other_id").alias("bucket_id")).agg(F.max("confidence").alias("c"))
        fresh = near.join(seen.select("bucket_id"), "bucket_id", "left_anti").orderBy(F.desc("c"), "bucket_id").limit(per_hop)
        seen = settled(seen.unionByName(fresh.select("bucket_id", F.lit(hop).alias("hop"))))
    return seen


def degrees(edges: DataFrame, buckets: DataFrame) -> DataFrame:
    """bucket_id, degree (edges at it) and whether it is an island."""
    ends = halves(edges).groupBy("bucket_id").agg(F.count(F.lit(1)).alias("degree"))
    return buckets.select("bucket_id").join(ends, "bucket_id", "left").select("bucket_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"), F.col("degree").isNull().alias("island"))


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """Over so many partitions by the keys; None leaves it to the session."""
    return df if parts is None else df.repartition(parts, *keys)


def half_edges_with_documents(edges: DataFrame, buckets: DataFrame, parts: int | None = None) -> DataFrame:
    """``halves`` with tenant and document of both ends. Edges are joined before they are turned into halves, so half as many rows are shuffled.

    With ``parts`` (of the edges, which are dealt by their source already) memories are hashed, not edges sorted, and the result is dealt by bucket_id."""
    end = lambda side: buckets.select(F.col("bucket_id").alias(f"{side}_bucket_id"), F.col("user_id").alias(f"{side}_user"), F.col("document_id").alias(f"{side}_document"))
    if parts is not None:
        source, target = end("source").hint("shuffle_hash"), end("target").hint("shuffle_hash")
    else:
        source, target = end("source"), end("target")
    rows = dealt(edges.join(source, "source_bucket_id"), parts, "target_bucket_id").join(target, "target_bucket_id").withColumn("__out", F.explode(F.array(F.lit(True), F.lit(False))))
    pick = lambda column, a, b, name: F.when(F.col("__out"), F.col(f"{a}_{column}")).otherwise(F.col(f"{b}_{column}")).alias(name)
    own = [pick(c, "source", "target", n) for c, n in (("bucket_id", "bucket_id"), ("user", "user_id"), ("document", "document_id"))]
    other = [pick(c, "target", "source", n) for c, n in (("bucket_id", "other_id"), ("user", "other_user"), ("document", "other_document"))]
    return dealt(rows.select(*own, *other, "relation_type", "confidence", F.when(F.col("__out"), "out").otherwise("in").alias("direction")), parts, "bucket_id")


def connectivity(edges: DataFrame, buckets: DataFrame, user_id: int, current_document: int | None = None, recent: DataFrame | None = None) -> DataFrame:
    """For each memory of a tenant: neighbours, neighbours in other documents, mean confidence, links to the current document and to recent memories, score."""
    near = half_edges_with_documents(edges, buckets).filter((F.col("user_id") == user_id) & (F.col("other_user") == user_id))
    flag = F.lit(False)
    if recent is not None:
        near = near.join(recent.select(F.col("bucket_id").alias("other_id"), F.lit(True).alias("is_recent")).distinct(), "other_id", "left")
        flag = F.coalesce("is_recent", F.lit(False))
    cross = F.when(F.col("other_document").isNotNull() & ~F.col("other_document").eqNullSafe(F.col("document_id")), F.col("other_id"))
    here = F.coalesce(F.col("other_document") == (-1 if current_document is None else current_document), F.lit(False))
    grouped = near.groupBy("bucket_id").agg(F.count_distinct("other_id").alias("degree"), F.count_distinct(cross).alias("cross_document"), F.avg("confidence").alias("avg_confidence"), F.bool_or(here).alias("to_current"), F.bool_or(flag).alias("to_recent"))
    score = 0.45 * F.least(F.lit(1.0), F.col("degree") / 8) + 0.25 * F.least(F.lit(1.0), F.col("cross_document") / 4) + 0.2 * F.col("avg_confidence") + F.when(F.col("to_current"), 0.1).otherwise(0.0) + F.when(F.col("to_recent"), 0.05).otherwise(0.0)
    return grouped.withColumn("score", unit(score))


def memory_connectivity(edges: DataFrame, buckets: DataFrame, parts: int | None = None) -> DataFrame:
    """The detail view's score: half by degree (of 10), 0.3 by foreign documents (of 5), 0.2 by confidence.

    Grouped by the other end first (it has one document), so that no row is copied for a second distinct count."""
    foreign = F.when(~F.col("other_document").eqNullSafe(F.col("document_id")), F.col("other_document"))
    others = half_edges_with_documents(edges, buckets, parts).groupBy("bucket_id", "other_id").agg(F.max(foreign).alias("foreign"), F.sum("confidence").alias("c"), F.count("confidence").alias("n"))
    grouped = others.groupBy("bucket_id").agg(F.count(F.lit(1)).alias("degree"), F.count_distinct("foreign").alias("documents"), (F.sum("c") / F.sum("n")).alias("avg_confidence"))
    return grouped.withColumn("score", unit(0.5 * F.least(F.lit(1.0), F.col("degree") / 10) + 0.3 * F.least(F.lit(1.0), F.col("documents") / 5) + 0.2 * F.col("avg_confidence")))


def connected_documents(edges: DataFrame, buckets: DataFrame, most: int = 10, parts: int | None = None) -> DataFrame:
    """For each memory, the foreign documents it has most edges to."""
    near = half_edges_with_documents(edges, buckets, parts).filter(F.col("other_document").isNotNull() & ~F.col("other_document").eqNullSafe(F.col("document_id")))
    grouped = near.groupBy("bucket_id", "other_document").agg(F.count(F.lit(1)).alias("edges"), F.avg("confidence").alias("avg_confidence"))
    rank = F.row_number().over(Window.partitionBy("bucket_id").orderBy(F.desc("edges"), F.desc(F.round("avg_confidence", 9)), "other_document"))
    return grouped.withColumn("n", rank).filter(F.col("n") <= most)


def document_links(edges: DataFrame, buckets: DataFrame, parts: int | None = None) -> DataFrame:
    """Ordered pairs of documents with an edge between their memories: edges, mean confidence, shared memories, score."""
    near = half_edges_with_documents(edges, buckets, parts).filter(F.col("document_id").isNotNull() & F.col("other_document").isNotNull() & (F.col("document_id") != F.col("other_document")))
    memories = near.groupBy("bucket_id", "document_id", F.col("other_document").alias("related_id")).agg(F.count(F.lit(1)).alias("edges"), F.sum("confidence").alias("c"), F.count("confidence").alias("n"))
    grouped = memories.groupBy("document_id", "related_id").agg(F.sum("edges").alias("edges"), (F.sum("c") / F.sum("n")).alias("avg_confidence"), F.count(F.lit(1)).alias("concepts"))
    return grouped.withColumn("score", edge_score(F.col("avg_confidence"), F.col("edges")))


def edge_score(confidence: Column, edges: Column) -> Column:
    return 0.45 * confidence + 0.35 * F.least(F.lit(1.0), edges / 5) + 0.2 * F.least(F.lit(1.0), edges / 10)


def related_documents(edges: DataFrame, buckets: DataFrame, document_id: int, most: int = 10, parts: int | None = None) -> DataFrame:
    """The best related documents of one."""
    return document_links(edges, buckets, parts).filter(F.col("document_id") == document_id).orderBy(F.desc(F.round("score", 9)), F.desc("edges"), "related_id").limit(most)


def top_connected(edges: DataFrame, buckets: DataFrame, document_id: int, most: int = 10) -> DataFrame:
    """Memories of other documents that this one's are linked to, by their best edge."""
    near = half_edges_with_documents(edges, buckets).filter((F.col("document_id") == document_id) & ~F.col("other_document").eqNullSafe(F.lit(document_id)))
    return near.groupBy(F.col("other_id").alias("bucket_id")).agg(F.max("confidence").alias("confidence"), F.max("relation_type").alias("relation_type")).orderBy(F.desc("confidence"), "bucket_id").limit(most)


def connection_stats(edges: DataFrame, buckets: DataFrame, user_id: int, strong: float = 0.75) -> DataFrame:
    """One row: exact, semantic and cross-document edges of a tenant, strong ones, mean confidence, and their score."""
    doc = lambda side: buckets.filter(F.col("user_id") == user_id).select(F.col("bucket_id").alias(f"{side}_bucket_id"), F.col("document_id").alias(f"{side}_doc"))
    rows = edges.join(doc("source"), "source_bucket_id").join(doc("target"), "target_bucket_id")
    one = rows.agg(F.count_if(F.col("method") == "extraction").alias("exact"), F.count_if(F.col("method") == "vector").alias("semantic"), F.count_if(F.col("source_doc") != F.col("target_doc")).alias("cross_document"), F.count_if(F.col("confidence") >= strong).alias("strong"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"))
    capped = lambda name, of: F.least(F.lit(1.0), F.col(name) / of)
    raw = 0.45 * capped("exact", 2) + 0.3 * capped("semantic", 5) + 0.15 * capped("cross_document", 5) + 0.1 * F.col("avg_confidence")
    return one.withColumn("score", unit(F.when(F.col("exact") > 0, F.greatest(raw, F.lit(0.35))).otherwise(raw)))


def co_accessed(edges: DataFrame, accesses: DataFrame) -> DataFrame:
    """a, b and times: the edges' unordered pairs whose both ends were accessed in one group; ``accesses`` has group_id and bucket_id.

    Accesses are looked up for one end, then for the other, so a group's rows are never paired with each other: a busy
    group costs its accesses times their edges."""
    known = accesses.select("group_id", "bucket_id").distinct()
    pairs = edges.select(F.least("source_bucket_id", "target_bucket_id").alias("a"), F.greatest("source_bucket_id", "target_bucket_id").alias("b")).filter("a < b").distinct()
    first = pairs.join(known.withColumnRenamed("bucket_id", "a"), "a")
    return first.join(known.withColumnRenamed("bucket_id", "b"), ["group_id", "b"], "left_semi").groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"))


def strengthened(edges: DataFrame, pairs: DataFrame, by: float = 0.05) -> DataFrame:
    """Edges between pairs (a < b) gain confidence, up to 1."""
    keyed = edges.withColumn("a", F.least("source_bucket_id", "target_bucket_id")).withColumn("b", F.greatest("source_bucket_id", "target_bucket_id"))
    return keyed.join(pairs.select("a", "b").distinct().withColumn("hit", F.lit(True)), ["a", "b"], "left").withColumn("confidence", F.when(F.col("hit"), F.least(F.lit(1.0), F.col("confidence") + by)).otherwise(F.col("confidence"))).drop("a", "b", "hit")


def orphans(edges: DataFrame, buckets: DataFrame) -> DataFrame:
    """Edges one of whose ends is no memory."""
    end = lambda side: buckets.select(F.col("bucket_id").alias(f"{side}_bucket_id"), F.lit(True).alias(side))
    return edges.join(end("source"), "source_bucket_id", "left").join(end("target"), "target_bucket_id", "left").filter(F.col("source").isNull() | F.col("target").isNull()).select(edges.columns)


def orphans_by_id_or_name(edges: DataFrame, buckets: DataFrame) -> DataFrame:
    """The same for edges that may lack ids and then go by source_name and target_name."""
    ids, names = buckets.select("bucket_id").distinct(), buckets.select("canonical").distinct()
    out = edges
    for side in ("source", "target"):
        out = out.join(ids.select(F.col("bucket_id").alias(f"{side}_bucket_id"), F.lit(True).alias(f"{side}_by_id")), f"{side}_bucket_id", "left").join(names.select(F.col("canonical").alias(f"{side}_name"), F.lit(True).alias(f"{side}_by_name")), f"{side}_name", "left")
    missing = lambda s: F.when(F.col(f"{s}_bucket_id").isNotNull(), F.col(f"{s}_by_id").isNull()).otherwise(F.col(f"{s}_by_name").isNull())
    return out.filter(missing("source") | missing("target")).select(edges.columns)


def undirected(edges: DataFrame, most: int | None = None, per: str | None = None) -> DataFrame:
    """One edge for each unordered pair and type, the most confident; at most so many a group."""
    keyed = edges.withColumn("a", F.least("source_bucket_id", "target_bucket_id")).withColumn("b", F.greatest("source_bucket_id", "target_bucket_id"))
    best = keyed.withColumn("n", F.row_number().over(Window.partitionBy("a", "b", "relation_type").orderBy(F.desc("confidence"), "source_bucket_id"))).filter("n = 1")
    if most is not None and per is not None:
        best = best.withColumn("n", F.row_number().over(Window.partitionBy(per).orderBy(F.desc("confidence"), "a", "b"))).filter(F.col("n") <= most)
    return best.drop("a", "b", "n")


def labels_to_ids(labels: DataFrame, buckets: DataFrame) -> DataFrame:
    """label, user_id, document_id (of those who ask) to a memory: of the same document, else tenant, else of no tenant, else any; the smallest id at a tie.

    ``buckets`` has normalized; it is reduced to one id for each name at every level before it is joined, so a common name is one row."""
    wanted = labels.withColumn("normalized", F.col("label_key"))
    level = lambda cols, name: buckets.groupBy("normalized", *cols).agg(F.min("bucket_id").alias(name))
    out = wanted.join(level(["user_id", "document_id"], "by_document"), ["normalized", "user_id", "document_id"], "left").join(level(["user_id"], "by_user"), ["normalized", "user_id"], "left")
    shared = buckets.filter(F.col("user_id").isNull()).groupBy("normalized").agg(F.min("bucket_id").alias("by_none"))
    out = out.join(shared, "normalized", "left").join(level([], "by_any"), "normalized", "left")
    return out.withColumn("bucket_id", F.coalesce("by_document", "by_user", "by_none", "by_any")).drop("by_document", "by_user", "by_none", "by_any")


def extraction_edges(concepts: DataFrame, confidence: float = 0.65) -> DataFrame:
    """Edges from concepts (bucket_id, related ids) to what they name."""
    return concepts.select(F.col("bucket_id").alias("source_bucket_id"), F.explode("related_ids").alias("target_bucket_id")).filter("source_bucket_id <> target_bucket_id").distinct().select("source_bucket_id", "target_bucket_id", F.lit("related_to").alias("relation_type"), F.lit(confidence).alias("confidence"), F.lit("extraction").alias("method"))


def resolved(edges_by_name: DataFrame, buckets: DataFrame) -> DataFrame:
    """Exported edges (source, target as text) with the memories they mean: by id, else by name without regard to case; both ends are needed.

    Names are reduced to their smallest id before they are joined."""
    ids = buckets.select(F.col("bucket_id").cast("string").alias("k"), F.col("bucket_id").alias("v"))
    names = buckets.groupBy(F.lower("canonical").alias("k")).agg(F.min("bucket_id").alias("v"))
    out = edges_by_name
    for side in ("source", "target"):
        out = out.join(ids.select(F.col("k").alias(side), F.col("v").alias(f"{side}_by_id")), side, "left").withColumn("__low", F.lower(side)).join(names.select(F.col("k").alias("__low"), F.col("v").alias(f"{side}_by_name")), "__low", "left").drop("__low")
        out = out.withColumn(f"{side}_bucket_id", F.coalesce(f"{side}_by_id", f"{side}_by_name")).drop(f"{side}_by_id", f"{side}_by_name")
    return out.filter(F.col("source_bucket_id").isNotNull() & F.col("target_bucket_id").isNotNull())


def clean_metadata(metadata: Column) -> Column:
    """Of JSON text: method, similarity in [0, 1], documents and evidence of at most 1,000 characters; empty ones left out."""
    m = F.from_json(metadata, "method string, similarity double, sourceDocumentId string, targetDocumentId string, evidence string")
    given = lambda x: F.nullif(x, F.lit(""))
    similar = F.when(m["similarity"].isNotNull() & ~F.isnan(m["similarity"]), unit(m["similarity"]))
    return F.struct(given(m["method"]).alias("method"), similar.alias("similarity"), given(m["sourceDocumentId"]).alias("source_document_id"), given(m["targetDocumentId"]).alias("target_document_id"), F.substring(given(m["evidence"]), 1, 1000).alias("evidence"))
