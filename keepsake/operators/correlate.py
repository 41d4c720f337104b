"""Correlating documents: links of concepts, centroids, label overlap, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import unit
from ..functions.text import normalize_label
from ..functions.vector import cosine_clamped, valid
from ..schema import LINK_SIMILARITY, LINKS_PER_CONCEPT, LINKS_PER_DOCUMENT
from . import graph, knn


def with_vectors(buckets: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Memories that have a valid vector."""
    return buckets.join(embeddings.filter(valid(F.col("embedding"))), "bucket_id")


def vector_edges(buckets: DataFrame, embeddings: DataFrame, document_id: int, least: float = LINK_SIMILARITY, per_concept: int = LINKS_PER_CONCEPT, per_document: int | None = LINKS_PER_DOCUMENT) -> DataFrame:
    """Edges from a document's concepts to the most similar of the tenant's other documents: unordered, at most so many a concept and a document (None: all of its concepts')."""
    rows = with_vectors(buckets, embeddings)
    found = knn.neighbours(rows.filter(F.col("document_id") == document_id), rows, per_concept, least)
    edges = found.select(F.col("query_id").alias("source_bucket_id"), F.col("neighbour_id").alias("target_bucket_id"), F.lit("related_to").alias("relation_type"), unit(F.col("similarity")).alias("confidence"), F.lit("vector").alias("method"))
    return graph.undirected(edges.withColumn("document_id", F.lit(document_id)), per_document, "document_id")


def discovered(buckets: DataFrame, embeddings: DataFrame, document_id: int, low: float = 0.6, high: float = 0.99, most: int = 5) -> DataFrame:
    """Cross-document neighbours with a similarity between low and high and another name; confidence 0.7 of it."""
    rows = with_vectors(buckets, embeddings)
    found = knn.neighbours(rows.filter(F.col("document_id") == document_id), rows, most, low, high, same_tenant=False).filter(F.col("similarity") > low)
    name = lambda key, out: buckets.select(F.col("bucket_id").alias(key), normalize_label(F.col("canonical")).alias(out))
    return found.join(name("query_id", "a"), "query_id").join(name("neighbour_id", "b"), "neighbour_id").filter("a <> b").select("query_id", "neighbour_id", "similarity", (0.7 * F.col("similarity")).alias("confidence"))


def centroids(buckets: DataFrame, embeddings: DataFrame, most: int = 100) -> DataFrame:
    """document_id and the mean of its strongest memories' vectors: partial sums of components, no list of vectors in one place."""
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("strength"), "bucket_id"))
    rows = with_vectors(buckets.filter(F.col("document_id").isNotNull()), embeddings).withColumn("n", rank).filter(F.col("n") <= most)
    parts = rows.select("document_id", F.posexplode("embedding").alias("i", "x")).groupBy("document_id", "i").agg(F.avg("x").alias("x"))
    return parts.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("centroid"))


def label_sets(buckets: DataFrame, most: int = 200) -> DataFrame:
    """document_id and the distinct normalised labels of its first memories by strength."""
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("strength"), "bucket_id"))
    rows = buckets.filter(F.col("document_id").isNotNull()).withColumn("n", rank).filter(F.col("n") <= most)
    return rows.groupBy("document_id").agg(F.array_sort(F.collect_set(normalize_label(F.col("canonical")))).alias("labels"))


def jaccard(a: Column, b: Column) -> Column:
    """0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def density(edges: Column, sources: Column, targets: Column) -> Column:
    return F.least(F.lit(1.0), edges / F.greatest(F.lit(1), F.least(sources, F.greatest(F.lit(1), targets))))


def scores(links: DataFrame, buckets: DataFrame, embeddings: DataFrame) -> DataFrame:
    """``links`` (document_id, related_id, edges, avg_confidence) with cosine of centroids, label overlap, density and score."""
    c, s = centroids(buckets, embeddings), label_sets(buckets)
    side = lambda df, key, col, out: df.select(F.col("document_id").alias(key), F.col(col).alias(out))
    out = links
    for key, mark in (("document_id", "a"), ("related_id", "b")):
        out = out.join(side(c, key, "centroid", f"c{mark}"), key, "left").join(side(s, key, "labels", f"l{mark}"), key, "left")
    none = F.array().cast("array<string>")
    la, lb = F.coalesce("la", none), F.coalesce("lb", none)
    out = out.withColumn("cosine", F.when(F.col("ca").isNotNull() & F.col("cb").isNotNull(), cosine_clamped(F.col("ca"), F.col("cb")))).withColumn("jaccard", jaccard(la, lb)).withColumn("density", density(F.col("edges"), F.size(la), F.size(lb)))
    score = F.when(F.col("cosine").isNotNull(), 0.45 * F.col("cosine") + 0.35 * F.col("jaccard") + 0.2 * F.col("density")).otherwise(0.55 * F.col("avg_confidence") + 0.25 * F.col("jaccard") + 0.2 * F.col("density"))
    return out.withColumn("score", unit(score)).drop("ca", "cb", "la", "lb")


def exact_links(buckets: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked document (document_id): the tenant's other documents that share names with it, shared names and score.

    Names are made distinct a document first; the asked documents are those just ingested."""
    owners = buckets.filter(F.col("document_id").isNotNull()).select("user_id", normalize_label(F.col("canonical")).alias("name"), "document_id").distinct()
    own = owners.join(asked.select("document_id").distinct(), "document_id", "left_semi")
    pairs = own.join(owners.withColumnRenamed("document_id", "related_id"), ["user_id", "name"]).filter("document_id <> related_id")
    return pairs.groupBy("user_id", "document_id", "related_id").agg(F.count(F.lit(1)).alias("shared")).withColumn("score", exact_score(F.col("shared")))


def exact_score(n: Column) -> Column:
    return 0.55 + F.least(F.lit(0.3), 0.1 * n) + F.least(F.lit(0.1), n / 10.0)


def merged_related(a: DataFrame, b: DataFrame, most: int = 20) -> DataFrame:
    """Related documents of both (document_id, related_id, edges, avg_confidence, score): the larger of each figure, the best of each document."""
    both = a.unionByName(b).groupBy("document_id", "related_id").agg(F.max("edges").alias("edges"), F.max("avg_confidence").alias("avg_confidence"), F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc(F.round("score", 9)), F.desc("edges"), "related_id"))
    return both.withColumn("n", rank).filter(F.col("n") <= most)
