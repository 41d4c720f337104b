"""Finding memories: by text, by vector, and by the terms of a question."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import cosine, valid


def like(column: str, terms: list[str]) -> Column:
    return reduce(Column.__or__, (F.col(column).ilike(f"%{t}%") for t in terms))


def by_text(buckets: DataFrame, items: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Memories whose name, or any of whose evidence, has the text; the strongest first."""
    hits = items.filter(like("label", [text]) | like("definition", [text])).select("bucket_id")
    found = buckets.select("bucket_id", "canonical", "strength").join(hits.distinct().withColumn("hit", F.lit(True)), "bucket_id", "left")
    return found.filter(F.col("canonical").ilike(f"%{text}%") | F.col("hit")).drop("hit").orderBy(F.desc("strength"), "bucket_id").limit(limit)


def by_terms(buckets: DataFrame, items: DataFrame, terms: list[str], user_id: int | None = None, limit: int = 40) -> DataFrame:
    """Memories that have any of the terms in name, label or definition, by importance and strength."""
    evidence = items.groupBy("bucket_id").agg(F.bool_or(like("label", terms) | like("definition", terms)).alias("hit"))
    found = buckets.join(evidence, "bucket_id", "left").filter(like("canonical", terms) | F.coalesce("hit", F.lit(False)))
    if user_id is not None:
        found = found.filter(F.col("user_id") == user_id)
    return found.select("bucket_id", "canonical", "importance", "strength").orderBy(F.desc("importance"), F.desc("strength"), "bucket_id").limit(limit)


def by_each_term(buckets: DataFrame, terms: list[str], limit: int = 20) -> DataFrame:
    """ceil(limit / terms) memories of each term, the strongest; a memory goes to the first term that finds it."""
    each = -(-limit // len(terms))
    ranked = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("strength"), "bucket_id"))
    tagged = buckets.withColumn("place", F.explode(F.array_compact(F.array(*(F.when(F.col("canonical").ilike(f"%{t}%"), i) for i, t in enumerate(terms))))))
    first = tagged.withColumn("term", F.col("place")).withColumn("n", ranked).filter(F.col("n") <= each)
    return first.groupBy("bucket_id").agg(F.min("place").alias("term_place"), F.first("canonical").alias("canonical")).orderBy("term_place", "bucket_id").limit(limit)


def term_hits(text: Column, definition: Column, terms: Column) -> Column:
    """Two for a term in the name, else one for it in the definition."""
    low, more = F.lower(text), F.lower(F.coalesce(definition, F.lit("")))
    return F.aggregate(terms, F.lit(0), lambda n, t: n + F.when(F.contains(low, F.lower(t)), 2).when(F.contains(more, F.lower(t)), 1).otherwise(0))


def similarity_to(vector: list[float]) -> Column:
    return cosine(F.col("embedding"), F.array(*map(F.lit, vector)))


def by_vector(embeddings: DataFrame, vector: list[float], k: int, least: float | None = None, threshold_first: bool = True) -> DataFrame:
    """The k memories most like a vector, k held to 1..200.

    threshold_first: whether the threshold is applied before the k are taken or to the k."""
    k = max(1, min(200, k))
    rows = embeddings.filter(valid(F.col("embedding"), len(vector))).withColumn("similarity", similarity_to(vector)).filter(~F.isnan("similarity")).drop("embedding")
    if least is not None and threshold_first:
        rows = rows.filter(F.col("similarity") >= least)
    rows = rows.orderBy(F.desc("similarity"), "bucket_id").limit(k)
    return rows.filter(F.col("similarity") >= least) if least is not None and not threshold_first else rows


def vector_of(embeddings: DataFrame, bucket_id: int) -> list[float]:
    """One vector, brought to the driver to be asked for."""
    row = embeddings.filter(F.col("bucket_id") == bucket_id).select("embedding").first()
    return [float(x) for x in row[0]] if row else []


def fuzzy(df: DataFrame, column: str, text: str) -> DataFrame:
    """Client-side ranking: 6 for an exact, 4 for a leading, 2 for an inner match of each word; all words are needed."""
    label = F.trim(F.regexp_replace(F.lower(F.col(column)), "[^a-z0-9]+", " "))
    words = [w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split()]
    points = [F.when(label == w, 6).when(F.startswith(label, F.lit(w)), 4).when(F.contains(label, F.lit(w)), 2).otherwise(0) for w in words]
    return df.withColumn("points", reduce(Column.__add__, points)).filter(reduce(Column.__and__, (p > 0 for p in points)))
