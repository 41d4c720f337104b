"""Changes to tables as new tables: upserts, partial updates, deletes with what depends on them.

There is no table format with a MERGE here, so a change is a join of the old rows and the incoming ones that gives the
new ones; ``Store.change`` runs it over the parts of a table that the incoming keys fall into. Incoming rows are made unique by key first, so the join is one
to one however often a batch repeats a key."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decay
from ..functions.text import normalize_key


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first in the order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def replaced_by(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` in place of those with their keys; the others stay."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def best_concepts(concepts: DataFrame, keys: list[str]) -> DataFrame:
    """Of repeated keys the most important, then the longest definition, then the first."""
    return first_of(concepts, keys, F.desc("importance"), F.desc(F.length("definition")), F.col("ordinal"))


def merged_buckets(buckets: DataFrame) -> DataFrame:
    """Memories of one tenant and normalised name made one: the oldest id, the largest importance and strength, accesses added up."""
    keyed = buckets.withColumn("normalized", normalize_key(F.col("canonical")))
    return keyed.groupBy("user_id", "normalized").agg(F.min("bucket_id").alias("bucket_id"), F.min_by("canonical", "bucket_id").alias("canonical"), F.max("importance").alias("importance"), F.max("strength").alias("strength"), F.sum("access_count").cast("long").alias("access_count"), F.max("last_accessed").alias("last_accessed"), F.count(F.lit(1)).alias("merged"))


def upsert_buckets(existing: DataFrame, incoming: DataFrame, as_of: datetime, start: float = 0.5) -> DataFrame:
    """The new table: user_id, normalized, canonical, importance, strength, access_count, last_accessed, action (kept, merged or created).

    existing is unique on (user_id, normalized); incoming has user_id, canonical, importance, definition and ordinal. A merge takes the larger importance and reinforces the strength."""
    fresh = best_concepts(incoming.withColumn("normalized", normalize_key(F.col("canonical"))), ["user_id", "normalized"]).select(F.col("user_id").alias("nu"), F.col("normalized").alias("nn"), F.col("canonical").alias("nc"), F.col("importance").alias("ni"))
    old = existing.select("user_id", "normalized", "canonical", "importance", "strength", "access_count", "last_accessed", F.lit(True).alias("was"))
    joined = old.join(fresh, F.col("user_id").eqNullSafe(F.col("nu")) & (F.col("normalized") == F.col("nn")), "full")
    both, new = F.col("was") & F.col("nn").isNotNull(), F.col("was").isNull()
    return joined.select(
        F.when(new, F.col("nu")).otherwise(F.col("user_id")).alias("user_id"),
        F.coalesce("normalized", "nn").alias("normalized"),
        F.coalesce("canonical", "nc").alias("canonical"),
        F.when(both, F.greatest("importance", "ni")).otherwise(F.coalesce("importance", "ni")).alias("importance"),
        F.when(both, decay.merged_strength(F.col("strength"))).otherwise(F.coalesce("strength", F.lit(start))).alias("strength"),
        F.when(both, F.col("access_count") + 1).otherwise(F.coalesce("access_count", F.lit(0))).cast("long").alias("access_count"),
        F.when(both | new, F.lit(as_of)).otherwise(F.col("last_accessed")).alias("last_accessed"),
        F.when(both, "merged").when(new, "created").otherwise("kept").alias("action"),
    )


def upsert_embeddings(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """bucket_id and embedding; the last of a batch (by ordinal) replaces what was there."""
    last = incoming.groupBy("bucket_id").agg(F.max_by("embedding", "ordinal").alias("embedding"))
    return existing.select("bucket_id", "embedding").join(last.select("bucket_id"), "bucket_id", "left_anti").unionByName(last)


EDGE_KEY = ["source_bucket_id", "target_bucket_id", "relation_type"]


def upsert_edges(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Edges by (source, target, type): the larger confidence, the old method unless there was none, the new text unless there is none, metadata maps merged with the new values on top. No edge from a memory to itself."""
    fresh = incoming.filter("source_bucket_id <> target_bucket_id").groupBy(*EDGE_KEY).agg(F.max("confidence").alias("nc"), F.min("method").alias("nm"), F.max("source_text").alias("nt"), F.max_by("metadata", F.struct("confidence", F.to_json("metadata"))).alias("nmeta"))
    joined = existing.join(fresh, EDGE_KEY, "full")
    meta = F.map_from_entries(F.concat(F.filter(F.map_entries(F.coalesce("metadata", F.create_map().cast("map<string,string>"))), lambda e: ~F.coalesce(F.map_contains_key("nmeta", e["key"]), F.lit(False))), F.map_entries(F.coalesce("nmeta", F.create_map().cast("map<string,string>")))))
    return joined.select(*EDGE_KEY, F.greatest("confidence", "nc").alias("confidence"), F.coalesce("method", "nm").alias("method"), F.coalesce("nt", "source_text").alias("source_text"), meta.alias("metadata"))


def replace_document_links(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """All links of the documents that ``incoming`` has as sources give way to its links."""
    sources = incoming.select("source_document_id").distinct()
    kept = existing.join(sources, "source_document_id", "left_anti")
    return kept.unionByName(incoming.filter((F.col("source_document_id") != F.col("target_document_id")) & F.col("score").between(0, 1)))


def merge_document_links(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of both: edges added up, confidence averaged by edges, the larger score and shared concepts."""
    both = a.unionByName(b)
    edges = F.sum("edge_count")
    mean = F.when(edges > 0, F.sum(F.col("avg_confidence") * F.col("edge_count")) / edges).otherwise(F.max("avg_confidence"))
    return both.groupBy("source_document_id", "target_document_id").agg(edges.alias("edge_count"), mean.alias("avg_confidence"), F.max("shared_concepts").alias("shared_concepts"), F.max("score").alias("score"))


def updated(df: DataFrame, key: str, changes: DataFrame) -> DataFrame:
    """Partial update: columns of ``changes`` (unique on key) that aren't null replace those of its row."""
    names = [c for c in changes.columns if c != key]
    new = changes.select(F.col(key), *(F.col(c).alias(f"__{c}") for c in names))
    return df.join(new, key, "left").select(*(F.coalesce(f"__{c}", c).alias(c) if c in names else F.col(c) for c in df.columns))


def deleted(df: DataFrame, ids: DataFrame, key: str, owner: int | None = None) -> DataFrame:
    """Without the rows of the ids; with an owner only its own rows go."""
    gone = ids.select(F.col(key)).distinct().withColumn("__gone", F.lit(True))
    hit = F.coalesce("__gone", F.lit(False)) & (F.lit(True) if owner is None else F.coalesce(F.col("user_id") == owner, F.lit(False)))
    return df.join(gone, key, "left").filter(~hit).drop("__gone")


def without_document(document_id: int, buckets: DataFrame, items: DataFrame, edges: DataFrame, embeddings: DataFrame, documents: DataFrame) -> dict[str, DataFrame]:
    """Deletes a document, its memories, their evidence, vectors and edges."""
    kept = buckets.filter(F.col("document_id").isNull() | (F.col("document_id") != document_id))
    ids = kept.select("bucket_id")
    end = lambda side: ids.withColumnRenamed("bucket_id", f"{side}_bucket_id")
    return {
        "documents": documents.filter(F.col("document_id") != document_id),
        "buckets": kept,
        "items": items.join(ids, "bucket_id", "left_semi"),
        "embeddings": embeddings.join(ids, "bucket_id", "left_semi"),
        "edges": edges.join(end("source"), "source_bucket_id", "left_semi").join(end("target"), "target_bucket_id", "left_semi"),
    }


def new_by_content(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming documents whose content the tenant doesn't have yet, one for each content: by SHA-256, the smallest id."""
    digest = F.sha2(F.col("content").cast("binary"), 256)
    fresh = first_of(incoming.withColumn("content_hash", digest), ["user_id", "content_hash"], F.col("document_id"))
    return fresh.join(existing.select("user_id", digest.alias("content_hash")).distinct(), ["user_id", "content_hash"], "left_anti")


def acted_on(reminders: DataFrame, ids: list[int], action: str) -> DataFrame:
    """dismiss and act end a reminder, boost also marks its memories for a strength of 1."""
    if action not in ("dismiss", "act", "boost"):
        raise ValueError(f"no such action: {action}")
    hit = F.col("reminder_id").isin(ids)
    return reminders.withColumn("active", F.col("active") & ~hit).withColumn("boosted", F.when(hit & F.lit(action == "boost"), F.col("memories")).otherwise(F.array().cast("array<bigint>")))


def boosted(buckets: DataFrame, ids: DataFrame) -> DataFrame:
    """Strength 1 for the memories of a reminder that was acted on."""
    return updated(buckets, "bucket_id", ids.select("bucket_id").distinct().withColumn("strength", F.lit(1.0)))


def reconcile_embeddings(buckets: DataFrame, embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors without a memory, and memories without a vector."""
    return embeddings.join(buckets.select("bucket_id"), "bucket_id", "left_anti"), buckets.join(embeddings.select("bucket_id"), "bucket_id", "left_anti")


def registered(users: DataFrame, incoming: DataFrame) -> DataFrame:
    """Users and those new ones whose address, in lower case, nobody has; of repeated addresses the first."""
    lowered = users.withColumn("email", F.lower(F.trim("email")))
    fresh = first_of(incoming.withColumn("email", F.lower(F.trim("email"))), ["email"], F.col("user_id")).join(lowered.select("email"), "email", "left_anti")
    return lowered.unionByName(fresh.select(lowered.columns))


def within_quota(uploads: DataFrame, used: DataFrame, most: int) -> DataFrame:
    """Uploads (user_id, upload_id) with whether they are within the tenant's quota, in order of id."""
    counted = uploads.join(used, "user_id", "left").withColumn("nth", F.coalesce("used", F.lit(0)) + F.row_number().over(Window.partitionBy("user_id").orderBy("upload_id")))
    return counted.withColumn("accepted", F.col("nth") <= most)
