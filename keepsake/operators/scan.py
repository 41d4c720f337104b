"""Filtered, paged and keyed reads (lists, lookups, history), and predicates that several of them share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import preview

UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def all_of(*conditions: Column | None) -> Column:
    """Conjunction of the conditions that are given."""
    return reduce(Column.__and__, [c for c in conditions if c is not None], F.lit(True))


def of_tenant(user_id: int | None, column: str = "user_id") -> Column | None:
    return None if user_id is None else F.col(column) == user_id


def of_tenant_or_all(user_id: int, column: str = "user_id") -> Column:
    """Rows of a tenant and rows that belong to none."""
    return (F.col(column) == user_id) | F.col(column).isNull()


def not_in_document(document_id: int, column: str = "document_id") -> Column:
    return F.col(column).isNull() | (F.col(column) != document_id)


def is_uuid(column: Column) -> Column:
    return F.coalesce(F.trim(column).rlike(UUID), F.lit(False))


def buckets(df: DataFrame, user_id: int | None = None, concept_type: str | None = None, min_strength: float | None = None, max_strength: float | None = None, document_id: int | None = None, search: str | None = None) -> DataFrame:
    """Memories for which every given condition holds."""
    return df.filter(all_of(
        of_tenant(user_id),
        None if concept_type is None else F.col("concept_type") == concept_type,
        None if min_strength is None else F.col("strength") >= min_strength,
        None if max_strength is None else F.col("strength") <= max_strength,
        None if document_id is None else F.col("document_id") == document_id,
        None if search is None else F.col("canonical").ilike(f"%{search}%"),
    ))


def page(df: DataFrame, *order: Column, limit: int, offset: int = 0) -> DataFrame:
    """A page of a total order: give a unique last key."""
    return df.orderBy(*order).offset(offset).limit(limit)


def recent(df: DataFrame, limit: int, column: str = "last_accessed", key: str = "bucket_id") -> DataFrame:
    return page(df, F.desc(column), F.col(key), limit=limit)


def by_ids(df: DataFrame, ids: DataFrame, key: str = "bucket_id") -> DataFrame:
    """Rows whose key is in ``ids``."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def without_ids(df: DataFrame, ids: DataFrame, key: str = "bucket_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def by_key(df: DataFrame, key: str, user_id: int | None) -> DataFrame:
    """The memory of a tenant (or of none) by its normalised key; the smallest id if there are several."""
    return df.filter((F.col("normalized") == key) & F.col("user_id").eqNullSafe(F.lit(user_id))).orderBy("bucket_id").limit(1)


def with_items(df: DataFrame, items: DataFrame) -> DataFrame:
    """Each memory with its evidence in order of time."""
    nested = items.groupBy("bucket_id").agg(F.sort_array(F.collect_list(F.struct("item_ts", "item_id", "label", "definition", "source"))).alias("items"))
    return df.join(nested, "bucket_id", "left")


def latest_definition(items: DataFrame) -> DataFrame:
    """bucket_id and the definition of its newest evidence that has one."""
    return items.filter(F.col("definition").isNotNull()).groupBy("bucket_id").agg(F.max_by("definition", F.struct("item_ts", "item_id")).alias("definition"))


def longest_definition(items: DataFrame) -> DataFrame:
    """bucket_id, the longest definition (the first at a tie), the first source by name and the number of sources."""
    return items.groupBy("bucket_id").agg(F.max_by("definition", F.struct(F.length("definition"), -F.col("item_id"))).alias("definition"), F.min("source").alias("source"), F.count_distinct("source").alias("sources"))


def documents(df: DataFrame, user_id: int, chars: int = 200) -> DataFrame:
    """A tenant's documents with the beginning of their content, newest first."""
    return df.filter(F.col("user_id") == user_id).select("document_id", "filename", F.substring("content", 1, chars).alias("preview"), "n_chars").orderBy(F.desc("document_id"))


def last_rows(df: DataFrame, per: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in the order."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(per).orderBy(*order))).filter(F.col("position") <= n)


def last_message(messages: DataFrame) -> DataFrame:
    """A row per session: its newest message and how many it has."""
    return messages.groupBy("session_id").agg(F.max_by("message_id", F.struct("ts", "message_id")).alias("message_id"), F.max_by("role", F.struct("ts", "message_id")).alias("role"), F.max_by(preview(F.col("content")), F.struct("ts", "message_id")).alias("preview"), F.count(F.lit(1)).alias("messages"))


def scoped_edges(edges: DataFrame, buckets_: DataFrame) -> DataFrame:
    """Edges with the tenant and document of both ends."""
    end = lambda side: buckets_.select(F.col("bucket_id").alias(f"{side}_bucket_id"), F.col("user_id").alias(f"{side}_user_id"), F.col("document_id").alias(f"{side}_document_id"), F.col("canonical").alias(f"{side}_name"))
    return edges.join(end("source"), "source_bucket_id").join(end("target"), "target_bucket_id")
