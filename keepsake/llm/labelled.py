"""Labelled rows for the classifiers: what may be learned from, and a bounded sample of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

SEED = 42


def held_out() -> Column:
    """Whether nothing may be learned from the row; false without an id, as such a row has no label to learn."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, column: str, most_of_each: dict[int, int]) -> DataFrame:
    """text and label of at most ``most_of_each[label]`` documents a label, first by a seeded hash of doc_id, none of them held out.

    The ids are chosen from the labels alone, so only the chosen documents' texts are joined; their number is the
    stated bound, which is what allows the broadcast. Rows without a label or id are left out; of several labels of a
    document the largest counts; repeated documents are one."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out())
    usable = usable.groupBy("doc_id").agg(F.max("label").alias("label"))
    order = F.xxhash64("doc_id", F.lit(SEED))
    chosen = None
    for label, most in most_of_each.items():
        part = usable.filter(F.col("label") == label).orderBy(order, "doc_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
