"""Text containment by stored postings: for each run of three characters the rows that have it.

A search reads the postings of its term's runs only, keeps the rows that have all of them, and verifies those against
their texts, so results are those of a LIKE over every text. Postings are rows, not lists: a run that a third of all texts
has is no group anywhere, and its rows are counted before they are shuffled. They lie in parts by a hash of the run and
sorted within, so a search prunes by folder first and by row groups then."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import PARTS, Store

SIZE = 3


def grams_of(text: Column, size: int = SIZE) -> Column:
    """Distinct runs of the lower-cased text; none of a shorter or null one."""
    low = F.lower(text)
    at = F.when(F.length(low) >= size, F.sequence(F.lit(1), F.length(low) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(low, i, F.lit(size))))


def grams_asked(term: str, size: int = SIZE) -> list[str]:
    """Runs that every text has that matches %term%, whose own wildcards stand for anything."""
    pieces = re.split(r"[%_\\]", term.lower())
    return sorted({p[i : i + size] for p in pieces for i in range(len(p) - size + 1)})


class TextIndex:
    """Postings of a table's texts under a name in a store. ``key`` names its rows, ``columns`` its texts."""

    def __init__(self, store: Store, name: str, key: str, columns: list[str], parts: int = PARTS):
        self.store, self.name, self.key, self.columns, self.parts = store, name, key, columns, parts

    def part(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.parts)).cast("int")

    def add(self, rows: DataFrame) -> None:
        """Adds postings of rows. Those of a text that has changed since may stay: what they find is verified."""
        each = F.array_distinct(F.flatten(F.array(*(F.coalesce(grams_of(F.col(c)), F.array().cast("array<string>")) for c in self.columns))))
        posted = rows.select(F.col(self.key).alias("row"), F.explode(each).alias("gram")).withColumn("part", self.part(F.col("gram")))
        posted.repartition(self.parts, "part").sortWithinPartitions("part", "gram").write.mode("append").partitionBy("part").parquet(f"{self.store.folder}/{self.name}")

    def candidates(self, term: str) -> DataFrame | None:
        """``row`` of all rows that may have the term; None if the postings can't tell, as it has no run."""
        asked = grams_asked(term)
        if not asked:
            return None
        spark = self.store.spark
        parts = sorted({r[0] for r in spark.createDataFrame([(g,) for g in asked], "gram string").select(self.part(F.col("gram"))).collect()})
        found = self.store.read(self.name).filter(F.col("part").isin(parts) & F.col("gram").isin(asked))
        return found.groupBy("row").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(asked)).select("row")

    def matching(self, rows: DataFrame | str, term: str) -> DataFrame:
        """Rows with the term in any of their texts, whatever its case. ``rows``: a table, or the name of one that the store has laid out by the key, of which only the parts that may have the term are read."""
        has = reduce(Column.__or__, (F.col(c).ilike(f"%{term}%") for c in self.columns))
        near = self.candidates(term)
        if near is None:
            return (self.store.read(rows) if isinstance(rows, str) else rows).filter(has)
        if isinstance(rows, str):
            return self.store.read_parts(rows, [self.key], near.withColumnRenamed("row", self.key)).filter(has)
        return rows.join(near, F.col(self.key) == F.col("row"), "left_semi").filter(has)


def by_text(index: TextIndex, buckets: DataFrame, items: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """As ``search.by_text``, with the evidence found by ``index`` (of item_id, label and definition)."""
    hits = index.matching(items, text).select("bucket_id").distinct().withColumn("hit", F.lit(True))
    found = buckets.select("bucket_id", "canonical", "strength").join(hits, "bucket_id", "left")
    return found.filter(F.col("canonical").ilike(f"%{text}%") | F.col("hit")).drop("hit").orderBy(F.desc("strength"), "bucket_id").limit(limit)


def by_terms(index: TextIndex, buckets: DataFrame, items: DataFrame, terms: list[str], user_id: int | None = None, limit: int = 40) -> DataFrame:
    """As ``search.by_terms``."""
    hits = reduce(DataFrame.unionByName, (index.matching(items, t).select("bucket_id") for t in terms)).distinct().withColumn("hit", F.lit(True))
    found = buckets.join(hits, "bucket_id", "left").filter(reduce(Column.__or__, (F.col("canonical").ilike(f"%{t}%") for t in terms)) | F.coalesce("hit", F.lit(False)))
    if user_id is not None:
        found = found.filter(F.col("user_id") == user_id)
    return found.select("bucket_id", "canonical", "importance", "strength").orderBy(F.desc("importance"), F.desc("strength"), "bucket_id").limit(limit)
