"""Connected components over pairs of integers, as joins and aggregations of the link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node and component (the smallest node reachable) of every node that has a link.

    ``links`` has columns a and b. Alternates large-star and small-star steps: each node links its larger neighbours,
    then its smaller ones, to the smallest it knows, until nothing changes; the number of rounds is logarithmic. A hot
    node's links shrink with each step and are never gathered: both steps are a minimum per node and a join. The links
    of each round are written to the shared folder, so no round is computed twice."""

    def neighbours(pairs: DataFrame) -> DataFrame:
        return pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def starred(pairs: DataFrame, large: bool) -> DataFrame:
        """Large: strictly larger neighbours go to the smallest of a node and its neighbours. Small: a node and its smaller ones."""
        near = neighbours(pairs) if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        joined = near.join(least, F.col("a") == F.col("n"))
        if large:
            out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
        return out.filter(F.col("a") != F.col("b")).distinct()

    signature = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    pairs = written(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    now = signature(pairs)
    for _ in range(most_rounds):
        if not now[0]:
            break
        following = written(starred(starred(pairs, True), False), "links")
        dropped(links.sparkSession, pairs.inputFiles()[0].rpartition("/")[0]) if pairs.inputFiles() else None
        pairs, before = following, now
        now = signature(pairs)
        if now == before:
            break
    else:
        raise RuntimeError("components did not settle")
    members = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
