"""Access reinforcement as a stream: per memory, strength rises with each access and accesses are counted."""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.merge import replaced_by

START, RETAIN, BOOST = 0.5, 0.7, 0.3
REINFORCED = "bucket_id long, strength double, access_count long, last_accessed timestamp"
STATE = "strength double, access_count long, last_accessed timestamp"


def after_accesses(strength: float, accesses: int) -> float:
    """Each access rounds to four decimals, so it is a fold and not a power."""
    for _ in range(accesses):
        following = min(1.0, floor((RETAIN * strength + BOOST) * 10_000 + 0.5) / 10_000)
        if following == strength:
            break
        strength = following
    return strength


def reinforce_group(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    strength, count, last = state.get if state.exists else (START, 0, None)
    for rows in batches:
        strength, count = after_accesses(strength, len(rows)), count + len(rows)
        newest = rows["ts"].max()
        last = newest if last is None or newest > last else last
    state.update((float(strength), int(count), last))
    yield pd.DataFrame({"bucket_id": [key[0]], "strength": [strength], "access_count": [count], "last_accessed": [last]})


def reinforced(accesses: DataFrame, late: str = "1 hour") -> DataFrame:
    """Of a stream with bucket_id and ts: each memory's new state whenever it was accessed (update mode). Accesses later than ``late`` are left out."""
    rows = accesses.select("bucket_id", "ts").withWatermark("ts", late)
    return rows.groupBy("bucket_id").applyInPandasWithState(reinforce_group, REINFORCED, STATE, "update", GroupStateTimeout.NoTimeout)


def reinforced_batch(accesses: DataFrame, buckets: DataFrame | None = None, start: float = START) -> DataFrame:
    """The same over a table, from the memories' strengths where they are given: one count a memory, then a fold over that many steps at most."""
    counted = accesses.groupBy("bucket_id").agg(F.count(F.lit(1)).alias("accesses"), F.max("ts").alias("last_accessed"))
    if buckets is not None:
        counted = counted.join(buckets.select("bucket_id", F.col("strength").alias("before")), "bucket_id")
    else:
        counted = counted.withColumn("before", F.lit(start))
    # 40 steps bring any strength to where rounding keeps it
    steps = F.sequence(F.lit(1), F.least(F.col("accesses"), F.lit(40)).cast("int"))
    folded = F.aggregate(steps, F.col("before"), lambda s, _: F.least(F.lit(1.0), F.floor((RETAIN * s + BOOST) * 10_000 + 0.5).cast("double") / 10_000))
    return counted.select("bucket_id", folded.alias("strength"), F.col("accesses").alias("access_count"), "last_accessed")


def merge_batch(store, name: str):
    """For foreachBatch: merges each micro-batch's states into the stored ones, in the parts that hold them; the same batch twice changes nothing."""

    def run(batch: DataFrame, epoch: int) -> None:
        newest = batch.groupBy("bucket_id").agg(*(F.max_by(c, "access_count").alias(c) for c in ("strength", "access_count", "last_accessed")))
        store.change(name, newest, ["bucket_id"], lambda old, new: replaced_by(old, new, ["bucket_id"]))

    return run
