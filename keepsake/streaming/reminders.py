"""Reminders as a stream: at most one a tenant in so many hours."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..settle import settled, settled_by

SENT = "user_id long, bucket_id long, ts timestamp"


def suppressed(hours: int = 24):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "bucket_id"])
        out = []
        for ts, bucket in zip(rows["ts"], rows["bucket_id"], strict=True):
            if last is None or ts - last > timedelta(hours=hours):
                out.append((key[0], bucket, ts))
                last = ts
        state.update((last,))
        yield pd.DataFrame(out, columns=["user_id", "bucket_id", "ts"])

    return run


def reminded(crossings: DataFrame, hours: int = 24, late: str = "1 hour") -> DataFrame:
    """Of a stream of crossings (user_id, bucket_id, ts): those that a reminder is sent for. A tenant's micro-batch is small: it is what crossed a tier since the last."""
    return crossings.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(suppressed(hours), SENT, "last timestamp", "append", GroupStateTimeout.NoTimeout)


def walked(hours: int):
    """Of a tenant's moments in one stretch of time, those that a reminder is sent for; the other side has the last one sent before, if any."""
    gap = int(hours * 3_600_000_000)

    def run(moments: pa.Table, before: pa.Table) -> pa.Table:
        at = moments["at"].to_numpy()
        order = np.argsort(at)
        at, picked = at[order], []
        i = int(np.searchsorted(at, before["at"][0].as_py() + gap, side="right")) if before.num_rows else 0
        while i < len(at):
            picked.append(order[i])
            i = int(np.searchsorted(at, at[i] + gap, side="right"))
        return moments.select(["user_id", "bucket_id", "at"]).take(pa.array(picked, pa.int64()))

    return run


def stretches(moments: DataFrame, hours: int, most: int) -> DataFrame:
    """moments with stretch: a tenant's time is cut into stretches of about ``most`` moments, at borders of 24ths of those hours."""
    piece = moments.withColumn("piece", F.floor(F.col("at") / (hours * 150_000_000)))
    before = F.sum("n").over(Window.partitionBy("user_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))  # a row for each piece of a tenant's time
    counted = piece.groupBy("user_id", "piece").agg(F.count(F.lit(1)).alias("n")).select("user_id", "piece", F.floor(F.coalesce(before, F.lit(0)) / most).alias("stretch"))
    return piece.join(counted, ["user_id", "piece"]).drop("piece")


def reminded_batch(crossings: DataFrame, hours: int = 24, most: int = 2_000_000) -> DataFrame:
    """The same over a table: tenants' stretches of time one after another, each read once and found along by binary search.

    Of rows of one moment the smallest bucket_id counts. What follows from a stretch is the last reminder, so a round takes
    the work of its stretches (of all tenants at once) and there are as many rounds as the largest tenant has stretches."""
    rows = crossings.filter("user_id IS NOT NULL AND ts IS NOT NULL").groupBy("user_id", F.unix_micros(F.col("ts")).alias("at")).agg(F.min("bucket_id").alias("bucket_id"))
    moments = settled_by(stretches(settled(rows), hours, most), "stretch")
    sent = rows.select("user_id", "bucket_id", "at").limit(0)
    for (stretch,) in moments.select("stretch").distinct().orderBy("stretch").collect():  # numbers of stretches, no rows of theirs
        last = sent.groupBy("user_id").agg(F.max("at").alias("at"))
        more = moments.filter(F.col("stretch") == stretch).groupBy("user_id").cogroup(last.groupBy("user_id")).applyInArrow(walked(hours), "user_id long, bucket_id long, at long")
        sent = settled(sent.unionByName(more))
    return sent.select("user_id", "bucket_id", F.timestamp_micros("at").alias("ts"))
