"""Sessions, windows and deduplication over streams of events and messages. Each function takes a stream or a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(messages: DataFrame, key: str = "session_id", gap: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """A row per session of one key that ends after so long without a message: its bounds and number of messages."""
    rows = messages.withWatermark("ts", late) if messages.isStreaming else messages
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("messages"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "messages")


def split_sessions(messages: DataFrame, key: str = "session_id", gap_minutes: int = 15, most: int = 50) -> DataFrame:
    """Tables only: sessions that end after a gap or after so many messages, numbered from 1."""
    w = Window.partitionBy(key).orderBy("ts", "message_id")
    new = F.when(F.lag("ts").over(w).isNull() | (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)) > gap_minutes * 60_000_000), 1).otherwise(0)
    islands = messages.withColumn("island", F.sum(new).over(w))
    nth = F.row_number().over(Window.partitionBy(key, "island").orderBy("ts", "message_id"))
    parts = islands.withColumn("part", F.floor((nth - 1) / most).cast("int"))
    rows = parts.groupBy(key, "island", "part").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("messages"))
    return rows.withColumn("session_no", F.row_number().over(Window.partitionBy(key).orderBy("island", "part"))).drop("island", "part")


def windowed_counts(events: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events and their value by type in tumbling or sliding windows."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = rows.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("start"), "event_type", "events", "value")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """The first of each key; over a stream, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
