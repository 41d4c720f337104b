"""Conversations from JSON exports, and exports to JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "array<struct<role:string,content:string,text:string,timestamp:string>>"
ROLES = ("user", "assistant", "system")


def read_conversations(spark: SparkSession, path: str, base: str = "2024-01-01 00:00:00") -> DataFrame:
    """session, position, role, content, ts from files that hold a list of messages, an object with messages, or one with conversations of messages.

    Other roles are left out; a missing time is ``base`` and a minute for each message before it."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    nested = F.from_json("value", f"struct<conversations:array<struct<id:string,messages:{MESSAGE}>>,messages:{MESSAGE}>")
    bare = F.from_json("value", MESSAGE)
    one = lambda m: F.array(F.struct(F.lit(None).cast("string").alias("id"), m.alias("messages")))
    shaped = raw.select("file", F.coalesce(nested["conversations"], F.when(nested["messages"].isNotNull(), one(nested["messages"])), F.when(F.trim("value").startswith("["), one(bare))).alias("c"))
    rows = shaped.select("file", F.posexplode("c").alias("n", "c")).select(F.coalesce("c.id", F.concat_ws("#", "file", F.col("n").cast("string"))).alias("session"), F.posexplode("c.messages").alias("position", "m"))
    stamp = F.coalesce(F.col("m.timestamp").try_cast("timestamp"), F.lit(base).cast("timestamp") + F.make_interval(mins=F.col("position")))
    return rows.filter(F.col("m.role").isin(*ROLES)).select("session", "position", F.col("m.role").alias("role"), F.coalesce("m.content", "m.text").alias("content"), stamp.alias("ts"))


def memories_export(buckets: DataFrame, items: DataFrame, edges: DataFrame, user_id: int) -> DataFrame:
    """One JSON line a memory of a tenant, with its evidence and its edges to the tenant's memories."""
    own = buckets.filter(F.col("user_id") == user_id)
    ids = own.select("bucket_id")
    evidence = items.join(ids, "bucket_id", "left_semi").groupBy("bucket_id").agg(F.sort_array(F.collect_list(F.struct("item_ts", "item_id", "label", "definition", "source"))).alias("items"))
    inside = edges.join(ids.withColumnRenamed("bucket_id", "target_bucket_id"), "target_bucket_id", "left_semi")
    out = inside.groupBy(F.col("source_bucket_id").alias("bucket_id")).agg(F.sort_array(F.collect_list(F.struct("target_bucket_id", "relation_type", "confidence"))).alias("relationships"))
    rows = own.join(evidence, "bucket_id", "left").join(out, "bucket_id", "left")
    return rows.select("bucket_id", F.to_json(F.struct(*[c for c in rows.columns])).alias("json"))


def conversations_export(messages: DataFrame, user_id: int) -> DataFrame:
    """One JSON line a session of a tenant with its messages in order."""
    nested = messages.filter(F.col("user_id") == user_id).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("ts", "message_id", "role", "content"))).alias("messages"))
    return nested.select("session_id", F.to_json(F.struct("session_id", "messages")).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    """The lines of an export, a file for each partition."""
    df.select("json").write.mode("overwrite").text(path)
