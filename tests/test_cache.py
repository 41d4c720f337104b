"""The cache of embeddings against a loop over the given accesses."""

import os
from datetime import timezone

import pytest
from pyspark.sql import functions as F

from keepsake.adapters import Tables
from keepsake.streaming import cache, jobs

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def lookups(spark):
    """What users opened, over and over, within hours."""
    rows = Tables(spark, DATA).access.select(F.col("event_id").alias("lookup_id"), F.concat(F.lit("memory "), (F.col("bucket_id") % 23).cast("string")).alias("text"), F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.unix_timestamp("ts"), F.lit(20_000))).alias("at"))
    return rows.unionByName(spark.createDataFrame([(-1, None, None)], rows.schema))


def loop(rows, ttl, most):
    made, order, out = {}, [], []
    for number, text, at in sorted(rows, key=lambda r: (r[2], r[0])):
        hit, gone = text in made and (at - made[text]).total_seconds() < ttl, None
        if not hit:
            if text in made:
                order.remove(text)
                del made[text]
            if len(order) >= most:
                gone = order.pop(0)
                del made[gone]
            order.append(text)
            made[text] = at
        out.append((number, text, hit, gone))
    return out


def told(df):
    rows = df.collect()
    assert all(r["embedding"] == cache.stub_model([r["text"]])[0] for r in rows)
    return sorted((r["lookup_id"], r["text"], r["hit"], r["evicted"]) for r in rows)


@pytest.mark.parametrize("ttl, most, shards", [(1800, 500, 1), (1800, 10, 1), (60, 15, 1), (600, 4, 4)])
def test_a_replay_equals_a_loop(spark, lookups, ttl, most, shards):
    by = {}
    for r in cache.sharded(lookups, shards).collect():
        by.setdefault(r["shard"], []).append((r["lookup_id"], r["text"], r["at"].replace(tzinfo=timezone.utc)))
    expected = sorted(x for rows in by.values() for x in loop(rows, ttl, most))
    found = told(cache.replayed(lookups, shards=shards, ttl_seconds=ttl, most=most))
    assert found == expected and {h for _, _, h, _ in found} == {True, False}
    assert most > 100 or any(e for *_, e in found)


def test_the_stream_equals_a_loop(spark, lookups, tmp_path):
    rows = sorted(((r["lookup_id"], r["text"], r["at"]) for r in lookups.filter("text is not null").collect()), key=lambda r: (r[2], r[0]))
    size = -(-len(rows) // 4)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], cache.LOOKUPS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set(*jobs.PROVIDER)
    try:
        stream = spark.readStream.schema(cache.LOOKUPS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = cache.embedded(stream, shards=1, most=12).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination(180)
    finally:
        spark.conf.unset(jobs.PROVIDER[0])
    assert told(spark.read.parquet(f"{tmp_path}/out")) == sorted(loop([(i, t, a.replace(tzinfo=timezone.utc)) for i, t, a in rows], 1800, 12))
