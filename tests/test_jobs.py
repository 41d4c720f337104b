"""The job queue as a stream against a replay, and tables changed in parts."""

import os
import time
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsake.adapters import Tables
from keepsake.operators import merge
from keepsake.schema import AS_OF
from keepsake.sources.store import Store
from keepsake.streaming import jobs, reinforce

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return START + timedelta(seconds=float(seconds))


def loop(events, until, lease=300, most=3):
    """Each job's moves second by second."""
    out = []
    for job in sorted({e[0] for e in events}):
        own = sorted({e[1:] for e in events if e[0] == job}, key=lambda e: (e[2], jobs.KINDS.index(e[0]), e[1] or "", e[3] or ""))
        stage, attempt, holder, due = None, 0, None, None
        for second in range(until + 1):
            for kind, worker, when, message in [e for e in own if e[2] == second]:
                held = stage in ("picked", "parsing", "extracting") and worker == holder
                if kind == "queued" and stage is None:
                    stage = "queued"
                elif kind == "claim" and stage == "queued":
                    stage, attempt, holder, due = "picked", attempt + 1, worker, second + lease
                elif kind in ("parsing", "extracting") and held:
                    stage, due = kind, second + lease
                elif kind in ("complete", "failed") and held:
                    stage, due = kind, None
                else:
                    continue
                out.append((job, stage, attempt, holder, second, message))
            if due == second:
                stage, holder, due = "failed" if attempt >= most else "queued", None, None
                out.append((job, stage, attempt, None, second, "the lease ran out"))
    return sorted(out, key=repr)


def made(seed, n=14):
    rng = np.random.default_rng(seed)
    events = []
    for job in range(n):
        events.append((job, "queued", None, int(rng.integers(0, 50)), None))
        for _ in range(int(rng.integers(3, 16))):
            events.append((job, str(rng.choice(jobs.KINDS[1:], p=[0.4, 0.2, 0.2, 0.1, 0.1])), f"w{rng.integers(0, 2)}", int(rng.integers(0, 1500)), "said"))
    return events + events[::9]


def frame(spark, events):
    return spark.createDataFrame([(j, k, w, at(s), m) for j, k, w, s, m in events], jobs.EVENTS)


def found(df):
    return sorted(((r["job_id"], r["stage"], r["attempt"], r["worker"], round((r["at"].replace(tzinfo=timezone.utc) - START).total_seconds()), r["message"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_a_replay_equals_a_loop(spark, seed):
    events = made(seed)
    moves = jobs.replayed(frame(spark, events), at(2000))
    assert found(moves) == loop(events, 2000) and len(found(moves)) > 40
    last = {}
    for move in sorted(loop(events, 2000), key=lambda m: m[4]):
        last.setdefault(move[0], []).append(move)
    now = {r["job_id"]: r for r in jobs.current(moves).collect()}
    assert all(now[j]["attempt"] == m[-1][2] and now[j]["progress"] == {"queued": 0, "picked": 0, "parsing": 10, "extracting": 40}.get(now[j]["stage"], 100) for j, m in last.items())


def test_jobs_over_many_batches(spark):
    """Batches that cut jobs anywhere, one job over many of them, unknown and null kinds, null jobs and workers, and events that come twice."""
    events = made(5, 40) + [(70, "queued", None, 0, None), (70, "claim", None, 1, None)] + [(70, "parsing", None, 2 + i, None) for i in range(90)] + [(70, "resting", None, 3, None), (70, None, None, 4, "x"), (71, "resting", "w0", 3, None)]
    events += [(72, "queued", None, 0, ""), (72, "claim", "", 5, None), (72, "parsing", None, 6, None), (72, "parsing", "", 6, None), (72, "parsing", "", 6, None), (72, "parsing", "", 6, "")]
    rows = frame(spark, events + events[::3])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = found(jobs.replayed(rows, at(2000)))
        nulls = found(jobs.replayed(rows.filter("job_id = 70").withColumn("job_id", F.lit(None).cast("long")), at(2000)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    known = [e for e in events if e[1] in jobs.KINDS]
    assert got == loop(known, 2000) and {m[0] for m in got} == {*range(40), 70, 72}
    assert [m[1:] for m in nulls] == [m[1:] for m in got if m[0] == 70]


def test_a_replay_goes_over_jobs_together(spark):
    """Many jobs together take less than half of what they take one by one."""
    n = 20_000
    steps = (("queued", 0), ("claim", 10), ("parsing", 20), ("extracting", 30), ("complete", 40), ("claim", 50))
    job, step = np.repeat(np.arange(n), len(steps)), np.tile(np.arange(len(steps)), n)
    rows = jobs.pa.table({"job_id": job, "at": np.array([s for _, s in steps])[step] * 1_000_000, "kind": np.array([jobs.KINDS.index(k) for k, _ in steps], dtype=np.int32)[step], "worker": jobs.pa.array(["a"] * len(job)), "message": jobs.pa.nulls(len(job), jobs.pa.string())})
    began = time.perf_counter()
    moves = jobs.moves_of(rows, 10**9, 300_000_000, 3)
    together = time.perf_counter() - began
    began = time.perf_counter()
    one_by_one = sum(1 for i in range(n) for _ in jobs.settled(jobs.NEW, [(s * 1_000_000, k, "a", None) for k, s in steps], 10**9, 300_000_000, 3))
    assert moves.num_rows == one_by_one == 5 * n and together < (time.perf_counter() - began) / 2


def test_the_stream_equals_the_replay(spark, tmp_path):
    """Events arrive out of order, in several files, some of them twice; a last event moves the watermark past all others."""
    events = made(9)
    rng = np.random.default_rng(4)
    order = sorted(events, key=lambda e: e[3] + rng.uniform(0, 100))
    for i in range(0, len(order), 40):
        frame(spark, order[i : i + 40]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    frame(spark, [(999, "queued", None, 5000, None)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set(*jobs.PROVIDER)
    try:
        stream = spark.readStream.schema(jobs.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = jobs.transitions(stream, "10 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination(180)
    finally:
        spark.conf.unset(jobs.PROVIDER[0])
    out = spark.read.schema(jobs.TRANSITIONS).parquet(f"{tmp_path}/out").filter("job_id <> 999")
    assert found(out) == loop(events, 2000)


def test_a_lost_lease_goes_back_to_the_queue(spark):
    events = [(1, "queued", None, 0, None), (1, "claim", "a", 10, None), (1, "parsing", "a", 20, None), (1, "claim", "b", 400, None), (1, "complete", "a", 450, None), (1, "complete", "b", 460, "done")]
    moves = found(jobs.replayed(frame(spark, events), at(1000)))
    assert [(m[1], m[2], m[4]) for m in sorted(moves, key=lambda m: m[4])] == [("queued", 0, 0), ("picked", 1, 10), ("parsing", 1, 20), ("queued", 1, 320), ("picked", 2, 400), ("complete", 2, 460)]


def test_claims_take_the_oldest(spark):
    states = spark.createDataFrame([(i, "queued" if i % 2 else "complete", at(100 - i)) for i in range(8)], "job_id long, status string, at timestamp")
    rows = jobs.claims(states, ["x", "y", "z"], AS_OF).collect()
    assert sorted((r["job_id"], r["worker"]) for r in rows) == [(3, "z"), (5, "y"), (7, "x")]
    assert jobs.claims(states.filter("status = 'none'"), ["x"], AS_OF).count() == 0


def sizes(folder):
    return {os.path.join(d, n): os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(folder) for n in names if n.endswith(".parquet")}


def test_a_change_writes_only_its_parts(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    put = lambda old, new: merge.replaced_by(old, new, ["id"])
    s.change("t", spark.range(20_000).withColumn("v", F.rand(1)), ["id"], put)
    before = sizes(tmp_path)
    change = spark.createDataFrame([(5, -1.0), (70_000, -2.0)], "id long, v double")
    touched = s.change("t", change, ["id"], put)
    after = sizes(tmp_path)
    new = sum(n for f, n in after.items() if f not in before)
    assert len(touched) <= 2 and new < sum(before.values()) / 20 and len(set(before) - set(after)) <= 2 * spark.sparkContext.defaultParallelism
    rows = {r["id"]: r["v"] for r in s.read("t").collect()}
    assert len(rows) == 20_001 and rows[5] == -1.0 and rows[70_000] == -2.0
    s.change("t", change, ["id"], put)
    assert {r["id"]: r["v"] for r in s.read("t").collect()} == rows
    assert [tuple(r) for r in s.read_parts("t", ["id"], change.select("id").limit(1)).collect()] == [(5, -1.0)]
    gone = s.read("t").select("id").filter("id <> 77")
    s.change("t", gone, ["id"], lambda old, ids: old.join(ids, "id", "left_anti"), removes=True)
    assert [r["id"] for r in s.read("t").collect()] == [77]


def test_upserts_in_parts_equal_whole_ones(spark, tmp_path):
    t = Tables(spark, "/root/testdata/sf0.001")
    s = Store(spark, str(tmp_path))
    edges = t.edges.groupBy(*merge.EDGE_KEY).agg(F.max("confidence").alias("confidence")).select("*", F.lit("vector").alias("method"), F.lit(None).cast("string").alias("source_text"), F.create_map(F.lit("a"), F.lit("1")).alias("metadata"))
    fresh = edges.limit(30).withColumns({"confidence": F.lit(0.99), "source_text": F.lit("new"), "metadata": F.create_map(F.lit("b"), F.lit("2"))}).unionByName(edges.limit(10).withColumn("relation_type", F.lit("causes")))
    fresh = spark.createDataFrame(fresh.collect(), fresh.schema)
    s.change("edges", edges, merge.EDGE_KEY, merge.upsert_edges, parts=16)
    s.change("edges", fresh, merge.EDGE_KEY, merge.upsert_edges)
    told = lambda df: sorted(((r["source_bucket_id"], r["target_bucket_id"], r["relation_type"], r["confidence"], r["method"], r["source_text"], sorted(r["metadata"].items())) for r in df.collect()), key=repr)
    assert told(s.read("edges")) == told(merge.upsert_edges(edges, fresh))


def test_reinforcement_merges_into_its_parts(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    batch = lambda n, k: spark.createDataFrame([(i, 0.5 + k / 10, k, at(k)) for i in range(n)], reinforce.REINFORCED)
    run = reinforce.merge_batch(s, "states")
    run(batch(5000, 1), 0)
    before = sizes(tmp_path)
    run(batch(2, 2), 1)
    run(batch(2, 2), 1)
    rows = {r["bucket_id"]: r["access_count"] for r in s.read("states").collect()}
    assert len(rows) == 5000 and [rows[i] for i in range(3)] == [2, 2, 1] and len(set(sizes(tmp_path)) & set(before)) >= len(before) - 2 * spark.sparkContext.defaultParallelism
