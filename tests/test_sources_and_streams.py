"""Files, stores, exports, and streams against their batch form."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from keepsake.sources import conversations, formats, store
from keepsake.streaming import jobs, reinforce, sessions


def docx(*paragraphs: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_documents_of_all_formats(spark, tmp_path):
    files = {"a.txt": b"\xef\xbb\xbfplain text", "b.txt": b"\xff\xfe" + "wide".encode("utf-16-le"), "c.md": b"# Head\nbody", "d.json": b'{"a": {"b": 1}, "c": [1, 2],}', "e.csv": b"x;y\n1;2\n3;4", "f.yaml": b"k: v\nl:\n  m: 1", "g.py": b"class A:\n    def f(self):\n        pass\n\nx = 1\n", "h.html": b"<h1>T</h1><p>one</p><h2>U</h2>two", "i.docx": docx("first", "second"), "j.pdf": b"%PDF-broken", "k.bin": b"other", "l.txt": b"bad \xff byte"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = {r["path"].rsplit("/", 1)[1]: r for r in formats.parsed(formats.read_documents(spark, str(tmp_path))).collect()}
    assert len(rows) == len(files)
    assert rows["a.txt"]["text"] == "plain text" and rows["b.txt"]["text"] == "wide" and rows["i.docx"]["text"] == "first\nsecond"
    heads = lambda name: [s["heading"] for s in rows[name]["sections"]]
    assert heads("c.md") == ["Head"] and heads("d.json") == ["a.b", "c"] and heads("f.yaml") == ["k", "l"] and heads("g.py") == ["A", "f"] and heads("h.html") == ["T", "U"]
    assert "Rows: 2" in rows["e.csv"]["sections"][0]["text"] and rows["j.pdf"]["error"] and rows["k.bin"]["format"] == "unknown" and rows["l.txt"]["text"].startswith("bad ")


def test_front_matter_and_code(spark):
    one = spark.range(1).select(F.lit("---\ntitle: A b\nby: me\n---\n```py\nx = 1\n```\n").alias("t"))
    row = one.select(formats.front_matter(F.col("t")).alias("f"), formats.code_blocks(F.col("t")).alias("c")).first()
    assert row["f"] == {"title": "A b", "by": "me"} and [(c["language"], c["body"]) for c in row["c"]] == [("py", "x = 1\n")]


def test_conversations(spark, tmp_path):
    say = lambda *texts: [{"role": r, "content": c} for r, c in texts]
    (tmp_path / "a.json").write_text(json.dumps({"conversations": [{"id": "s1", "messages": say(("user", "hi"), ("tool", "no"), ("assistant", "yes"))}]}))
    (tmp_path / "b.json").write_text(json.dumps({"messages": say(("user", "one"))}))
    (tmp_path / "c.json").write_text(json.dumps(say(("system", "bare"))))
    rows = conversations.read_conversations(spark, str(tmp_path)).collect()
    assert sorted(r["content"] for r in rows) == ["bare", "hi", "one", "yes"]
    late = next(r for r in rows if r["content"] == "yes")
    assert late["session"] == "s1" and late["ts"].minute == 2


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    s.append("t", spark.range(3))
    s.append("t", spark.range(3, 5).withColumn("more", F.lit(1)))
    assert s.read("t").count() == 5 and "more" in s.read("t").columns
    s.replace("t", s.read("t").filter("id > 1"))
    assert s.read("t").count() == 3 and [n for n, _ in s.list()] == ["t"] and s.usage() > 0
    assert s.delete("t") and not s.exists("t")


def test_store_copies_and_lists(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    for name in ("a1", "a2", "b1"):
        s.append(name, spark.range(5))
    s.copy("a1", "b2")
    s.copy("b2", "a2")
    assert s.read("b2").count() == 5 and s.read("a2").count() == 5 and s.head("zzz") is None
    assert s.head("b2")[0] == s.head("a1")[0] > 0 and s.head("b2")[1].year >= 2024
    assert [n for n, _ in s.page(most=2)] == ["a1", "a2"] and [n for n, _ in s.page(after="a2")] == ["b1", "b2"] and [n for n, _ in s.page("b", "b1")] == ["b2"]
    assert s.delete_prefix("a") == 2 and [n for n, _ in s.list()] == ["b1", "b2"]
    with pytest.raises(ValueError):
        s.delete_prefix("")


def test_sealing(spark):
    key = F.lit(store.key_of("secret", b"salt"))
    row = spark.range(1).select(store.opened(store.sealed(F.lit("é" * 200), key), key).alias("a"), store.opened(F.lit("not sealed"), key).alias("b")).first()
    assert row["a"] == "é" * 200 and row["b"] == "not sealed"


def accesses(spark):
    rows = [(i % 4, f"2024-01-01 00:{i % 60:02d}:00") for i in range(40)]
    return spark.createDataFrame(rows, "bucket_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_end(df, mode, spark, name, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_reinforcement_stream_equals_batch(spark, tmp_path):
    accesses(spark).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("bucket_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = run_to_end(reinforce.reinforced(stream, "2 hours"), "update", spark, "reinforced", tmp_path)
    last = {r["bucket_id"]: (r["s"], r["n"]) for r in out.groupBy("bucket_id").agg(F.max_by("strength", "access_count").alias("s"), F.max("access_count").alias("n")).collect()}
    batch = {r["bucket_id"]: (r["strength"], r["access_count"]) for r in reinforce.reinforced_batch(accesses(spark)).collect()}
    assert last == batch and reinforce.after_accesses(0.5, 1) == 0.65


def test_windows_of_a_stream_equal_batch(spark, tmp_path):
    rows = accesses(spark).select(F.col("bucket_id").cast("string").alias("event_type"), F.lit(1.0).alias("value"), "ts")
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = run_to_end(sessions.windowed_counts(stream, "10 minutes"), "complete", spark, "windows", tmp_path)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, sessions.windowed_counts(rows, "10 minutes").collect()))


def test_job_queue(spark, tmp_path):
    spark.createDataFrame([(1, 1, "queued", None), (2, 1, "complete", None), (3, 2, "queued", None)], jobs.JOB_SCHEMA).write.parquet(str(tmp_path / "in"))
    s = store.Store(spark, str(tmp_path / "store"))
    (tmp_path / "store").mkdir()
    work = lambda batch: batch.select("job_id", (F.col("job_id") != 3).alias("succeeded"))
    q = jobs.worked(jobs.queue(spark, str(tmp_path / "in")), work, s).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["job_id"], r["stage"]) for r in s.read("job_states").collect()) == [(1, "complete"), (3, "failed")]


def test_sessions_split(spark):
    rows = [("a", i, f"2024-01-01 0{h}:{m:02d}:00") for i, (h, m) in enumerate([(0, 0), (0, 10), (0, 40), (0, 41)])]
    df = spark.createDataFrame(rows, "session_id string, message_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r["messages"] for r in sessions.split_sessions(df).collect()) == [2, 2]
    assert sorted(r["messages"] for r in sessions.split_sessions(df, most=1).collect()) == [1, 1, 1, 1]
