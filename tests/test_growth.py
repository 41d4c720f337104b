"""Queries on tables that are larger than the given ones, or made so that a step that grows faster than its input shows."""

import functools
import os
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from keepsake import adapters
from keepsake.functions import text
from keepsake.operators import knn
from keepsake.plans import catalog, ingest, retrieve
from keepsake.sources import store
from keepsake.streaming import reminders

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def folder_with(tmp_path, **tables):
    """A folder like the driver's, some of its tables replaced."""
    for name in os.listdir(DATA):
        if name.split(".")[0] not in tables:
            os.symlink(f"{DATA}/{name}", tmp_path / name)
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def same_as_sql(spark, folder, name):
    """The rows of a query, which its SQL gives too."""
    con = duckdb.connect()
    for file in os.listdir(folder):
        path = f"{folder}/{file}"
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    found = con.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    rows = sorted(map(tuple, __spark_entry__.queries()[name](spark, folder).select(columns).collect()), key=repr)
    assert rows == sorted(found.fetchall(), key=repr)
    return rows


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_approximate_pairs_stay_in_their_cells(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, rng.standard_normal(16).tolist()) for i in range(600)] + [(600, None), (601, [0.0] * 16)], "bucket_id long, embedding array<double>")
    asked = rows.filter("bucket_id % 50 = 0")
    whole, parts = knn.approximate(asked, rows, 0.2), knn.approximate(asked, rows, 0.2, block=7)
    assert shuffles(whole) == 2  # both sides once; no pair is shuffled
    found = sorted(map(tuple, whole.collect()))
    assert len(found) > 500
    assert [r[:2] for r in found] == [r[:2] for r in sorted(map(tuple, parts.collect()))]


def test_every_vector_is_asked_for_its_pairs(spark):
    rows = [r for r in adapters.Tables(spark, DATA).embeddings.collect() if r["embedding"]]
    ids, vectors = np.array([r["bucket_id"] for r in rows]), np.array([r["embedding"] for r in rows])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    close = vectors @ vectors.T
    np.fill_diagonal(close, -1)
    pairs = lambda least: {(int(ids[a]), int(ids[b])) for a, b in zip(*np.nonzero(close >= least), strict=True)}
    found = [(r["query_id"], r["neighbour_id"]) for r in __spark_entry__.queries()["vector_approximate_pairs"](spark, DATA).collect()]
    assert len(set(found)) == len(found) >= 0.9 * len(pairs(0.2 + 1e-9)) and set(found) <= pairs(0.2 - 1e-9)
    assert {a for a, _ in found} == {a for a, _ in pairs(0.2 + 1e-9)}  # each of them has some pair


def test_tasks_of_the_grid_grow_with_its_cells(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, rng.standard_normal(16).tolist()) for i in range(600)], "bucket_id long, embedding array<double>")
    whole, parts = knn.approximate(rows, rows, 0.2), knn.approximate(rows, rows, 0.2, block=20)
    tasks = -(-30 * 30 // knn.CELLS_A_TASK)
    dealt = re.findall(r"Exchange hashpartitioning\(([a-z_]+)#\d+L?, (?:c#\d+, )?(\d+)\)", parts._jdf.queryExecution().executedPlan().toString())
    assert sorted(dealt) == [("bucket_id", str(tasks))] * 2 + [("r", str(tasks))] * 2
    found = sorted((r[0], r[1]) for r in parts.collect())
    assert len(found) > 50_000 and found == sorted((r[0], r[1]) for r in whole.collect())


def test_links_of_a_large_document_are_not_cut(spark, tmp_path):
    rng = np.random.default_rng(4)
    part = spark.read.parquet(f"{DATA}/part.parquet").filter("p_partkey <= 200").crossJoin(spark.range(40)).withColumn("p_partkey", F.col("p_partkey") + 200 * F.col("id")).drop("id")
    vectors = spark.createDataFrame([(i, rng.standard_normal(8).tolist(), 0) for i in range(1, 8001)], "vec_id long, embedding array<float>, label int")
    assert len(same_as_sql(spark, folder_with(tmp_path, part=part, embeddings=vectors), "knn_edges")) > 150


@pytest.mark.parametrize("name", ["memory_connectivity", "connected_documents", "document_links_aggregate", "document_links_merge", "related_documents", "document_links_replace"])
def test_partitions_of_edges_grow_with_the_table(spark, monkeypatch, name):
    """A task's share of edges doesn't grow with them, whatever number of partitions the session has."""
    monkeypatch.setattr(adapters, "ROWS_A_TASK", 500)
    rows = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert adapters.Tables(spark, DATA).parts == -(-rows // 500) > 10
    plan = __spark_entry__.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    told = re.findall(r"Exchange hashpartitioning\((?:p_partkey|l_orderkey|(?:source_|target_)?bucket_id)[^\n]*, (\d+)\), ", plan)
    assert len(told) >= 5 and set(told) == {str(-(-rows // 500))}
    assert same_as_sql(spark, DATA, name)


def test_reminders_over_many_stretches(spark):
    rng = np.random.default_rng(6)
    hour = 3_600_000_000
    rows = [(u, int(rng.integers(0, 9)), int(x)) for u, n in ((1, 900), (2, 30), (3, 1)) for x in rng.integers(-5 * hour, 400 * hour, n)]
    rows += [(4, i, 24 * hour * i) for i in range(40)] + [(5, 2, 7), (5, 1, 7), (5, 1, 24 * hour + 7), (5, 1, 24 * hour + 8)]
    expected = []
    for user in range(1, 6):
        last = None
        for at, bucket in sorted((r[2], r[1]) for r in rows if r[0] == user):
            if last is None or at - last > 24 * hour:
                expected.append((user, bucket, at))
                last = at
    df = spark.createDataFrame(rows, "user_id long, bucket_id long, at long").withColumn("ts", F.timestamp_micros("at"))
    cut = reminders.stretches(df.select("user_id", "bucket_id", "at"), 24, 100).groupBy("user_id", "stretch").count().collect()
    assert len(cut) > 10 and max(r["count"] for r in cut) < 150
    found = reminders.reminded_batch(df, most=100)
    assert sorted(map(tuple, found.select("user_id", "bucket_id", F.unix_micros("ts")).collect())) == sorted(expected)


def test_texts_are_searched_in_many_tasks(spark, monkeypatch):
    """Memories in one file don't mean that one task searches all texts."""
    questions = spark.createDataFrame([(q, q, [], [word]) for q, word in enumerate(("the", "again", "model"))], "question_id long, user_id long, key_terms array<string>, expanded_terms array<string>").withColumn("vector", F.array_repeat(F.lit(0.5), 64))
    found = lambda t: sorted(map(tuple, retrieve.direct_hits(t, retrieve.held(questions)).collect()))
    whole = found(adapters.Tables(spark, DATA))
    monkeypatch.setattr(adapters, "ROWS_A_TASK", 500)
    t = adapters.Tables(spark, DATA)
    plan = retrieve.direct_hits(t, retrieve.held(questions))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(rf"Exchange hashpartitioning\((?:p_partkey|bucket_id)#\w+, {t.parts}\), REPARTITION_BY_NUM", plan)) >= 3
    assert found(t) == whole and len(whole) > 20
    assert sorted(map(tuple, t.items.collect())) == sorted(map(tuple, t._view("m_items").collect()))


def test_documents_are_extracted_once(spark):
    """Sections are cut and the model is asked once, though a document's concepts are compared with each other."""
    df = __spark_entry__.queries()["ingest_documents"](spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1
    docs = spark.createDataFrame([(1, "Alpha stands here with Gamma"), (2, "Gamma stands here with Delta")], "document_id long, section string").withColumn("section_index", F.lit(0))
    rows = ingest.concepts_of(store.extracted(docs)).select("document_id", "key", F.array_sort("related").alias("related")).collect()
    assert sorted((r["document_id"], r["key"], r["related"]) for r in rows) == [(1, "alpha", []), (1, "gamma", ["alpha"]), (2, "delta", ["gamma"]), (2, "gamma", [])]


def seconds(df, of):
    df.agg(F.max(of)).collect()
    began = time.perf_counter()
    df.agg(F.max(of)).collect()
    return time.perf_counter() - began


def test_plain_texts_are_looked_at_before_they_are_changed(spark):
    df = spark.range(0, 200, 1, 2).select(F.repeat(F.lit("plain wörds und ein paar more\n"), 2000).alias("text")).cache()
    replaced = functools.reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), (text.MOJIBAKE | text.PLAIN_FORMS).items(), F.col("text"))
    unseen = F.translate(F.translate(replaced, text.QUOTES, text.QUOTES_PLAIN), text.FULL_WIDTH, text.FULL_WIDTH_PLAIN)
    assert seconds(df, F.length(text.plain_characters(F.col("text")))) < seconds(df, F.length(unseen))
    made = ["a b", "\x07a\u0085b", "ﬁn “so”", "ＡＢ​", "â\u0080\u0099s é ×", "", "ünï", "x·y"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in made], "text string").coalesce(1).select(text.plain_characters(F.col("text"))).collect()]
    assert got == ["a b", "ab", 'fin "so"', "AB", "'s é x", "", "ünï", "x y"]


def test_steps_behind_pieces_change_the_same(spark):
    parts = ["```py\nx\n```", "`code`", "# Head", "**bold**", "_it_", "![i](u)", "[l](u)", "> quote", "- item", "12. item", "-----", "a|b", "  two  \t spaces ", "plain", ""]
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([("\n".join(rng.choice(parts, int(rng.integers(0, 6)))),) for _ in range(400)], "text string")
    both = rows.select(text.clean_document(F.col("text"), True).alias("a"), text.each(F.col("text"), text.DOCUMENT_MARKDOWN).alias("m"))
    both = both.select("a", F.trim(F.regexp_replace(F.array_join(F.filter(F.transform(F.split("m", "\n", -1), lambda x: F.regexp_replace(x, rf"^{text.SPACE}+|{text.SPACE}+$", "")), lambda x: x != ""), "\n"), "[ \t]+", " ")).alias("b"))
    assert both.filter("a <> b").count() == 0
    rows = spark.range(0, 100, 1, 2).select(F.repeat(F.lit("plain words and a few more of them\n"), 2000).alias("text")).cache()
    assert seconds(rows, F.length(text.tidy_lines(F.col("text")))) < seconds(rows, F.length(F.regexp_replace("text", "[ \t]+", " "))) + seconds(rows, F.size(F.transform(F.split("text", "\n", -1), lambda x: F.regexp_replace(x, rf"^{text.SPACE}+|{text.SPACE}+$", ""))))


def test_long_definitions_cost_no_more_than_their_opening(spark):
    df = spark.range(0, 400, 1, 2).select(F.lit("Vector index").alias("label"), F.repeat(F.lit("structures finding similar embeddings quickly "), 4000).alias("long")).cache()
    df = df.withColumn("opening", F.substring("long", 1, 2000))
    assert seconds(df, text.restates(F.col("label"), F.col("long"))) < 10 * seconds(df, text.restates(F.col("label"), F.col("opening")))
    said = [("Vector index", "vector index " * 200 + end) for end in ("", "finds", "finds similar embeddings", "finds similar embeddings quickly")] + [("Vector index", "x" * 990 + " quickly finds similar embeddings")]
    got = [r[0] for r in spark.createDataFrame(said, "label string, definition string").select(text.restates(F.col("label"), F.col("definition"))).collect()]
    assert got == [True, True, True, False, False]
