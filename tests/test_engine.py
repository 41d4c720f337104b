"""Registered queries against their SQL, and invariants of operators that SQL doesn't state."""

import os
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__  # noqa: E402

from keepsake.adapters import Tables  # noqa: E402
from keepsake.operators import correlate, graph, knn, lifecycle, merge, scoring  # noqa: E402
from keepsake.plans import catalog, retrieve, text_queries  # noqa: E402
from keepsake.schema import AS_OF  # noqa: E402

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, DATA)


def settled(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    found = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert settled(df.select(columns).collect()) == settled(found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert __spark_entry__.queries()[name](spark, DATA).limit(1).count() == 1


def test_relevance_adds_up(t):
    ranked = scoring.softmax_ranked(scoring.raw_relevance(text_queries.candidates(t), AS_OF), most=None)
    sums = ranked.groupBy("question_id").agg(F.sum("relevance").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    assert sums and all(abs(r["s"] - 1) <= 0.0001 * r["n"] for r in sums)


def test_tiers_are_a_partition(t):
    row = lifecycle.tier_counts(t.buckets).first()
    assert sum(row) == t.buckets.filter("strength > 0").count()


def greedy(items, budget):
    """The choice stated as a loop."""
    chosen, rest = [], []
    for x in sorted(items, key=lambda x: (-x["relevance"], x["bucket_id"])):
        own = sum(c["source"] == x["source"] for c in chosen)
        if len(chosen) >= budget or x["relevance"] < 0.015 or (own >= -(-budget * 6 // 10) and len(chosen) > 2):
            rest.append(x)
        else:
            chosen.append(x)
    if len({c["concept_type"] for c in chosen}) < 2 <= len(chosen):
        other = [x for x in rest if x["concept_type"] != chosen[0]["concept_type"]]
        chosen = chosen[:-1] + other[:1] if other else chosen
    return {c["bucket_id"] for c in chosen}


def test_budget_equals_loop(spark):
    rows = [(q, i, ((i * 37 + q * 11) % 100) / 100, f"t{(i * q) % (1 + q % 3)}", f"s{i % (1 + q)}") for q in range(6) for i in range(30)]
    df = spark.createDataFrame(rows, "question_id long, bucket_id long, relevance double, concept_type string, source string").withColumn("budget", F.lit(7))
    found = {}
    for r in scoring.within_budget(df).collect():
        found.setdefault(r["question_id"], set()).add(r["bucket_id"])
    for q in range(6):
        assert found[q] == greedy([dict(bucket_id=r[1], relevance=r[2], concept_type=r[3], source=r[4]) for r in rows if r[0] == q], 7)


def test_upsert_twice_changes_nothing_more(t):
    old = merge.merged_buckets(t.buckets)
    fresh = t.buckets.limit(20).select("user_id", "canonical", "importance", F.col("canonical").alias("definition"), F.col("bucket_id").alias("ordinal"))
    once = merge.upsert_buckets(old, fresh, AS_OF)
    assert once.count() == old.count() and once.filter("action = 'created'").count() == 0


def test_hops_are_reachable(t):
    seeds = t.buckets.filter("bucket_id = 5")
    found = {r["bucket_id"] for r in graph.hops(t.edges, seeds, 3).collect()}
    near = {}
    for r in t.edges.collect():
        near.setdefault(r["source_bucket_id"], set()).add(r["target_bucket_id"])
        near.setdefault(r["target_bucket_id"], set()).add(r["source_bucket_id"])
    reach = {5}
    for _ in range(3):
        reach |= {y for x in reach for y in near.get(x, ())}
    assert found <= reach


def test_tenants_do_not_mix(t):
    own = {r[0] for r in t.buckets.filter("user_id = 2").select("bucket_id").collect()}
    questions = text_queries.vector_questions(t).withColumn("user_id", F.lit(2).cast("long"))
    from keepsake.functions.query import analysed

    found = retrieve.direct_hits(t, retrieve.held(analysed(questions))).select("bucket_id").distinct().collect()
    assert found and all(r[0] in own for r in found)


def test_exact_links_need_both_sides(t):
    rows = correlate.exact_links(t.buckets, t.documents.filter("document_id < 5")).collect()
    assert all(r["document_id"] < 5 and r["document_id"] != r["related_id"] for r in rows)


def test_approximate_neighbours_recall(t):
    rows = [r for r in t.embeddings.select("bucket_id", "embedding").collect() if r[1] and None not in r[1]]
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    asked = np.flatnonzero(ids % 10 == 0)
    close = vectors[asked] @ vectors.T
    true = {(int(ids[asked[a]]), int(ids[b])) for a, b in zip(*np.nonzero(close >= 0.2 + 1e-9), strict=True) if asked[a] != b}
    found = {(r[0], r[1]) for r in knn.approximate(t.embeddings.filter("bucket_id % 10 = 0"), t.embeddings, 0.2 - 1e-9).collect()}
    assert len(true) > 20 and len(found & true) >= 0.9 * len(true)
    assert all(close[np.flatnonzero(ids[asked] == a)[0], np.flatnonzero(ids == b)[0]] >= 0.2 - 1e-6 for a, b in found)


def test_too_many_questions_are_refused(t):
    asked = t.spark.range(5).select(F.col("id").alias("question_id"), F.lit(1).cast("long").alias("user_id"))
    assert retrieve.held(asked, most=5).count() == 5
    with pytest.raises(Exception, match="more than 3 questions"):
        retrieve.held(asked, most=3).collect()


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["question_id", "bucket_id", "relevance", "rank"]
