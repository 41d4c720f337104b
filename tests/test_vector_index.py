"""The stored index of vectors: recall against brute force, what is read, and what removing and adding leave."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsake.adapters import Tables
from keepsake.operators.vector_index import VectorIndex
from keepsake.sources.store import Store

DATA = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, DATA)


@pytest.fixture(scope="module")
def index(t, tmp_path_factory):
    made = VectorIndex(Store(t.spark, str(tmp_path_factory.mktemp("vectors"))), "v")
    made.fit(t.embeddings, lists=32)
    made.add(t.embeddings.filter("bucket_id % 2 = 0"))
    made.add(t.embeddings.filter("bucket_id % 2 = 1"))
    return made


@pytest.fixture(scope="module")
def truth(t):
    rows = t.embeddings.collect()
    ids, vectors = np.array([r["bucket_id"] for r in rows]), np.array([r["embedding"] for r in rows])
    return ids, vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def asked(t):
    return t.embeddings.filter("bucket_id % 50 = 0").select(F.col("bucket_id").alias("question_id"), F.col("embedding").alias("vector"))


def recall(found, truth, k=10):
    ids, vectors = truth
    hit = total = 0
    for q in {r["question_id"] for r in found}:
        close = vectors @ vectors[np.flatnonzero(ids == q)[0]]
        best = set(ids[np.lexsort((ids, -np.round(close, 9)))[:k]].tolist())
        hit, total = hit + len(best & {r["bucket_id"] for r in found if r["question_id"] == q}), total + k
    return hit / total


def test_every_vector_is_in_one_list(t, index):
    assert index.rows().count() == index.rows().select("bucket_id").distinct().count() == t.embeddings.count()


@pytest.mark.parametrize("probes, least", [(20, 0.9), (32, 0.999)])
def test_recall(t, index, truth, probes, least):
    found = index.search(asked(t), 10, probes, t.embeddings).collect()
    assert len(found) == 10 * asked(t).count() and recall(found, truth) >= least
    by_codes = index.search(asked(t), 10, probes).collect()
    assert recall(by_codes, truth) >= least - 0.05 and all(abs(r["similarity"]) <= 1.01 for r in by_codes)


def test_few_probes_find_neighbours_in_groups(spark, tmp_path):
    """The given vectors have no groups; where there are some, two lists of 32 hold the neighbours."""
    rng = np.random.default_rng(1)
    middle = rng.normal(0, 1, (24, 16))
    vectors = middle[rng.integers(0, 24, 1500)] + rng.normal(0, 0.1, (1500, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "bucket_id long, embedding array<double>")
    made = VectorIndex(Store(spark, str(tmp_path)), "v")
    made.fit(df, lists=32)
    made.add(df)
    found = made.search(df.filter("bucket_id % 50 = 0").select(F.col("bucket_id").alias("question_id"), F.col("embedding").alias("vector")), 10, 2, df).collect()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    assert len(found) == 300 and recall(found, (np.arange(1500), unit)) >= 0.9


def test_only_probed_lists_are_read(t, index):
    one = asked(t).filter("question_id = 100")
    plan = index.search(one, 5, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan.replace("isnotnull", "list") and plan.count("INSET") == 0
    assert index.search(one, 5, 2).count() == 5 and index.search(one.limit(0), 5, 2).count() == 0


def test_removed_and_reconciled(t, spark, tmp_path, truth):
    made = VectorIndex(Store(spark, str(tmp_path)), "v")
    some = t.embeddings.filter("bucket_id < 300")
    made.fit(some, lists=40, most=100)
    made.add(some)
    before = {r["list"] for r in made.rows().select("list").distinct().collect()}
    alone = made.rows().groupBy("list").count().orderBy("count", "list").first()["list"]
    gone = made.rows().filter(F.col("list") == alone).select("bucket_id")
    gone = spark.createDataFrame(gone.collect(), "bucket_id long")
    made.remove(gone)
    made.remove(gone)
    assert made.rows().count() == 300 - gone.count() and {r["list"] for r in made.rows().select("list").distinct().collect()} == before - {alone}
    buckets = spark.range(100, 400).withColumnRenamed("id", "bucket_id")
    made.reconcile(buckets, t.embeddings)
    assert sorted(r["bucket_id"] for r in made.rows().select("bucket_id").collect()) == list(range(100, 400))
    with pytest.raises(ValueError):
        made.search(spark.range(1001).select(F.col("id").alias("question_id"), F.array(*[F.lit(1.0)] * 64).alias("vector")), 1, 1)
