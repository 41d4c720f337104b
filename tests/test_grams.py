"""Searches by postings against LIKE over every text."""

import os
import re

import pytest
from pyspark.sql import functions as F

from keepsake.adapters import Tables
from keepsake.operators import grams, search
from keepsake.sources.store import Store

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
TEXTS = [(1, "Steel Gear", "of the OLD kind"), (2, None, "steelgear"), (3, "", None), (4, "ab", "st"), (5, "Straße ÀÉ", "100% off_now"), (6, "steel  gear", "\U0001f600\U0001f600\U0001f601 smile"), (7, "STEEL", "gear steel")]
TERMS = ["steel", "STEEL gear", "eel", "st", "", "%", "old kind", "kind of", "100%", "off_now", "st%ar", "straße", "ÀÉ", "\U0001f600\U0001f600\U0001f601", "zzz", "ee_ g", "a\\b"]


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, DATA)


@pytest.fixture(scope="module")
def index(t, tmp_path_factory):
    made = grams.TextIndex(Store(t.spark, str(tmp_path_factory.mktemp("index"))), "items", "item_id", ["label", "definition"], parts=16)
    made.add(t.items.filter("item_id % 3 <> 0"))
    made.add(t.items.filter("item_id % 3 = 0"))
    return made


@pytest.mark.parametrize("term", [x for x in TERMS if "\\" not in x])
def test_matches_are_those_of_like(spark, tmp_path, term):
    rows = spark.createDataFrame(TEXTS, "id long, a string, b string")
    made = grams.TextIndex(Store(spark, str(tmp_path)), "t", "id", ["a", "b"], parts=4)
    made.add(rows)
    found = sorted(r["id"] for r in made.matching(rows, term).collect())
    assert found == sorted(r["id"] for r in rows.filter(F.col("a").ilike(f"%{term}%") | F.col("b").ilike(f"%{term}%")).collect())


def test_changed_and_deleted_texts_are_not_found(spark, tmp_path):
    rows = spark.createDataFrame(TEXTS, "id long, a string, b string")
    made = grams.TextIndex(Store(spark, str(tmp_path)), "t", "id", ["a", "b"], parts=4)
    made.add(rows)
    now = rows.filter("id <> 1").withColumn("a", F.when(F.col("id") == 7, "iron").otherwise(F.col("a"))).withColumn("b", F.when(F.col("id") == 7, "bolt").otherwise(F.col("b")))
    made.add(now.filter("id = 7"))
    assert [r["id"] for r in made.matching(now, "steel").orderBy("id").collect()] == [2, 6] and [r["id"] for r in made.matching(now, "bolt").collect()] == [7]


@pytest.mark.parametrize("text", ["ring", "the ", "again", "noted", "qqqq", "an"])
def test_searches_equal_those_of_all_texts(t, index, text):
    assert grams.by_text(index, t.buckets, t.items, text).collect() == search.by_text(t.buckets, t.items, text).collect()
    assert grams.by_terms(index, t.buckets, t.items, [text, "bolt"], 2).collect() == search.by_terms(t.buckets, t.items, [text, "bolt"], 2).collect()


def test_only_the_runs_parts_are_read(index):
    plan = index.candidates("bolt")._jdf.queryExecution().executedPlan().toString()
    parts = re.search(r"PartitionFilters: \[[^\]]*part#\d+ IN \(([^)]*)\)|PartitionFilters: \[[^\]]*part#\d+ = (\d+)", plan)
    assert parts and len((parts[1] or parts[2]).split(",")) <= 2 and re.search(r"PushedFilters: \[[^\]]*In\(gram", plan)


def test_texts_are_read_from_their_parts(t, index):
    index.store.change("texts", t.items, ["item_id"], lambda old, new: old.unionByName(new), parts=32)
    term = next(r["definition"] for r in t.items.orderBy("item_id").collect() if len(r["definition"]) > 60)[20:50]
    found = index.matching("texts", term)
    expected = search.like("label", [term]) | search.like("definition", [term])
    assert sorted(r["item_id"] for r in found.collect()) == sorted(r["item_id"] for r in t.items.filter(expected).collect()) != []
    assert re.search(r"part_of_32#\d+ (IN|=)", found._jdf.queryExecution().executedPlan().toString())
