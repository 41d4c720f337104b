"""Retrieval and contexts against plain loops over whole tables; hops and reminders against theirs."""

import math
import os
from collections import defaultdict
from datetime import datetime, timedelta, timezone
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsake.adapters import Tables
from keepsake.functions.query import MAIN_ASKED, PROBLEM_ASKED, RESULTS_ASKED, analysed
from keepsake.operators import graph
from keepsake.plans import retrieve, text_queries
from keepsake.schema import AS_OF
from keepsake.streaming import reminders

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, DATA)


@pytest.fixture(scope="module")
def questions(t):
    """Those of the registered query, one in a document's scope, one of small talk and one that nothing answers."""
    rows = [r.asDict() for r in text_queries.vector_questions(t).collect()]
    vector = rows[0]["vector"]
    rows += [
        {"question_id": 9001, "user_id": 1, "text": "What does this document say about steel?", "vector": vector, "current_document": 6},
        {"question_id": 9002, "user_id": 2, "text": "hello", "vector": [-x for x in vector], "current_document": None},
        {"question_id": 9003, "user_id": 3, "text": "zzzqqq xxyyzz", "vector": [0.0] * len(vector), "current_document": None},
    ]
    schema = text_queries.vector_questions(t).schema
    return t.spark.createDataFrame([tuple(r[c] for c in schema.names) for r in rows], schema)


def clamp(x):
    return 0.0 if x is None or math.isnan(x) or math.isinf(x) else min(max(x, 0.0), 1.0)


def found_by_loop(t, questions):
    import re

    buckets = {r["bucket_id"]: r for r in t.buckets.collect()}
    vectors = {r["bucket_id"]: r["embedding"] for r in t.embeddings.collect()}
    items, near = defaultdict(list), defaultdict(list)
    for r in t.items.collect():
        items[r["bucket_id"]].append(r)
    for e in t.edges.collect():
        near[e["source_bucket_id"]].append((e["target_bucket_id"], e["confidence"]))
        near[e["target_bucket_id"]].append((e["source_bucket_id"], e["confidence"]))
    out = {}
    for q in analysed(questions).collect():
        terms = {re.sub(r"\s+", " ", re.sub(r"[%_\\]", " ", x.lower())).strip() for x in [*q["key_terms"], *q["expanded_terms"]]}
        terms = {x for x in terms if len(x) >= 2}
        own = {k: b for k, b in buckets.items() if b["user_id"] == q["user_id"]}
        norm = math.sqrt(sum(x * x for x in q["vector"]))
        similar = {}
        for k in own:
            v = vectors.get(k)
            length = math.sqrt(sum(x * x for x in v)) if v else 0
            if v and length and norm and (s := sum(a * b for a, b in zip(v, q["vector"], strict=True)) / length / norm) >= 0.15:
                similar[k] = s
        told = {k for k, b in own.items() if any(x in b["canonical"].lower() or any(x in f"{i['label']} {i['definition']}".lower() for i in items[k]) for x in terms)}
        first = lambda score, n: set(sorted(score, key=lambda k: (-round(score[k], 9), k))[:n])
        weight = {k: own[k]["importance"] + own[k]["strength"] for k in told}
        a, b = first(similar, 80), first(weight, 80)
        score = {k: [similar[k] if k in a else 0.0, 1.0 if k in b else 0.0, 0] for k in a | b}
        seeds = first({k: v[0] + 0.2 * v[1] for k, v in score.items()}, 12)
        hits, best = defaultdict(int), defaultdict(float)
        for k in seeds:
            for other, confidence in near[k]:
                if other not in seeds:
                    hits[other] += 1
                    best[other] = max(best[other], confidence)
        for k in first(best, 40):
            score.setdefault(k, [0.0, 0.0, 0])[2] = hits[k]
        if q["is_abstract"]:
            for k in first({k: b["importance"] + b["strength"] for k, b in own.items() if b["importance"] >= 8}, 12):
                score.setdefault(k, [0.0, 0.0, 0])
        rows = []
        for k in first({k: v[0] + 0.25 * v[1] + 0.05 * v[2] for k, v in score.items()}, 80):
            if k not in buckets:
                continue
            b, (v, x, h) = buckets[k], score[k]
            days = (AS_OF - b["last_accessed"]).total_seconds() / 86400 if b["last_accessed"] else 999.0
            rate = 0.10 if b["importance"] >= 8 else 0.20 if b["importance"] <= 3 else 0.15
            now = clamp(b["strength"] * (1 - rate) ** days)
            if q["document_scoped"] and q["current_document"] is not None and b["document_id"] != q["current_document"] and not h:
                continue
            if now < 0.1 and not q["document_scoped"]:
                continue
            longest = max(items[k], key=lambda i: (len(i["definition"]), -i["item_id"]), default=None)
            definition, source = (longest["definition"], min(i["source"] for i in items[k])) if longest else (None, "")
            known = [(o, c) for o, c in near[k] if o in buckets]
            cross = {o for o, _ in known if buckets[o]["document_id"] is not None and buckets[o]["document_id"] != b["document_id"]}
            connected = clamp(0.45 * min(1, len({o for o, _ in known}) / 8) + 0.25 * min(1, len(cross) / 4) + 0.2 * sum(c for _, c in known) / len(known)) if known else 0.0
            raw = 0.5 * clamp(v) + 0.3 * x + 0.2 * min(1, 0.25 * h)
            semantic = clamp(raw * 1.15 if b["concept_type"] in q["preferred_types"] else raw)
            recency = math.exp(-0.1 * days * 24) if b["last_accessed"] else 0.3
            asked = " ".join(q["key_terms"])
            whole, name = q["is_abstract"] or re.search(MAIN_ASKED, asked), b["canonical"].lower()
            imp, kind = b["importance"], b["concept_type"]
            boost = 0.35 if whole and imp >= 9 else 0.25 if whole and imp >= 8 else 0.15 if whole and imp >= 7 else 0.2 if (re.search(RESULTS_ASKED, asked) and kind == "fact" and imp >= 8) or (re.search(PROBLEM_ASKED, asked) and kind == "problem" and imp >= 8) else 0.1 if imp >= 9 else 0.0
            if whole and any(w in name for w in ("overview", "summary", "introduction", "abstract", "preface")):
                boost += 0.3 if imp >= 8 else 0.15
            if q["document_scoped"] and q["current_document"] is not None and b["document_id"] == q["current_document"]:
                boost += 0.1
            n = sum(2 if term in name else 1 if term in (definition or "").lower() else 0 for term in [*q["key_terms"], *q["expanded_terms"]])
            boost += 0.15 if n >= 6 else 0.1 if n >= 4 else 0.05 if n >= 2 else 0.0
            if name in ("introduction", "conclusion", "summary", "overview", "background", "related work", "methodology", "discussion", "references", "acknowledgments"):
                boost -= 0.05
            elif kind == "fact" and imp <= 3 and len(definition or "") < 30:
                boost -= 0.03
            total = 0.45 * semantic + 0.30 * now + 0.25 * recency + 0.12 * connected + boost
            rows.append({"id": k, "raw": total, "kind": kind, "name": b["canonical"], "definition": definition or "", "now": now, "source": source, "connected": connected, "semantic": semantic, "text": x})
        rows.sort(key=lambda r: (-round(r["raw"], 9), r["id"]))
        if rows:
            top, spread = rows[0]["raw"], rows[0]["raw"] - min(r["raw"] for r in rows)
            shares = [math.exp((r["raw"] - top) / max(spread, 0.1)) for r in rows]
            for place, (r, s) in enumerate(zip(rows, shares, strict=True), 1):
                r["rank"], r["relevance"] = place, math.floor((s / sum(shares) if spread >= 0.001 else 1 / len(rows)) * 10000 + 0.5) / 10000
        out[q["question_id"]] = (q, rows[:20])
    return out


@pytest.fixture(scope="module")
def expected(t, questions):
    return found_by_loop(t, questions)


def test_retrieval_equals_a_loop(t, questions, expected):
    rows = defaultdict(list)
    for r in retrieve.retrieve(t, questions, AS_OF).collect():
        rows[r["question_id"]].append((r["rank"], r["bucket_id"], r["relevance"]))
    assert sum(map(len, rows.values())) > 100 and set(rows) == {k for k, (_, found) in expected.items() if found}
    for k, (_, found) in expected.items():
        got = sorted(rows.get(k, []))
        assert [g[1] for g in got] == [r["id"] for r in found], k
        assert all(abs(g[2] - r["relevance"]) <= 0.0001 for g, r in zip(got, found, strict=True))


def chosen_by_loop(rows, budget):
    picked, rest = [], []
    for r in sorted(rows, key=lambda r: (-r["relevance"], r["id"])):
        own = sum(p["source"] == r["source"] for p in picked)
        if len(picked) >= budget or r["relevance"] < 0.015 or (own >= math.ceil(budget * 0.6) and len(picked) > 2):
            rest.append(r)
        else:
            picked.append(r)
    if len(picked) >= 2 and len({p["kind"] for p in picked}) < 2:
        other = [r for r in rest if r["kind"] != picked[0]["kind"]]
        picked = picked[:-1] + other[:1] if other else picked
    return sorted(picked, key=lambda r: r["rank"])


def test_contexts_equal_a_loop(t, questions, expected):
    got = {r["question_id"]: r for r in retrieve.assemble(retrieve.retrieve(t, questions, AS_OF)).collect()}
    contexts = {}
    for k, (q, rows) in expected.items():
        direct = any(r["semantic"] >= 0.12 or r["text"] >= 0.5 for r in rows)
        if q["is_chitchat"] or not rows or not (direct or q["is_abstract"] or (q["intent"] in ("recall", "explore", "summarize") and q["specificity"] < 0.4)):
            continue
        most = 12 if q["specificity"] > 0.8 else 16 if q["specificity"] > 0.5 else 20
        lines = []
        for r in chosen_by_loop(rows, max(1, min(most, len(rows)))):
            line = f"({r['rank']}) [{r['kind'].upper()}] {r['name']}: {r['definition']} [strength: {math.floor(r['now'] * 100 + 0.5)}%]"
            line += f" [source: {r['source']}]" if r["source"] else ""
            lines.append(line + (f" [connection: {Decimal(repr(round(r['connected'], 12))).quantize(Decimal('0.01'), ROUND_HALF_UP)}]" if r["connected"] > 0 else ""))
        contexts[k] = (len(lines), "\n".join(["=== RETRIEVED MEMORIES FROM THE USER'S KNOWLEDGE BASE ===", "", *lines, "", "=== END OF CANDIDATE MEMORIES ==="]))
    assert len(contexts) > 5 and 9002 not in contexts
    assert {k: (r["memories"], r["context"]) for k, r in got.items()} == contexts


def test_nothing_runs_before_the_result_is_asked_for(t, questions):
    tracker = t.spark.sparkContext.statusTracker()
    t.edges, t.items, t.buckets, t.embeddings  # noqa: B018  the tables' schemas are read
    t.spark.sparkContext.setJobGroup("building", "building")
    try:
        df = retrieve.assemble(retrieve.retrieve(t, questions, AS_OF))
        assert len(tracker.getJobIdsForGroup("building")) == 0
        assert df.count() > 0
    finally:
        t.spark.sparkContext.setJobGroup("", "")


def hops_by_loop(edges, seeds, depth, per_hop):
    near = defaultdict(list)
    for a, b, c in edges:
        near[a].append((b, c))
        near[b].append((a, c))
    seen = dict.fromkeys(seeds, 0)
    last = set(seeds)
    for hop in range(1, depth + 1):
        best = {}
        for x in last:
            for y, c in near[x]:
                if y not in seen:
                    best[y] = max(best.get(y, 0), c)
        last = set(sorted(best, key=lambda y: (-best[y], y))[:per_hop])
        seen |= dict.fromkeys(last, hop)
    return seen


@pytest.mark.parametrize("per_hop", [7, 100])
def test_six_hops_equal_a_loop(t, per_hop):
    edges = [(r["source_bucket_id"], r["target_bucket_id"], r["confidence"]) for r in t.edges.collect()]
    found = graph.hops(t.edges, t.buckets.filter("bucket_id < 3"), 6, per_hop)
    assert {r["bucket_id"]: r["hop"] for r in found.collect()} == hops_by_loop(edges, range(3), 6, per_hop)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("\n") < 5


def walked(rows, hours):
    out = []
    for user in sorted({r[0] for r in rows}):
        last = None
        for at, bucket in sorted((r[2], r[1]) for r in rows if r[0] == user):
            if last is None or at - last > timedelta(hours=hours):
                out.append((user, bucket, at))
                last = at
    return sorted(out)


@pytest.mark.parametrize("seed, hours, span", [(0, 24, 90), (1, 5, 20), (2, 24, 3)])
def test_reminders_equal_a_walk(spark, seed, hours, span):
    rng = np.random.default_rng(seed)
    start = datetime(2024, 3, 1, tzinfo=timezone.utc)
    rows = [(int(u), int(rng.integers(0, 9)), start + timedelta(seconds=int(x))) for u, n in ((1, 3000), (2, 40), (3, 1), (4, 2)) for x in rng.integers(0, span * 86400, n)]
    rows += [(5, 1, start + timedelta(hours=hours * i)) for i in range(60)] + [(5, 0, start), (6, 3, start), (6, 3, start)]
    df = spark.createDataFrame(rows, "user_id long, bucket_id long, ts timestamp")
    got = sorted((r["user_id"], r["bucket_id"], r["ts"].replace(tzinfo=timezone.utc)) for r in reminders.reminded_batch(df, hours).collect())
    assert got == walked(rows, hours)
    assert reminders.reminded_batch(df.limit(0)).count() == 0
