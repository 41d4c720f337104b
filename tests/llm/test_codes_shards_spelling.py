"""Sharding, vector codes and spelling variants against plain loops."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsake.llm import sharding, spelling, vector_codes

# ---------------------------------------------------------------- sharding


def permuted(value, n, seed):
    """The same network and walk with Python's integers."""
    a, b = sharding.digits(n)
    f = lambda r, d: int(hashlib.md5(f"{seed}:{r}:{d}".encode()).hexdigest()[:15], 16)
    while True:
        x, y = divmod(value, b)
        for r in range(sharding.ROUNDS):
            if r % 2 == 0:
                x = (x + f(r, y)) % a
            else:
                y = (y + f(r, x)) % b
        value = x * b + y
        if value < n:
            return value


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 97, 1000, 4999])
def test_the_permutation_is_one_and_turns_back(spark, n):
    got = spark.range(n).select("id", sharding.position(F.col("id"), n).alias("p")).withColumns({"shard": F.col("p") % 24, "slot": sharding.quotient(F.col("p"), 24)})
    rows = got.select("id", "p", sharding.number_at(F.col("shard"), F.col("slot"), n).alias("back")).collect()
    assert sorted(r["p"] for r in rows) == list(range(n))
    assert all(r["back"] == r["id"] and r["p"] == permuted(r["id"], n, sharding.SEED) for r in rows)


def sharded_by_loop(rows):
    digests = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows]
    order = sorted(digests, key=lambda d: (d[0] is None, d[0] or 0, d[1], d[2]))
    places = [permuted(k, len(order), sharding.SEED) for k in range(len(order))]
    return sorted(((*d, "rows", p % 24, p // 24, None) for d, p in zip(order, places, strict=True)), key=str)


ODD = [(7, None), (8, ""), (9, "é́ \U0001f600"), (10, "x" * 1_500_000), (11, "same"), (11, "same"), (11, "other"), (None, "a"), (None, None), (-3, "negative"), (2**62, "far")]


@pytest.mark.parametrize("rows", [[], ODD, [(1, "equal")] * 3000 + ODD, [(i % 700, f"text {i % 13}") for i in range(2000)]])
def test_sharding_equals_a_loop(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"shard": F.lit("x"), "slot": F.lit("y"), "row_number": F.lit("z"), "size": F.lit("s"), "n": F.lit(1)})
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op11_feistel_sharding(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sharded_by_loop(rows)
    counts = Counter(r["shard"] for r in got)
    assert not rows or max(counts.values()) - min(counts[s] for s in range(24)) <= 1


def test_sharding_carries_texts_and_changes_with_the_seed(spark):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(100)], "id long, text string").withColumn("slot", F.lit("old"))
    one, other = (sharding.sharded(rows, ["id"], 7, seed).collect() for seed in (1, 2))
    assert all(r["text"] == f"text {r['id']}" and r["row_number"] == r["id"] for r in one)
    assert {(r["id"], r["shard"], r["slot"]) for r in one} != {(r["id"], r["shard"], r["slot"]) for r in other}


# ---------------------------------------------------------------- vector codes


def codes_by_loop(rows):
    kept = [(i, [int(np.floor(np.float64(x) * 4096)) if abs(x) < 1e12 else int(x) * 4096 for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dims = -(-max((len(v) for _, v, _ in kept), default=0) // 8) * 8
    kept = [(i, v + [0] * (dims - len(v)), label) for i, v, label in kept]
    width = dims // 8
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:16]
    books = [[r[1][p * width : (p + 1) * width] for r in first] for p in range(8)]

    def assign():
        out = []
        for _, v, _ in kept:
            found = [min((sum((a - b) ** 2 for a, b in zip(v[p * width : (p + 1) * width], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(8)]
            out.append(found)
        return out

    for _ in range(6):
        for p in range(8):
            taken = defaultdict(list)
            for (_, v, _), found in zip(kept, assigned := assign(), strict=True):
                taken[found[p][1]].append(v[p * width : (p + 1) * width])
            assigned = {k: [sum(x) // len(vs) for x in zip(*vs, strict=True)] for k, vs in taken.items()}
            books[p] = [assigned.get(k, e) for k, e in enumerate(books[p])]
    final = assign()
    most = 2**63 - 1
    errors = [min(most, sum(d for d, _ in found)) for found in final]
    by_label = defaultdict(int)
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in found), e, min(most, by_label[label]), sha) for (i, _, label), found, e in zip(kept, final, errors, strict=True)), key=str)


def vectors(spark, path, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"code": F.lit("x"), "error": F.lit(1), "v": F.lit("v"), "sums": F.lit(0)})
    df.repartition(3).write.parquet(f"{path}/embeddings.parquet")


def single(x):
    return float(np.float32(x))


RNG = np.random.default_rng(7)
CLOUD = [(i, [single(x) for x in RNG.normal(0, 0.2, 16)], int(RNG.integers(0, 3)) if i % 7 else None) for i in range(120)]
BAD = [(500, None, 1), (501, [1.0] * 15 + [None], 1), (502, [float("nan")] + [0.0] * 15, 2), (503, [float("inf")] + [0.0] * 15, 2), (None, [0.5] * 16, None), (5, [0.25] * 16, 9), (5, [-0.25] * 16, 9), (504, [0.1] * 3, 1), (505, [], 1)]
BAD = [(i, v and [x if x is None else single(x) for x in v], label) for i, v, label in BAD]


@pytest.mark.parametrize("rows", [[], CLOUD + BAD, CLOUD[:5] + BAD, [(i, [1.0] * 8, 1) for i in range(40)], [(i, [float(i % 2)] * 8, i % 2) for i in range(40)], CLOUD[:30] + [(600, [single(1e30)] + [0.0] * 15, 1), (601, [single(-3e38)] * 16, 2)], [(1, [], 1), (2, [], None)]])
def test_codes_equal_a_loop(spark, tmp_path, rows):
    vectors(spark, tmp_path, rows)
    got = vector_codes.op12_vector_codes(spark, str(tmp_path))
    assert sorted((tuple(r) for r in got.collect()), key=str) == codes_by_loop(rows)


def test_codes_stand_for_their_entries(spark, tmp_path):
    vectors(spark, tmp_path, CLOUD)
    rows, books = vector_codes.compressed(spark.read.parquet(f"{tmp_path}/embeddings.parquet"))
    by_id = {i: np.array(v) for i, v, _ in CLOUD}
    for r in rows.select("vec_id", "code", "error", vector_codes.decoded(F.col("code"), books).alias("back")).collect():
        assert r["back"] == [x / 4096 for p in range(8) for x in books[p][r["code"][p]]]
        assert abs(((by_id[r["vec_id"]] - np.array(r["back"])) ** 2).sum() - r["error"] / 4096**2) < 0.01


@pytest.mark.parametrize("seed", range(4))
def test_the_radius_loses_no_nearer_entry(seed):
    rng = np.random.default_rng(seed)
    points, book = rng.integers(-20, 20, (500, 3)), rng.integers(-20, 20, (16, 3))
    book[3] = book[9]
    index, best = vector_codes.nearest(points, book, rng.integers(0, 16, 500))
    every = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()


# ---------------------------------------------------------------- spelling


def spelled_by_loop(rows, least=2, times=10):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= least}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
        return b[k + 1 :] == a[k:]

    by = defaultdict(list)
    for a, b in itertools.combinations(n, 2):
        if near(a, b):
            by[a].append(b)
            by[b].append(a)
    form = {}
    for w in n:
        best = min(by[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(by[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def spelling_rows():
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("abcdeéüß"), int(rng.integers(7, 11)))) for _ in range(25)]
    words = [w for k, w in enumerate(base) for _ in range(2 + 40 * (k % 3))]
    for w in base:
        for _ in range(6):
            p = int(rng.integers(0, len(w)))
            words += [w[:p] + w[p + 1 :], w[:p] + "x" + w[p:], w[:p] + "Q" + w[p + 1 :]] * 2
    chain = ["tenletters", "tenletterss", "tenlettersst", "tenlettersstu"]
    words += [chain[0]] * 2 + [chain[1]] * 25 + [chain[2]] * 300 + [chain[3]] * 4000
    order = rng.permutation(len(words))
    return [(d, " ".join(words[k] for k in part)) for d, part in enumerate(np.array_split(order, 40))]


EDGES = [(90, None), (91, ""), (91, ""), (None, "nullable nullable Nullable"), (None, "nullable"), (92, "repeated repeated"), (92, "repeated repeated"), (93, "ÀÉÎõüÿÀ ÀÉÎõüÿÀ àéîõüÿà"), (94, "combíning combíning"), (95, "a1b2c3 sevenup7sevenup sevenup"), (96, "longword" * 20_000 + " " + "longword" * 20_000), (97, "longword" * 20_000 + "s " + "longword" * 20_000 + "s")]


@pytest.mark.parametrize("rows", [[], EDGES, spelling_rows() + EDGES[:-2]])
def test_spelling_equals_a_loop(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("w"), "n": F.lit(1), "run": F.lit("r"), "id": F.lit("i")})
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = spelling.op13_spelling_variants(spark, str(tmp_path)).collect()
    expected = spelled_by_loop(rows)
    assert sorted((tuple(r) for r in got), key=str) == expected
    if len(rows) > 40:
        assert {r["root"] for r in got if r["word"] in ("tenletters", "tenletterss")} == {"tenlettersstu"}


@pytest.mark.parametrize("usual", [0, 64])
def test_one_edit(spark, monkeypatch, usual):
    monkeypatch.setattr(spelling, "USUAL", usual)
    rng = np.random.default_rng(11)
    rows = []
    for _ in range(400):
        a = "".join(rng.choice(list("abé"), int(rng.integers(1, 12))))
        k, kind = int(rng.integers(0, len(a) + 1)), int(rng.integers(0, 4))
        b = [a[:k] + "b" + a[k:], a[:k] + "b" + a[k + 1 :], a[:k] + "ab" + a[k + 1 :], "".join(rng.choice(list("abé"), len(a)))][kind]
        if a != b and len(a) <= len(b):
            rows.append((a, b))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", spelling.one_edit(F.col("a"), F.col("b")).alias("is"), (F.levenshtein("a", "b") == 1).alias("expected")).collect()
    assert all(r["is"] == r["expected"] for r in got) and len({r["is"] for r in got}) == 2
