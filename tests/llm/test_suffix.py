"""Suffix-array dedup against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsake.llm import suffix


def brute(rows, length=50):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 by looking at every string."""
    first: dict[bytes, int] = {}
    order = lambda i: suffix.LAST if i is None else i
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    for i, data in texts:
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            first[s] = min(first.get(s, suffix.LAST), order(i))
    out = []
    for i, data in texts:
        gone = np.zeros(len(data), dtype=bool)
        for p in range(len(data) - length + 1):
            if first[data[p : p + length]] < order(i):
                gone[p : p + length] = True
        kept = bytes(np.frombuffer(data, dtype=np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("kind", ["random", "zeros", "same", "period"])
def test_suffix_array_and_common_prefixes(kind):
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 8, 9, 63, 300, 2000):
        data = {"random": rng.integers(97, 100, n), "zeros": rng.integers(0, 2, n), "same": np.zeros(n), "period": np.arange(n) % 3}[kind].astype(np.uint8)
        raw = data.tobytes()
        order = suffix.suffix_array(data)
        assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])
        common = suffix.common_prefixes(data, order, most=50, stretches=16)
        for k in range(1, n):
            a, b = raw[order[k - 1] :], raw[order[k] :]
            real = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
            assert common[k] == real if real < 50 else common[k] >= 50


def test_words8_are_big_endian():
    assert suffix.words8(np.frombuffer(b"abcdefghij", dtype=np.uint8))[1] == int.from_bytes(b"bcdefghi", "big")


def rows_with_everything():
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdeé"), 4))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, line = text(30), text(14)
    rows = [(i, text(40)) for i in range(20)]
    rows += [(100 + i, text(10) + shared + text(8) + line) for i in range(12)]
    rows += [(200 + i, shared) for i in range(30)] + [(50, shared[:60]), (51, shared[3:53]), (52, shared[:49])]
    rows += [(300, None), (301, ""), (302, " "), (303, "x" * 400), (304, "x" * 49), (305, "x" * 50), (306, "xy" * 100), (307, "\0" * 120), (308, "a" + "\0" * 60)]
    rows += [(110, rows[25][1]), (310, text(3000)), (None, shared), (None, text(30)), (None, None)]
    rows += [(311, rows[-4][1][5000:9000]), (312, line + line)]
    rows += [(400 + i, f"{text(30)} a line of thirty bytes or so {text(30)}") for i in range(25)]
    return rows


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "src") for i, t in rows], "doc_id long, text string, lang string, source string")
    return docs


@pytest.mark.parametrize("hot", [2, 1000])  # strings of names of more than so many shards go by second names
def test_matches_brute_force(spark, monkeypatch, tmp_path, hot):
    monkeypatch.setattr(suffix.shared_names, "__defaults__", (hot,))
    monkeypatch.setattr(suffix, "SHARD_BYTES", 3000)
    monkeypatch.setattr(suffix.shards_of, "__defaults__", (3000,))
    rows = rows_with_everything()
    path = str(tmp_path)
    run(spark, rows).repartition(3).write.parquet(f"{path}/documents.parquet")
    got = sorted((tuple(r) for r in suffix.op1_suffix_array_dedup(spark, path).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_pairs_of_a_repeated_stretch_take_one_row():
    rng = np.random.default_rng(2)
    of, also = np.concatenate([np.arange(100, 5000)] * 3), np.concatenate([np.arange(n, n + 4900) for n in (6000, 12000, 20000)])
    by = rng.permutation(len(also))  # in the order of suffixes
    told = suffix.pair_runs(of[by], also[by])
    assert len(told) < 100  # 8 bytes a pair before: 117,600
    assert [x.tolist() for x in suffix.from_pair_runs(told)] == [of.tolist(), also.tolist()]
    assert [len(x) for x in suffix.from_pair_runs(suffix.pair_runs(of[:0], also[:0]))] == [0, 0]


def test_digest_clash_is_settled(spark, monkeypatch):
    real = suffix.Powers.rolling
    monkeypatch.setattr(suffix.Powers, "rolling", lambda self, data, size: real(self, data, size) & np.uint64(7) if self.base == suffix.Powers(suffix.SEED).base else real(self, data, size))
    data = np.frombuffer(bytes(range(60)) + bytes(range(60)), dtype=np.uint8)
    lists = [(np.arange(0, 11), np.full(11, 5)), (np.arange(60, 71), np.full(11, 3))]
    assert [x.tolist() for x in suffix.smallest_documents(lists, data)] == [[3] * 11, [3] * 11]


def test_empty_table(spark, tmp_path):
    run(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert suffix.op1_suffix_array_dedup(spark, str(tmp_path)).count() == 0


def test_stage_keeps_text_readable(spark):
    rows = rows_with_everything()
    docs = run(spark, rows).withColumn("n_chars", F.length("text").cast("long")).withColumn("bytes", F.lit(1)).withColumn("spans", F.lit(2))
    out = suffix.suffix_stage(spark, docs, "")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    found = out.collect()
    assert all(r["n_chars"] == len(r["text"] or "") for r in found)
    ids = [r["doc_id"] for r in found]
    assert 301 in ids and 300 in ids and 205 not in ids and {r["text"] for r in found if r["doc_id"] == 300} == {None}
