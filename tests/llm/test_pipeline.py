"""The corpus pipeline against a version of loops: what each stage keeps is computed plainly, from the stage before."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from keepsake.llm import mixing, packing, toxicity
from keepsake.llm.suffix import LAST

from .test_operators import near_free


def corpus(spark, path):
    """Documents with copies, near copies, a shared passage, toxic ones, null and empty ones, and labels."""
    rng = np.random.default_rng(11)
    words = lambda n: [f"{'plain' if rng.random() < 0.5 else 'clean'}{x}" for x in rng.integers(0, 400, n)]
    passage = " ".join(words(60))
    rows, labels = [], []
    for i in range(420):
        text = words(70)
        toxic = i % 4 == 0
        if toxic:
            text[30:34] = ["vileword", "nastyterm", "hatefulthing", "vileword"]
        if i % 10 == 1:
            text = [*text, passage]
        rows.append((i, " ".join(text), "en", f"s{i % 3}"))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, rows[4 * i + 1][1], "en", "s1") for i in range(20)]  # copies
    rows += [(1100 + i, rows[4 * i + 2][1] + " end", "en", "s2") for i in range(20)]  # near copies
    rows += [(1200, None, "en", "s0"), (1201, "", "en", None), (1202, "é " * 40, "fr", "s0"), (1202, "é " * 40, "fr", "s0"), (None, "without id", "en", "s1")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs


def without_repeats(rows, length=50):
    first: dict[bytes, int] = {}
    ids = [LAST if r[0] is None else r[0] for r in rows]
    for i, r in zip(ids, rows, strict=True):
        data = (r[1] or "").encode()
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            first[s] = min(first.get(s, LAST), i)
    out = []
    for i, r in zip(ids, rows, strict=True):
        data = (r[1] or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for p in range(len(data) - length + 1):
            if first[data[p : p + length]] < i:
                gone[p : p + length] = True
        kept, at = "", 0
        for c in r[1] or "":  # a character stays unless it is covered whole
            n = len(c.encode())
            kept += "" if gone[at : at + n].all() else c
            at += n
        if kept or not r[1]:
            out.append((r[0], None if r[1] is None else kept, *r[2:4], len(kept)))
    return out


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = corpus(spark, path)
    found, after = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        from keepsake.llm.common import written

        found = written(stage(spark, found, path), name.replace(" ", "-"))
        after[name] = found
    return docs, path, after


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=str)


def test_stages_equal_loops(spark, ran):
    docs, path, after = ran
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "suffix-array dedup", "mixing", "packing"]
    net = toxicity.fitted(docs, spark.read.parquet(f"{path}/labels.parquet"))
    rows = [tuple(r) for r in docs.collect()]
    score = toxicity.Scorer(net).score([r[1] or "" for r in rows])
    clean = [r for r, s in zip(rows, score, strict=True) if s < 0.7]
    toxic = {i for i in range(0, 420, 4)}
    assert len(toxic & {r[0] for r in clean}) <= 3 and len({r[0] for r in rows} - toxic - {r[0] for r in clean}) <= 3
    assert rows_of(after["toxicity"]) == sorted(clean, key=str)
    single = near_free(clean)
    assert rows_of(after["simhash near-dedup"]) == sorted(single, key=str) and len(single) < len(clean)
    unrepeated = without_repeats(single)
    assert rows_of(after["suffix-array dedup"]) == sorted(unrepeated, key=str)
    again = spark.createDataFrame(unrepeated, docs.schema)
    assert rows_of(after["mixing"]) == rows_of(mixing.mixed_stage(spark, again, path))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    ids = [[*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in rows_of(after["mixing"])]
    packed = after["packing"].collect()
    assert sum(r["length"] for r in packed) == sum(map(len, ids))
    whole = sorted(zlib.crc32(np.array(x, dtype="<u4").tobytes()) for x in ids if len(x) <= 2048)
    assert sorted(r["ids_crc32"] for r in packed if r["piece"] == 0 and r["length"] < 2048)[: len(whole)] == whole or len(whole) < len(ids)


def test_run_repeats_itself(spark, ran):
    _, path, after = ran
    key = lambda df: sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, path)) == key(after["packing"])


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
