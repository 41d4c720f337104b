"""The other training-data operators against brute force, round trips and held-out accuracy."""

import hashlib
import itertools
import json
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from keepsake.llm import chat, fingerprints, labelled, licenses, mixing, packing, quality, simhash, topk, toxicity
from keepsake.llm.graph import components


def docs_of(spark, rows, path=None):
    """Documents with further columns whose names the operators use themselves."""
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumns({"size": F.lit("x"), "score": F.lit("y"), "fp": F.lit("z"), "piece": F.lit("p")})
    if path:
        df.repartition(3).write.parquet(f"{path}/documents.parquet")
    return df


ODD = [(900, None, None), (901, "", "a"), (902, "   ", "a"), (903, "one", "b"), (904, "two words", "b"), (905, "é " * 50, "c"), (906, "x" * 5000, "c"), (907, "same text here twice", "a"), (907, "same text here twice", "a"), (None, "no id at all", "a"), (None, None, None), (908, "long " * 30_000, "a")]


# ---------------------------------------------------------------- SimHash


def fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum((2 * n > len(shingles)) << b for b, n in enumerate(ones))


def near_rows():
    rng = np.random.default_rng(1)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    rows = [(i, " ".join(words(60)), "a") for i in range(40)]
    for i in range(20):
        base = words(300)
        for j in range(4):
            changed = base.copy()
            changed[j * 7] = "changed"
            rows.append((100 + 10 * i + j, " ".join(changed), "a"))
    return rows + ODD


def test_simhash_equals_brute_force(spark, tmp_path):
    rows = near_rows()
    docs_of(spark, rows, str(tmp_path))
    got = simhash.op2_simhash_near_dedup(spark, str(tmp_path)).collect()
    fps = [(i, fingerprint(t)) for i, t, _ in rows]
    assert sorted(((r["doc_id"], r["fingerprint"]) for r in got), key=str) == sorted(((i, f"{f:016x}") for i, f in fps), key=str)
    parent = {f: f for _, f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(parent, 2):
        if (a ^ b).bit_count() <= 3:
            parent[root(a)] = root(b)
    least = {}
    for i, f in fps:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    assert all(r["component_id"] == least.get(root(int(r["fingerprint"], 16))) for r in got)
    assert len({least.get(root(f)) for _, f in fps}) < len({f for _, f in fps})


@pytest.mark.parametrize("chunk", [4, 1000])
def test_links_lose_none(spark, chunk):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    near = np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) for _ in range(4)])
    values = np.unique(near).view(np.int64).tolist()
    found = {r["node"]: r["component"] for r in components(simhash.links(simhash.block_keys(spark.createDataFrame([(v,) for v in values], "fp long")), chunk=chunk)).collect()}
    for a, b in itertools.combinations(values, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
            assert found[a] == found[b]


def test_components_of_a_long_chain(spark):
    pairs = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in components(pairs).collect()} == {0}
    assert components(pairs.limit(0)).count() == 0


def shingle_set(text, words=5):
    parts = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def near_free(rows):
    """Of each component of texts alike by 0.8 the row of the smallest id."""
    sets = [shingle_set(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if alike(sets[a], sets[b]):
            parent[root(a)] = root(b)
    order = lambda r: (r[0] is None, r[0] or 0)
    best = {}
    for i, r in enumerate(rows):
        if root(i) not in best or order(r) < order(best[root(i)]):
            best[root(i)] = r
    return list(best.values())


def test_simhash_stage_keeps_one_of_each(spark):
    rows = near_rows()
    kept = simhash.simhash_stage(spark, docs_of(spark, rows), "")
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = [r["doc_id"] for r in kept.collect()]
    expected = [r[0] for r in near_free(rows)]
    assert sorted(ids, key=str) == sorted(expected, key=str) and len(ids) < len({i for i, _, _ in rows})


@pytest.mark.parametrize("chunk, cell", [(1024, 4096), (8, 16)])
def test_simhash_stage_finds_edited_copies(spark, monkeypatch, chunk, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash.verified_links, "__defaults__", (simhash.STAGE_BITS, simhash.SIMILARITY, cell))
    monkeypatch.setattr(simhash.links, "__defaults__", (simhash.BITS, chunk))
    rng = np.random.default_rng(21)
    rows, pairs = [], 0
    for base in range(60):
        words = [f"w{x}" for x in rng.integers(0, 20_000, int(rng.integers(60, 400)))]
        texts = [words]
        for k in range(5):
            copy = list(words)
            for at in rng.choice(len(words), max(1, len(words) // int(rng.choice([30, 45, 70, 150]))), replace=False):
                copy[at] = f"x{rng.integers(10**6)}"
            texts.append(copy)
        rows += [(10 * base + k, " ".join(t), "s") for k, t in enumerate(texts)]
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    found = simhash.profiles(docs_of(spark, rows).withColumn("__row", F.md5("text")))
    ids = {r["text_digest"]: r["doc_id"] for r in found.select("text_digest", "doc_id").collect()}
    component = {ids[r["node"]]: r["component"] for r in simhash.alike_texts(simhash.written(found, "t")).collect()}
    like = [(a, b) for a, b in itertools.combinations(sets, 2) if a // 10 == b // 10 and alike(sets[a], sets[b])]
    caught = [(a, b) for a, b in like if a in component and component[a] == component.get(b)]
    assert len(like) > 200 and len(caught) / len(like) > 0.98
    assert {i for i in component} <= {i for pair in like for i in pair}  # nothing but verified links


def test_a_repeated_shingle_does_not_make_texts_alike(spark):
    rows = [(i, " ".join(["the same five words here"] * 60 + [f"own{i}x{k}" for k in range(40)]), "s") for i in range(6)]
    assert simhash.simhash_stage(spark, docs_of(spark, rows), "").count() == 6


def test_simhash_stage_tells_rows_apart_without_ids(spark):
    rng = np.random.default_rng(12)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 5000, 50))
    single = [(None, text(), "a"), (None, text(), "a"), (None, text(), "b"), (7, text(), "a"), (7, text(), "a"), (8, text(), "a")]
    rows = [*single, (None, single[5][1], "a"), (9, single[0][1], "a"), single[3]]  # copies of 8, of the first, and a row twice
    kept = [(r["doc_id"], r["text"], r["source"]) for r in simhash.simhash_stage(spark, docs_of(spark, rows), "").collect()]
    assert sorted(kept, key=str) == sorted([*single[1:], (9, single[0][1], "a")], key=str)


# ---------------------------------------------------------------- classifiers


def labelled_tables(spark, path, column):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(900):
        bad = i % 3 == 0
        words = [f"{'clean' if rng.random() < 0.5 else 'plain'}{x}" for x in rng.integers(0, 300, 80)]
        if bad:
            words[40:44] = ["vileword", "nastyterm", f"vileword{rng.integers(9)}", "hatefulthing"] if column == "toxic" else ["!!!", "$$$", "CLICK", "NOW!!!"] * 1
            words = words if column == "toxic" else [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(not bad), int(bad)))
    docs_of(spark, rows + ODD, path)
    spark.createDataFrame([*labels, (0, None, None), (None, 1, 1), (5000, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return {i: (q, x) for i, q, x in labels}


@pytest.mark.parametrize("column, run, limit", [("quality", quality.op3_quality_classifier, 0.5), ("toxic", toxicity.op8_toxicity, 0.7)])
def test_classifiers_on_held_out_rows(spark, tmp_path, column, run, limit):
    labels = labelled_tables(spark, str(tmp_path), column)
    rows = run(spark, str(tmp_path)).collect()
    assert len(rows) == 900 + len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= limit) for r in rows)
    assert all(r["held_out"] is (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    right = sum(r["predicted"] == labels[r["doc_id"]][column == "toxic"] for r in held)
    assert len(held) > 200 and right / len(held) > 0.95


@pytest.mark.parametrize("run", [quality.op3_quality_classifier, toxicity.op8_toxicity])
def test_classifiers_without_labels(spark, tmp_path, run):
    docs_of(spark, ODD, str(tmp_path))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert run(spark, str(tmp_path)).count() == len(ODD)


def test_labels_of_held_out_rows_are_not_learned(spark):
    rows = [(i, f"t{i}", "s") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    got = labelled.sample(docs_of(spark, rows), labels, "quality", {0: 100, 1: 100}).collect()
    assert got and all(zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 for r in got)


def test_gradients_of_the_network():
    net = toxicity.Network(3)
    rng = np.random.default_rng(0)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    own, grams = toxicity.word_rows(["", "abcdef", "ghij", "klm"])
    rows = rng.integers(0, 4, (5, toxicity.RUN)).astype(np.int32)
    mask, labels, weights = (rows > 0).astype(float), np.array([0, 1, 1, 0, 1.0]), np.ones(5)
    pool = mask * (np.arange(toxicity.RUN) % 40 < 32)
    grads, _ = net.gradients(own, grams, rows, mask, pool, labels, weights, np.ones(4))
    for k, at in (("w", (3, 5)), ("u0", (1, 2)), ("u1", (2, 7)), ("a", (4,)), ("v", (2,)), ("word", (own[1], 3)), ("char", (grams[2, 0], 1))):
        loss = []
        for step in (1e-3, -2e-3):
            net.p[k][at] += step
            loss.append(net.gradients(own, grams, rows, mask, pool, labels, weights, np.ones(4))[1])
        net.p[k][at] += 1e-3
        assert abs((loss[0] - loss[1]) / 2e-3 - grads[k][at]) < 2e-3


def small_network():
    rng = np.random.default_rng(8)
    texts = [" ".join(f"clean{x}" for x in rng.integers(0, 300, 60)) for _ in range(120)]
    toxic = [" ".join([*t.split()[:20], *rng.permutation(["vileword", "nastyterm", "hatefulthing", "uglyslur"] * 3).tolist(), *t.split()[32:]]) for t in texts[::3]]
    seen = [[m for t in part for m in toxicity.marks(toxicity.tokens(t))] for part in (toxic, texts)]
    odds = {m: toxicity.log_odds(seen[0].count(m), seen[1].count(m), len(toxic), len(texts)) for m in set(seen[0])}
    net = toxicity.learned([(label, *w[:3]) for label, part in ((0, texts), (1, toxic)) for t in part for w in toxicity.windows_of(t, label, odds)], epochs=6)
    net.slope, net.shift = toxicity.curve(toxicity.Scorer(net).logits(texts + toxic), np.array([0.0] * len(texts) + [1.0] * len(toxic)))
    return net


def plain_logit(net, words, start):
    """One window by loops over its run of words, a word and a number at a time."""
    first = start // 32 * 32
    run = words[first : first + 64]
    if not run:
        return net.quiet
    x = []
    for w in run:
        own, grams = toxicity.word_rows([w])
        pieces = [net.p["char"][g] for g in grams[0] if g < toxicity.CHAR_ROWS]
        x.append(np.concatenate([net.p["word"][own[0]], np.mean(pieces, axis=0)]) @ net.p["w"] + net.p["b"])
    h, states = toxicity.HIDDEN, [[None, None] for _ in run]
    for way in (0, 1):
        state = np.zeros(h)
        for t in range(len(run)) if way == 0 else reversed(range(len(run))):
            g, hu = x[t][3 * h * way : 3 * h * (way + 1)], state @ net.p[f"u{way}"]
            z, r = (1 / (1 + np.exp(-(g[i : i + h] + hu[i : i + h]))) for i in (0, h))
            new = np.tanh(g[2 * h :] + r * hu[2 * h :])
            state = z * state + (1 - z) * new
            states[t][way] = state
    held = [np.concatenate(s) for s in states[start - first : start - first + 32]]
    weight = np.exp([s @ net.p["a"] for s in held])
    return float(np.sum([w * (s @ net.p["v"]) for w, s in zip(weight / weight.sum(), held, strict=True)]) + net.p["c"][0])


def test_every_window_is_scored(monkeypatch):
    monkeypatch.setattr(toxicity, "BATCH_RUNS", 7)
    net, rng = toxicity.Network(4), np.random.default_rng(4)
    net.p["a"], net.p["v"] = net.p["a"] * 9, net.p["v"] * 9
    texts = [" ".join(f"t{x}" for x in rng.integers(0, 200, n)) for n in (5, 31, 32, 33, 63, 64, 65, 70, 96, 97, 500, 0, 1)]
    for text, logit in zip(texts, toxicity.Scorer(net).logits(texts), strict=True):
        words = toxicity.tokens(text)
        assert abs(max(plain_logit(net, words, s) for s in range(max(1, len(words) - 31))) - logit) < 1e-4


@pytest.mark.parametrize("word", ["short", "a" * 13, "abcdefghijklmnopqrstuvwxyz0123456789" * 3, "слово" * 20, "字" * 50 + "a" * 9 + "汉" * 40, "𝒳y" * 30])
def test_every_character_of_a_word_is_read(word):
    runs = toxicity.tokens(word)
    own, grams = toxicity.word_rows(runs)  # none too long for its row
    assert grams.shape == (len(runs), toxicity.TRIGRAMS) and all(len(r.encode()) <= toxicity.LONGEST for r in runs)
    size = lambda c: len(c.encode())
    for i in range(len(word)):
        j = i + 1
        while j < len(word) and sum(map(size, word[i:j])) < 4:
            j += 1
        assert any(word[i:j] in r for r in runs)
    assert runs[0] == word[: len(runs[0])] and runs[-1] == word[-len(runs[-1]) :]


def test_the_middle_of_a_long_word_counts():
    net = small_network()
    net.p["word"][:] = 0  # no score by the whole word's hash
    calm, vile = "".join(f"clean{x}" for x in range(40)), "vilewordnastytermhatefulthinguglyslur" * 4
    score = toxicity.Scorer(net).score([calm + calm, calm + vile + calm])
    assert abs(score[0] - score[1]) > 1e-3


def test_words_before_a_passage_do_not_hide_it():
    net, rng = small_network(), np.random.default_rng(9)
    clean = [f"clean{x}" for x in rng.integers(0, 300, 100)]
    text = [*clean[:40], *["vileword", "nastyterm", "hatefulthing", "uglyslur"] * 3, *clean[40:80]]
    score = toxicity.Scorer(net).score([" ".join([*clean[:k], *text]) for k in range(32)])
    assert (score >= 0.7).all() and np.ptp(score) < 0.1


def test_trees_equal_plain_walk():
    rng = np.random.default_rng(1)
    x = rng.random((400, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    model = quality.fit(x, y, trees=20, depth=3)

    def walk(row):
        total = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            node = 0
            for _ in range(3):
                node = 2 * node + (1 if row[f[node]] <= t[node] else 2)
            total += leaf[node - len(f)]
        return 1 / (1 + np.exp(-total))

    score = model.score(x)
    assert np.allclose(score, [walk(r) for r in x]) and ((score > 0.5) == y).mean() > 0.95


# ---------------------------------------------------------------- packing


def test_packing_round_trip(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"word{x}" for x in rng.integers(0, 999, int(n))), "s") for i, n in enumerate(rng.integers(1, 900, 60))] + [(800, "<|endoftext|> 日本語 text", "s"), (801, "tab\tand\n\nlines  é", "s")] + ODD
    docs_of(spark, rows, str(tmp_path))
    got = packing.op4_best_fit_packing(spark, str(tmp_path)).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    ids = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
    total = sum(len(ids(t)) for _, t, _ in rows)
    assert sum(r["length"] for r in got) == total
    texts = {i: t for i, t, _ in rows if i is not None}
    for r in got:
        if r["doc_id"] is not None:
            part = ids(texts[r["doc_id"]])[r["start"] : r["start"] + r["length"]]
            assert len(part) == r["length"] and zlib.crc32(np.array(part, dtype="<u4").tobytes()) == r["ids_crc32"]
    by: dict = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) == len(plain_packing([r["length"] for r in got], 2048))


def plain_packing(lengths, top):
    """Best-fit decreasing piece by piece, looking at every open sequence: the lengths of each."""
    open_: list[list[int]] = []
    for n in sorted(lengths, reverse=True):
        fitting = [(top - sum(s), k) for k, s in enumerate(open_) if sum(s) + n <= top]
        if fitting:
            open_[min(fitting)[1]].append(n)
        else:
            open_.append([n])
    return open_


@pytest.mark.parametrize("most, count, top", [(100, 300, 100), (60, 400, 100), (12, 500, 64), (3, 50, 10), (1, 7, 3), (100, 0, 100)])
def test_best_fit_takes_the_tightest(most, count, top):
    lengths = np.random.default_rng(count).integers(1, most + 1, count).tolist()
    counts = {n: lengths.count(n) for n in set(lengths)}
    held: dict[int, list] = {}
    slots = packing.best_fit_decreasing(counts, top)
    for n, first, each, sequence, offset in slots:
        after = min((s[1] for s in slots if s[0] == n and s[1] > first), default=counts[n])
        for i in range(after - first):
            held.setdefault(sequence + i // each, []).append((offset + i % each * n, n))
    for pieces in held.values():  # gapless
        assert [o for o, _ in sorted(pieces)] == np.cumsum([0, *(n for _, n in sorted(pieces))])[:-1].tolist()
    assert sorted(n for p in held.values() for _, n in p) == sorted(lengths)
    # of sequences with one capacity any may be taken, so only how full each is must be equal
    assert sorted(sum(n for _, n in p) for p in held.values()) == sorted(map(sum, plain_packing(lengths, top)))


def test_packing_of_a_hot_length_and_id(spark):
    docs = spark.createDataFrame([(None, "same words here")] * 3000 + [(7, "same words here")] * 500, "doc_id long, text string").repartition(5)
    got = packing.packed(docs).collect()
    places = {(r["sequence_id"], r["offset"]) for r in got}
    assert len(got) == len(places) == 3500 and len({r["sequence_id"] for r in got}) == -(-3500 // (2048 // got[0]["length"]))


# ---------------------------------------------------------------- chat


def brute_chat(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted((-1 if t is None else t, role or "", text or "") for conv, t, role, text in rows if conv == c)
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_reads_back(spark, tmp_path):
    nasty = ["<|end|>", "\\<|turn|>\\\\", "<\\|text|>", "a\\", "<", "|>", "", None, "plain\nlines", "{{ m.text }}{% if x %}", "</s>[INST] x [/INST]", "<<||>>\\"]
    rows = [(c, t, ["user", "assistant", "system", "<|end|>", None][(c + t) % 5], nasty[(c * 5 + t) % len(nasty)]) for c in range(12) for t in range(c % 7 + 1)]
    rows += [(3, 0, "assistant", "twice"), (3, 0, "assistant", "twice"), (None, 1, "user", "lost"), (None, None, "assistant", "x" * 200_000)]
    rows += [(50, t, ["user", "assistant"][t % 2], nasty[t % len(nasty)]) for t in range(1500)]  # one of many parts
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.op5_chat_formatting(spark, str(tmp_path)).collect()}
    extra = [(-7, 0, "user", chat.EXTRA_TEXT), (-7, 1, "assistant", chat.EXTRA_TEXT)]
    assert got == brute_chat(rows + extra)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {r["conv_id"]: (r["formatted"], [list(s) for s in r["loss_spans"]]) for r in chat.formatted(table).collect()}
    parts: dict = {}
    for r in chat.formatted_parts(table).orderBy("place").collect():
        text, spans = parts.get(r["conv_id"], ("", []))
        parts[r["conv_id"]] = (text + r["formatted"], spans + [[a + len(text), b + len(text)] for a, b in r["loss_spans"]])
    assert parts == whole and len(whole[50][1]) == 750


def test_template_language():
    say = lambda t, m: chat.compile_template(t)(m)[0]
    one = [{"role": "user", "text": " Hi "}]
    assert say("{% for m in messages %}{{ m.text | trim | upper ~ '!' }}{% endfor %}", one) == "HI!"
    assert say("{% if 'a' == 'a' and not 'b' == 'a' %}yes{% else %}no{% endif %}", []) == "yes"
    assert len(chat.folded_body(chat.parse("a{{ 'b' ~ 'c' }}d{% if 1 == 2 %}x{% endif %}"))) == 1
    before, turn, after = chat.compile_by_turn("<s>{% for m in messages %}[{{ m.role }}]{% generation %}{{ m.text }}{% endgeneration %}{% endfor %}{{ '</s>' }}")
    assert (before, turn(one[0]), after) == ("<s>", ("[user] Hi ", [(6, 10)]), "</s>")
    for split in ("{{ messages }}", "{% for m in messages %}{{ other }}{% endfor %}", "{% for m in messages %}x{% endfor %}{{ y }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_by_turn(split)
    for bad in ("{{ a.__class__ }}", "{{ open('x') }}", "{% for m in x %}", "{{ a | unknown }}", "{% endif %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


# ---------------------------------------------------------------- top-k


def plain_top_k(rows, k=10):
    good = [(i, [int(np.floor(x * 1024)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    queries = {}
    for i, v in good:
        if i % 100 == 0:
            queries[i] = min(v, queries.get(i, v))
    out = []
    for q, qv in queries.items():
        best = sorted((-sum(a * b for a, b in zip(qv, v, strict=False)), i) for i, v in good if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 3e4])  # products as doubles, as integers
def test_top_k_equals_brute_force(spark, tmp_path, monkeypatch, scale):
    for name, value in (("RANGE", 60), ("QUERY_CHUNK", 3), ("ROWS_A_CENTRE", 70)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=6) + 4 * np.eye(6)[i % 4]).round(1).tolist()) for i in range(700)] + [(700, None), (800, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (900, [float("nan")] * 6), (1000, [float("inf")] * 6), (None, [1.0] * 6), (5, [3.0] * 6), (1100, [0.0] * 6), (200, [2.0, 1.0]), (200, [2.0, 1.0]), (300, [9.0] * 6), (7, [1.5])]
    rows = [(i, v and [x and x * scale for x in v]) for i, v in rows]
    spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(tuple(r) for r in topk.op6_exact_top_k(spark, str(tmp_path)).collect()) == plain_top_k(rows)
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(con.execute(topk.OP6_SQL).fetchall()) == plain_top_k(rows)


@pytest.mark.parametrize("x", [1e300, 2.0**45])
def test_top_k_raises_where_scores_may_not_fit(spark, x):
    vectors = topk.integer_vectors(spark.createDataFrame([(0, [x, 1.0]), (1, [x, 2.0])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(vectors, F.col("vec_id") == 0).collect()


def test_blocks_are_pruned_where_vectors_have_groups():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32)) * 8
    vectors = np.floor(1024 * (centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 32)) * 0.3))
    order = np.argsort(topk.nearest(vectors, np.floor(1024 * centres)), kind="stable")  # as an index lays them
    shares = []
    for q in range(20):
        out, scored, blocks = 0, 0, 0
        kth = None
        for own in np.split(order, 10):
            found, s, b = topk.best_in_range(vectors[q : q + 1], np.array([q]), vectors[own], own, 10, [kth], 16)
            scored, blocks = scored + s, blocks + b
            if len(found) == 10 and kth is None:
                kth = (found[-1][2], found[-1][1])
        shares.append(scored / blocks)
    assert np.mean(shares) < 0.5


def test_top_k_of_few(spark, tmp_path):
    spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [tuple(r) for r in topk.op6_exact_top_k(spark, str(tmp_path)).collect()] == [(0, 1, 1, 1048576)]


# ---------------------------------------------------------------- fingerprints


def plain_sketch(text, k=128):
    words = text.encode().split()
    found = set()
    for i in range(max(1, len(words) - 4)) if words else ():
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(w, h)
        found.add(h - 2**64 if h >= 2**63 else h)
    return sorted(found)[:k]


def plain_resemblance(a, b, k=128):
    union = sorted(set(a) | set(b))[:k]
    return len(set(union) & set(a) & set(b)) / len(union) if union else 1.0


def plain_fingerprints(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (xxhash.xxh64_intdigest((r[1] or "").encode(), 42) + 2**63) % 2**64))
    texts = [r[1] or "" for r in order]
    out = []
    for i, (a, b) in enumerate(zip(texts, texts[1:] + texts[:1], strict=True)):
        e = a[: len(a) - len(a) // 4] + b[: len(a) // 4]
        own, changed, following = map(plain_sketch, (a, e, b))
        hexed = lambda s: "".join(f"{h % 2**64:016x}" for h in s)
        out.append((order[i][0], len(a), hashlib.sha256(e.encode()).hexdigest(), hexed(own), hexed(changed), plain_resemblance(own, changed), plain_resemblance(own, following)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket, copies", [(4096, 1024), (7, 1024), (7, 3), (1, 1)])
def test_fingerprints(spark, tmp_path, bucket, copies):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 300, rng.integers(1, 250))), "s") for i in range(60)] + ODD + [(None, "copied words in a row of seven", "s")] * 20 + [(2**63 - 1, "last", "s"), (-5, "first é ü", "s")] + [(30, "again the same", "s")] * 6
    got = fingerprints.compared(docs_of(spark, rows), bucket, copies).collect()
    assert sorted((tuple(r)[:7] for r in got), key=str) == plain_fingerprints(rows)
    assert all(0 <= r["contained_in_edited"] <= 1 and r["shingles"] >= 0 for r in got)


def test_sketches_merge(spark):
    rows = spark.createDataFrame([(" ".join(f"w{i}" for i in range(a, b)),) for a, b in ((0, 400), (200, 600))], "text string").select(fingerprints.sketch(F.col("text")).alias("s")).collect()
    a, b = (F.array(*map(F.lit, r["s"])) for r in rows)
    one = spark.range(1).select(fingerprints.distinct_shingles(a).alias("n"), fingerprints.resemblance(a, b).alias("r"), fingerprints.containment(a, b).alias("c"), F.size(fingerprints.merged(a, b)).alias("k")).first()
    assert 300 < one["n"] < 500 and abs(one["r"] - 196 / 596) < 0.12 and abs(one["c"] - 0.5) < 0.15 and one["k"] == fingerprints.K


# ---------------------------------------------------------------- mixing


def test_mixing(spark, tmp_path):
    rng = np.random.default_rng(10)
    rows = [(i, "w " * int(n), ["a", "b", "c", None][i % 7 % 4]) for i, n in enumerate(rng.integers(1, 200, 500))] + [(600, None, "a"), (601, " ", "b")]
    docs_of(spark, rows, str(tmp_path))
    got = mixing.op9_mix_sources(spark, str(tmp_path)).collect()
    again = mixing.op9_mix_sources(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == len(rows)
    source = {i: s for i, _, s in rows}
    assert all(r["size"] == len((dict((i, t) for i, t, _ in rows)[r["doc_id"]] or "").split()) and 0 <= r["taken"] <= 2 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    for s in ("a", "b", "c", None):
        own = [r for r in got if source[r["doc_id"]] == s]
        assert own[0]["source_size"] == sum(r["size"] for r in own) and own[0]["target"] <= 2 * own[0]["source_size"] + 1e-6
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.02 * own[0]["target"] + 40
    assert abs(sum({source[r["doc_id"]]: r["target"] for r in got}.values()) - 1.5 * total) < 1e-6 * total


def test_sainte_lague_by_quotients():
    for votes, seats, caps in (([53, 24, 23], 7, [9, 9, 9]), ([5, 5, 5], 4, [9, 9, 9]), ([100, 1, 0], 10, [4, 9, 9]), ([0, 0], 3, [2, 2])):
        taken = [0] * len(votes)
        for _ in range(seats):
            open_ = [i for i in range(len(votes)) if votes[i] > 0 and taken[i] < caps[i]]
            if not open_:
                break
            taken[max(open_, key=lambda i: (votes[i] / (2 * taken[i] + 1), -i))] += 1
        assert mixing.sainte_lague(votes, seats, caps).tolist() == taken


def plain_targets(sizes, weights):
    targets, left, open_ = [0.0] * len(sizes), 1.5 * sum(sizes), list(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > 2 * sizes[i]]
        for i in over or open_:
            targets[i] = 2.0 * sizes[i] if over else left * weights[i] / total
        left -= sum(2 * sizes[i] for i in over)
        open_ = [i for i in open_ if i not in over] if over else []
    return targets


@pytest.mark.parametrize("sizes", [[100, 100, 100], [0, 0], [5, 1000, 3, 70, 70, 2, 1], [1, 1000], [7]])
def test_targets_stop_at_their_caps(spark, sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    rows = spark.createDataFrame([(i, n, float(w)) for i, (n, w) in enumerate(zip(sizes, weights, strict=True))], "i int, size long, weight double")
    assert [r["__target"] for r in mixing.targeted(rows).orderBy("i").collect()] == pytest.approx(plain_targets(sizes, weights))


@pytest.mark.parametrize("quota, blocks", [(0, 4), (3, 4), (4, 4), (7, 5), (10, 5), (1, 1)])
def test_blocks_word_by_word(quota, blocks):
    sizes = np.array([3, 0, 10, 1, 6, 13, 2])
    copies, extra, ranges, ends = mixing.chosen_words(sizes, quota, blocks, 9)
    words = int(sizes.sum())
    bounds = [b * words // blocks for b in range(blocks + 1)]
    order = sorted(range(blocks), key=lambda b: int(mixing.mixed_hash(np.array([b]), 9)[0]))
    taken = [quota // blocks] * words
    for b in order[: quota % blocks]:
        for w in range(bounds[b], bounds[b + 1]):
            taken[w] += 1
    starts = ends - sizes
    assert (copies * sizes + extra).tolist() == [sum(taken[s:e]) for s, e in zip(starts, ends, strict=True)]
    assert sorted(w for a, b in ranges for w in range(a, b)) == [w for w in range(words) if taken[w] > copies]


def test_mixing_passes_ids_on_and_splits_equal_rows(spark):
    big = 2**53 + 1
    rows = [(big + 2 * i, f"word w{i} x y z", "a") for i in range(50)] + [(None, "no id", "a"), (big, None, None)] + [(None, "equal row here", "b")] * 500 + [(3, "equal row here", "b")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    runs = [mixing.mixture(docs.repartition(n), docs_per_shard=64).collect() for n in (3, 7)]
    ids = lambda x: sorted(((r[0], r[2]) for r in x), key=str)
    for got in runs:
        assert sorted(((r["doc_id"], r["source"]) for r in got), key=str) == ids(rows)
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
        for s in ("a", "b"):
            own = [r for r in got if r["source"] == s]
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.05 * own[0]["target"] + 16
    plain = [sorted(((r["doc_id"], r["source"], r["size"], r["target"], r["taken"]) for r in got), key=str) for got in runs]
    assert plain[0] == plain[1]  # whatever the layout
    odd = spark.createDataFrame([(big, "a b c d", "en", "s", 7), (None, "e f g", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    assert {r["doc_id"] for r in mixing.mixed_stage(spark, odd, "").collect()} <= {big, None}


def test_mixed_stage_takes_its_words(spark):
    rows = [(i, f"d{i} " + "w x\ty " * (i % 9), ["a", "b"][i % 2]) for i in range(60)] + [(99, None, "a")]
    docs = docs_of(spark, rows)
    taken = mixing.mixture(docs.select("doc_id", "source", "text")).agg(F.sum("taken")).first()[0]
    out = mixing.mixed_stage(spark, docs, "").collect()
    assert sum(len((r["text"] or "").split()) for r in out) == taken and all(r["n_chars"] == len(r["text"] or "") for r in out)


# ---------------------------------------------------------------- licences


def test_licenses(spark, tmp_path):
    mit, gpl, apache = (licenses.TEXTS[n] for n in ("MIT", "GPL-3.0", "Apache-2.0"))
    rows = [(1, mit, "s"), (2, "MIT License\n\nCopyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ,"), "s"), (3, mit + " more", "s"), (4, "text\nReleased under the MIT License.\nend", "s"), (5, licenses.TEXTS["ISC"].replace('"', "”"), "s"), (6, "licence", "s")]
    rows += [(7, gpl, "s"), (8, gpl.lower().replace("\n", "  \n"), "s"), (9, apache[: apache.index("END OF TERMS")] + "END OF TERMS AND CONDITIONS\n\n", "s"), (10, licenses.TEXTS["CC0-1.0"], "s"), (11, licenses.TEXTS["MPL-2.0"].replace("license", "licence"), "s"), (12, licenses.TEXTS["BSL-1.0"], "s"), (13, "SPDX-License-Identifier: Apache-2.0\nLicensed under CC BY 4.0.\n licensed under cc by 4.0 \n", "s"), *ODD]
    docs = docs_of(spark, rows, str(tmp_path))
    got = {r["doc_id"]: r for r in licenses.scanned(docs).collect()}
    assert [got[i]["license"] for i in range(1, 13)] == ["MIT", "MIT", None, None, "ISC", None, "GPL-3.0", "GPL-3.0", "Apache-2.0", "CC0-1.0", "MPL-2.0", "BSL-1.0"]
    assert got[4]["notices"] == "MIT" and got[900]["notices"] == "" and got[13]["notices"] == "Apache-2.0,CC-BY-4.0"
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(licenses.sql()).fetchall(), key=str) == sorted(map(tuple, licenses.scanned(docs).collect()), key=str)


def test_notices_of_any_wording_are_found(spark):
    docs = docs_of(spark, [(1, "a\nDedicated to the public domain!\nb", "s"), (2, "public domain", "s"), (3, "", "s")])
    got = {r["doc_id"]: r["notices"] for r in licenses.scanned(docs, notices={"Dedicated to the public domain.": "PD", "dedicated to the PUBLIC domain": "later", "...": "empty"}).collect()}
    assert got == {1: "PD", 2: "", 3: ""}
    assert {r["notices"] for r in licenses.scanned(docs, notices={}).collect()} == {""}


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_empty_tables(spark, tmp_path, adaptive):
    docs_of(spark, [], str(tmp_path))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    from keepsake.llm.queries import QUERIES

    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        rows = {name: run(spark, str(tmp_path)).count() for name, run in QUERIES.items()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert rows == {name: int(name.startswith("op5_")) for name in QUERIES}, json.dumps(rows)
