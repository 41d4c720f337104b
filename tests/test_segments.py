"""Lines, sections and chunks against SQL and loops, on the given tables and on texts made to have every kind of line."""

import os
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from keepsake.adapters import Tables
from keepsake.functions import lines
from keepsake.operators import segment
from keepsake.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")

LINES = [
    "", "", "   ", "1 Introduction to it", "2.3 Second part of it", "12 short", "RESULTS AND MORE", "A B C", "Methods", "A short heading", "Ends with a stop.", "References", "  Index ", "About the author", "## Marked **head**",
    "- an item", "(a) another", "3. numbered item", "a line that goes on and on without any end", "Another line which is broken in the mid", "dle of a word-", "wide and so on; it ends:", "Chapter 3", "[Page 12]", "Page 4 of 9", "17", "see https://example.org/x",
    "tab\tin it", "ünïcode Zeile ohne Ende", "The same line again", "The same line again", "CONFIDENTIAL", "0 1 2 3 4 5", "B", "word " * 40, "Sentence one. Sentence two! Three? " * 9, "x" * 1200, "1.2.3 A b c", "ABSTRACT", "Discussion of all",
]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """A folder like the driver's with documents of random lines."""
    rng = np.random.default_rng(5)
    texts = ["\n".join(rng.choice(LINES, int(rng.integers(0, 60)))) for _ in range(300)] + ["", "one line", "\n\n\n", "word " * 3000, "no stop " * 50 + "\n\n" + "Short rest."]
    texts += ["\n\n".join(rng.choice(LINES, int(rng.integers(60, 200)))) for _ in range(20)]
    folder = tmp_path_factory.mktemp("made")
    for name in os.listdir(DATA):
        if name != "documents.parquet":
            os.symlink(f"{DATA}/{name}", folder / name)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


SQL = ["text_sections", "line_joining", "back_matter_cut", "heading_lines", "document_clean", "pdf_text_clean", "paragraph_chunks", "imported_chunks", "repeated_line_removal"]


@pytest.mark.parametrize("name", SQL)
def test_made_texts_equal_sql(spark, made, name):
    con = duckdb.connect()
    for t in ("documents", "customer", "orders", "lineitem", "part", "embeddings", "conversations", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{made}/{t}.parquet{'/*.parquet' if t == 'documents' else ''}'")
    df = __spark_entry__.queries()[name](spark, made)
    found = con.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    rows = sorted(map(tuple, df.select(columns).collect()), key=repr)
    assert len(rows) > 100 and rows == sorted(found.fetchall(), key=repr)


def estimate(text, light=False):
    return sum(1 + (len(w) // 4 - light if len(w) > 6 else 0) + (not light and len(w) > 12) for w in text.split())


def greedy(parts, most, joiner, size, smaller=None):
    """Parts into chunks with every size counted anew."""
    out, held = [], ""
    for part in parts:
        if not part.strip():
            continue
        if smaller and size(part) > most:
            out += [held.strip()] if held.strip() else []
            held = ""
            out += smaller(part)
        elif held.strip() and size(held) + size(part) > most:
            out.append(held.strip())
            held = part
        else:
            held = f"{held}{joiner}{part}" if held else part
    return out, held.strip()


def all_of(result):
    return [x for x in [*result[0], result[1]] if x]


def chunks_by_loop(text, least=150, most=250):
    if estimate(text) <= most:
        return [text] if text else []
    words = lambda s: all_of(greedy(s.split(), most, " ", estimate))
    sentences = lambda p: all_of(greedy(re.split(r"(?<=[.!?])\s+", p), most, " ", estimate, words))
    out, rest = greedy(re.split(r"\n\n+", text), most, "\n\n", estimate, sentences)
    if rest and out and estimate(rest) < least and estimate(out[-1]) + estimate(rest) <= most:
        out[-1] = f"{out[-1]}\n\n{rest}"
    elif rest:
        out.append(rest)
    return out


@pytest.mark.parametrize("least, most", [(150, 250), (5, 20), (30, 30), (1, 1)])
def test_chunks_equal_a_loop_and_cut_the_source_back(spark, made, least, most):
    docs = [(r["document_id"], r["content"]) for folder in (DATA, made) for r in Tables(spark, folder).documents.select("document_id", "content").collect()]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(docs)] + [(-1, None)], "id long, content string")
    found = {}
    for r in segment.chunked(df, least=least, most=most).collect():
        found.setdefault(r["id"], []).append(r)
    assert -1 not in found
    flat = lambda t: re.sub(r"\s+", " ", t).strip()
    for k, (_, text) in enumerate(docs):
        rows = sorted(found.get(k, []), key=lambda r: r["chunk_index"])
        assert [r["chunk"] for r in rows] == chunks_by_loop(text, least, most)
        assert [r["chunk_index"] for r in rows] == list(range(len(rows)))
        for r in rows:
            assert flat(text[r["start"] : r["end"]]) == flat(r["chunk"]) and r["token_estimate"] == estimate(r["chunk"])
            assert r["split_method"] in ("paragraph", "sentence", "word", "forced") and (r["split_method"] == "forced") == (r["token_estimate"] > most)
        assert all(a["end"] <= b["start"] for a, b in zip(rows, rows[1:], strict=False))
        assert "".join(text.split()) == "".join("".join(r["chunk"].split()) for r in rows)


def test_table_functions_in_sql(spark):
    segment.register(spark)
    spark.createDataFrame([(1, "one. two. " * 30)], "id long, content string").createOrReplaceTempView("given")
    rows = spark.sql("SELECT id, c.chunk_index, c.start, c.split_method FROM given, LATERAL keepsake_chunks(content, 5, 10) c").collect()
    assert len(rows) == 6 and [r["start"] for r in sorted(rows)] == [0, 50, 100, 150, 200, 250] and {r["split_method"] for r in rows} == {"sentence"}


def merged_by_loop(lengths, most, cap):
    runs = [(i, i, n) for i, n in enumerate(lengths)]
    while len(runs) > most:
        pairs = [(a[2] + b[2] + 2, i) for i, (a, b) in enumerate(zip(runs, runs[1:], strict=False)) if a[2] + b[2] + 2 <= cap]
        if not pairs:
            break
        both, i = min(pairs)
        runs[i : i + 2] = [(runs[i][0], runs[i + 1][1], both - 1)]
    return [r[:2] for r in runs]


@pytest.mark.parametrize("seed", range(30))
def test_merging_to_a_limit_equals_a_loop(seed):
    rng = np.random.default_rng(seed)
    lengths = [int(x) for x in rng.integers(0, [5, 50, 4000][seed % 3], int(rng.integers(0, 120)))]
    most, cap = int(rng.integers(1, 30)), [12, 300, 9600][seed % 3]
    assert segment.merged_to_limit(lengths, most, cap) == merged_by_loop(lengths, most, cap)


def test_merging_many_sections_is_quick():
    began = time.time()
    runs = segment.merged_to_limit([int(x) for x in np.random.default_rng(1).integers(1, 900, 100_000)], 20, 10**9)
    assert len(runs) == 20 and time.time() - began < 10


HEADING = re.compile(r"#{1,6}\s+|\d+(\.\d+)*\.?\s+[A-Z]|(?:abstract|introduction|method|methods|methodology|results?|discussion|conclusion|related work|references|background|experiments?|evaluation|appendix|preliminaries|setup)\b", re.I | re.A)


def is_heading(line):
    t = line.strip()
    if not t or len(t) > 120:
        return False
    m = HEADING.match(t)
    if m and not (m[0][0].isdigit() and not m[0][-1].isupper()):
        return True
    return t == t.upper() and bool(re.search("[A-Z]", t)) and 4 <= len(t) <= 60


def pieces(text, cap):
    out = []
    while len(text) > cap:
        at = text.rfind(". ", 0, cap + 2)
        if at < cap / 2:
            at = text.rfind("\n", 0, cap + 1)
        at = cap if at < cap / 2 else at + 1
        out.append(text[:at].strip())
        text = text[at:].strip()
    return [p for p in [*out, text] if p]


def windows(paragraphs, cap):
    out, held = [], ""
    for p in paragraphs:
        if len(p) > cap:
            out += ([held] if held else []) + pieces(p, cap)
            held = ""
        elif len(held) + len(p) + 2 > cap:
            out += [held] if held else []
            held = p
        else:
            held = f"{held}\n{p}" if held else p
    return out + ([held] if held else [])


def sections_by_loop(text, cap, least, most, single):
    text = text.strip()
    if len(text) <= single:
        return [(None, text)]
    top, parts, heading, body, seen = cap * 12 // 10, [], None, [], False
    for line in [*text.split("\n"), None]:
        if line is None or is_heading(line):
            if whole := "\n".join(body).strip():
                parts.append((heading, whole))
            body = []
            if line is not None:
                heading, seen = re.sub(r"^\d+(\.\d+)*\.?\s*", "", re.sub(r"^#+\s*", "", line.strip())).strip(), True
        else:
            body.append(line)
    split = lambda t: [p.strip() for p in re.split(r"\n\s*\n", t) if p.strip()]
    headed = seen and len(parts) > 1
    cut = []
    for heading, body in parts if headed else [(None, p) for p in windows(split(text), cap)]:
        small = [body] if len(body) <= top else windows(split(body), cap) if len(split(body)) > 1 else pieces(body, cap)
        cut += [(heading if not i else f"{heading or 'Section'} (cont.)", p) for i, p in enumerate(small)]
    joined = []
    for heading, body in cut:
        if len(body) < least and joined and len(joined[-1][1]) + len(body) + 2 <= top:
            joined[-1] = (joined[-1][0] or heading, f"{joined[-1][1]}\n{body}")
        else:
            joined.append((heading, body))
    runs = merged_by_loop([len(b) for _, b in joined], most, top) if headed else [(i, i) for i in range(len(joined))]
    return [(next((h for h, _ in joined[a : b + 1] if h is not None), None), "\n".join(x for _, x in joined[a : b + 1])) for a, b in runs]


@pytest.mark.parametrize("cap, least, most, single", [(8000, 500, 20, 6000), (300, 40, 6, 200), (60, 20, 3, 10)])
def test_sections_equal_a_loop(spark, made, cap, least, most, single):
    texts = [r["content"] for folder in (DATA, made) for r in Tables(spark, folder).documents.select("content").collect()] + ["a. b " * 4000, "Introduction\n" + "long text. " * 2000 + "\nMethods\n" + "p\n\n" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    found = {}
    for r in segment.sectioned(df, cap=cap, least=least, most=most, single=single).collect():
        found.setdefault(r["id"], []).append((r["section_index"], r["heading"], r["section"]))
    for i, text in enumerate(texts):
        assert [r[1:] for r in sorted(found.get(i, []))] == sections_by_loop(text, cap, least, most, single), i


def test_markdown_sections(spark):
    text = "before\n# One *two*\nbody\n\n## [Sub]\r\nmore\n#none\n### Empty"
    row = spark.range(1).select(lines.markdown_sections(F.lit(text)).alias("s"), lines.markdown_sections(F.lit(None).cast("string")).alias("n")).first()
    assert [tuple(s) for s in row["s"]] == [("One two", 1, "body"), ("Sub", 2, "more\n#none"), ("Empty", 3, "")] and row["n"] == []
