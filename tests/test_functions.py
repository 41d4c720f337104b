"""Functions against literal values that follow from their definitions."""

import math
import re

import pytest
from hypothesis import given, settings
from hypothesis.strategies import from_regex
from pyspark.sql import functions as F

from keepsake.functions import decay, lines, numbers, query, text, vector
from keepsake.operators import segment


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda c: one.select(c.alias("x")).first()[0]


@pytest.mark.parametrize("label, key", [("Ring System", "ring"), ("  the Deep Module ", "deep_the"), ("API (v2)", "api_v2"), ("b a c", "a_b_c"), ("", ""), ("!!!", ""), ("tool library tool", "tool"), ("data feature", "data")])
def test_normalize_key(value, label, key):
    assert value(text.normalize_key(F.lit(label))) == key


def test_decay(value):
    at = lambda s, r, d: value(decay.strength_after(F.lit(s), F.lit(r), F.lit(d)))
    assert at(0.8, 0.1, 0.0) == 0.8 and at(0.12345678, 0.1, -1.0) == 0.12345678
    assert at(1.0, 0.1, 1.0) == 0.9 and at(1.0, 0.2, 2.0) == 0.64 and at(0.5, 0.15, 1000.0) == 0
    assert [value(decay.category(F.lit(s))) for s in (0.7, 0.69, 0.4, 0.1, 0.09)] == ["strong", "fading", "fading", "critical", "forgotten"]
    assert value(decay.refreshed(F.lit(0.5))) == 0.65 and value(decay.refreshed(F.lit(1.0))) == 1.0
    assert [value(decay.tier_by_importance(F.lit(i))) for i in (8, 5, 4, 1)] == [0.1, 0.15, 0.2, 0.2]
    assert [value(decay.tier_scan(F.lit(i))) for i in (8, 5, 4, 3)] == [0.1, 0.15, 0.15, 0.2]


def test_decay_is_monotonic(spark):
    rows = spark.range(1, 60).select(decay.strength_after(F.lit(0.9), F.lit(0.1), F.col("id").cast("double")).alias("s")).collect()
    assert all(a["s"] >= b["s"] for a, b in zip(rows, rows[1:], strict=False))


def test_days_until(value):
    assert value(decay.days_until(F.lit(0.05), F.lit(0.1), 0.1)) == 0
    assert value(decay.days_until(F.lit(0.9), F.lit(0.0), 0.1)) is None
    assert math.isclose(value(decay.days_until(F.lit(0.8), F.lit(0.5), 0.4)), 1.0)


def test_numbers(value):
    assert value(numbers.unit(F.lit(float("nan")))) == 0 and value(numbers.unit(F.lit(1.7))) == 1 and value(numbers.unit(F.lit(None).cast("double"))) == 0
    assert value(numbers.r4(F.lit(0.12345))) == 0.1235 and value(numbers.non_negative(F.lit(-3.2))) == 0
    assert value(numbers.bytes_text(F.lit(2048))) == "2.0 KB" and value(numbers.compact(F.lit(3_400_000))) == "3.4M" and value(numbers.percent(F.lit(0.805))) == "81%"
    assert value(numbers.ratio(F.lit(1), F.lit(0))) == 0


def test_markdown_and_html(value):
    assert value(text.clean_message(F.lit("# Head\n\n**bold** [link](http://x) ![pic](y)\n- item\n> said"))) == "Head\nbold link\nitem\nsaid"
    assert value(text.strip_html(F.lit("<p>a &amp; b</p><td>x</td>"))) == "a & b\n\nx | "
    assert value(text.clean_text(F.lit("ﬁne — “q” \u00a0x\u200b"))) == 'fine -- "q" x'


def test_lines(value):
    page = "Header\nbody one\nHeader\nbody two\nHeader\nend"
    assert value(text.without_repeated_lines(F.lit(page))) == "body one\nbody two\nend"
    assert value(text.without_noise(F.lit("text stays\nhttps://x.org/a\n12 13 14 15 x\nDOI: 10.1/2\n\nmore"))) == "text stays\n\nmore"
    assert value(text.without_page_numbers(F.lit("a\n- 12 -\nPage 3 of 9\nb"))) == "a\nb"
    assert value(lines.without_back_matter(F.lit("a\nb\nc\nReferences\n[1] x"))) == "a\nb\nc"
    assert value(text.dehyphenated(F.lit("inter-\nnational"))) == "international"


def test_counts(value):
    assert value(text.token_estimate(F.lit("short considerable internationalisation"))) == 1 + (1 + 3) + (1 + 5 + 1)
    assert value(text.word_count(F.lit("  a b\n c "))) == 3 and value(text.paragraph_count(F.lit("a\n\nb\n \nc"))) == 3
    assert value(text.citation_count(F.lit("as [1, 2] and [2] say"))) == 2
    assert value(text.detect_language(F.lit("der Hund und die Katze"))) == "de" and value(text.detect_language(F.lit(""))) == "en"


def test_concepts(value):
    fragment = lambda s: value(text.is_fragment(F.lit(s)))
    assert [fragment(s) for s in ("ab", "Vector index", "It is a long one", "index of the", "a, b", "process", "one two three four five six seven")] == [True, False, True, True, True, True, True]
    assert value(text.restates(F.lit("Vector index"), F.lit("A vector index"))) is True
    assert value(text.restates(F.lit("Vector index"), F.lit("Structure that finds similar embeddings quickly without scanning everything"))) is False
    assert value(text.importance(F.lit("11"))) == 10 and value(text.importance(F.lit("x"))) == 5 and value(text.importance(F.lit("-2"))) == 1
    assert value(text.concept_type(F.lit("Known Issue"))) == "problem" and value(text.concept_type(F.lit(None).cast("string"))) == "fact"
    assert value(text.contradicts(F.lit("It always works"), F.lit("It never works"))) is True and value(text.contradicts(F.lit("same is"), F.lit("same is"))) is False
    assert value(text.clean_label(F.lit('- "Big idea".'))) == "Big idea" and value(text.relation_type(F.lit(" Depends_On "))) == "requires"


def test_questions(value):
    assert value(query.intent(F.lit("hello there!"))) == "chitchat" and value(query.intent(F.lit("compare a and b"))) == "compare" and value(query.intent(F.lit("ring?"))) == "explore"
    assert value(query.key_terms(F.lit("The ring bolt and the ring"))) == ["ring", "bolt", "ring bolt", "bolt ring"]
    assert value(query.specificity(F.lit("hi"))) == 0 and value(query.query_domain(F.lit("quantum particle"))) == "physics"
    assert value(query.preferred_types(F.lit("which error?"), F.lit("compare"))) == ["problem"]
    assert value(query.search_terms(F.array(F.lit("a%b"), F.lit("A b"), F.lit("x")))) == ["a b"]


def test_vectors(value):
    v = lambda *xs: F.array(*(F.lit(float(x)) for x in xs))
    assert math.isclose(value(vector.cosine(v(1, 0), v(1, 1))), 2**-0.5) and value(vector.cosine(v(0, 0), v(1, 1))) is None
    assert value(vector.cosine_clamped(v(1, 0), v(-1, 0))) == 0 and value(vector.cosine_clamped(v(1), v(1, 1))) == 0
    assert value(vector.valid(v(0, 0))) is False and value(vector.valid(v(1, float("inf")))) is False
    assert math.isclose(sum(value(vector.softmax(v(1, 2, 3)))), 1.0) and value(vector.lerp(v(0), v(2), 0.5)) == [1.0]
    assert value(vector.euclidean(v(0, 0), v(3, 4))) == 5 and value(vector.manhattan(v(0, 0), v(3, 4))) == 7 and value(vector.from_text(F.lit("[1,2.5]"))) == [1.0, 2.5]


def test_chunks_keep_all_words():
    body = "\n\n".join(" ".join(f"word{i}x{j}." for j in range(40)) for i in range(12))
    cut = lambda text: [c[0] for c in segment.chunks(text)]
    out = cut(body)
    assert " ".join(out).split() == body.split() and all(segment.tokens(c) <= 250 for c in out) and len(out) > 2
    assert cut("") == [] and cut("one") == ["one"]


def test_sections(spark, value):
    body = "# One\n" + "a b c. " * 800 + "\n# Two\n" + "d e f. " * 800
    df = spark.createDataFrame([(1, body), (2, "short")], "id long, content string")
    out = segment.sectioned(df).orderBy("id", "section_index").collect()
    assert [r["heading"] for r in out if r["id"] == 1] == ["One", "Two"] and all(len(r["section"]) <= 9600 for r in out)
    assert [(r["heading"], r["section"]) for r in out if r["id"] == 2] == [(None, "short")]
    assert len(segment.merged_to_limit([600] * 30, 20, 9600)) == 20
    assert value(lines.joined_lines(F.lit("this goes\non here.\nNext"))) == "this goes on here.\nNext"
    assert [s["heading"] for s in value(lines.text_sections(F.lit("1 First part\ntext\n1.1 Inner part\nmore")))] == ["First part", "Inner part"]


PATTERNS = [*(p for ps in text.DOMAINS.values() for p in ps), *text.BOOK_SIGNS, *text.TEXTBOOK_SIGNS, *text.NARRATIVE_SIGNS, r"\b(?:references|bibliography)\b", r"\b(?:chapter|unit)\s+[0-9]", r"\babstract\b", r"\b(?:introduction|method|methods|methodology|results|discussion|conclusion)\b"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_every_match_has_a_needle(pattern):
    found = text.needles(pattern)
    assert found and all(found)

    @settings(max_examples=60, deadline=None)
    @given(from_regex(re.compile(pattern, re.A)))
    def holds(match):
        assert any(x in match.lower() for x in found)

    holds()
