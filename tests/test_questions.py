"""Question analysis and concept filters against plain loops over whole tables."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from keepsake.adapters import Tables
from keepsake.functions import query as ask
from keepsake.functions import text

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
ASKED = [
    "What are the main contributions of this paper?", "hello", "How do I fix the broken deploy?", "thanks!", "Summarize my documents", "what results does it report, and the findings", "Which database is better: \"Postgres\" or MySQL 8?", "", "   ", "who decided the migration when?",
    "explain architecture of the system and problems it solves", "running tested boxes", "according to the document, why did the api crash", "How many papers are in my archive?", "a b c", "decision decision prefers like code error", "Tell me about the lessons and takeaways", "what is this about",
]


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, DATA)


def low(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) if x.isascii() else x.lower()


def terms_of(asked):
    words = [w for w in re.sub(r"[^a-z0-9\s-]", "", low(asked), flags=re.A).split() if len(w) > 2 and w not in ask.STOPWORDS]
    return list(dict.fromkeys(words)), list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def analysed_by_loop(asked):
    bare = asked.strip(" \t\n\r\f\v")
    quiet = 1 <= len(bare) <= 48 and any(re.search(p, bare, re.A) for p in ask.CHITCHAT)
    single, pairs = terms_of(asked)
    key = [] if quiet else (single + pairs)[:10]
    more = [x for phrase, found in ask.EXPANSIONS.items() if phrase in low(asked) for x in found]
    for x in (k for k in key if " " not in k and len(k) >= 4):
        more.append(x[:-1] if x.endswith("s") else f"{x}s")
        more += [x[:-3]] if x.endswith("ing") else []
        more += [x[:-2]] if x.endswith("ed") else []
    expanded = [] if quiet else list(dict.fromkeys(x for x in more if len(x) >= 3 and x not in ask.STOPWORDS))[:8]
    intent = "chitchat" if quiet else None
    for name, words in ask.INTENTS.items():
        if intent is None and any(low(bare).startswith(w) or f" {w} " in low(bare) for w in words):
            intent = name
    intent = intent or ("explore" if bare.endswith("?") else "recall")
    has = lambda patterns: any(re.search(p, asked, re.A) for p in patterns)
    types = [kind for kind, words in ask.TYPE_WORDS.items() if re.search(rf"\b({words})\b", low(asked))]
    types = types or list(ask.INTENT_TYPES.get(intent, ("fact", "entity", "decision")))
    scores = [sum(w in low(asked) for w in words) for words in ask.DOMAIN_WORDS.values()]
    domain = list(ask.DOMAIN_WORDS)[scores.index(max(scores))] if max(scores) >= 2 else "general"
    whole = any(p in low(asked) for p in ask.ABSTRACT_PHRASES) or has(ask.BROAD) or any(p in low(asked) for p in ask.EXPANSIONS)
    return {"is_chitchat": quiet, "intent": intent, "key_terms": key, "expanded_terms": expanded, "is_abstract": not quiet and whole, "document_scoped": not quiet and has(ask.SCOPED), "is_archive_question": not quiet and has(ask.ARCHIVE), "domain": "general" if quiet else domain, "preferred_types": [] if quiet else types[:4]}


def test_analysis_equals_a_loop(t):
    told = [r["content"] for r in t.messages.select("content").collect()] + ASKED
    rows = ask.analysed(t.spark.createDataFrame(list(enumerate(told)), "id long, text string")).collect()
    assert len(rows) == len(told) > 50
    for r in rows:
        expected = analysed_by_loop(told[r["id"]])
        assert {k: r[k] for k in expected} == expected, told[r["id"]][:200]


def test_a_models_reply_is_laid_over(t):
    replies = [
        None, "no json", "{}", json.dumps({"keyTerms": ["Alpha  BETA!", "the", "xy"], "expandedTerms": ["Gamma"], "intent": "debug", "domain": "law", "specificity": 1.7, "preferredTypes": ["CODE ", "none", "fact"], "isAbstractQuery": False, "documentScoped": True}),
        json.dumps({"intent": "nonsense", "isAbstractQuery": True, "specificity": 0.9, "preferredTypes": []}), json.dumps({"keyTerms": [f"term{i}" for i in range(30)], "domain": "  "}),
    ]
    cases = [(i, a, r) for i, (a, r) in enumerate((a, r) for a in ("How do I fix the broken deploy?", "who decided the migration when?") for r in replies)]
    df = ask.analysed(t.spark.createDataFrame(cases, "id long, text string, reply string"))
    before = {r["id"]: r for r in df.collect()}
    for r in ask.overlaid(df).collect():
        old, given = before[r["id"]], {}
        try:
            given = json.loads(cases[r["id"]][2] or "")
        except ValueError:
            pass
        joined = lambda new, was, most: list(dict.fromkeys(x for x in (re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s-]", "", x.lower())).strip() for x in [*new, *was]) if len(x) >= 3 and x not in ask.STOPWORDS))[:most] or was
        assert r["key_terms"] == joined(given.get("keyTerms", []), old["key_terms"], 12) and r["expanded_terms"] == joined(given.get("expandedTerms", []), old["expanded_terms"], 8)
        assert r["intent"] == (given["intent"] if given.get("intent") in ask.INTENTS else old["intent"]) and r["domain"] == ((given.get("domain") or "").strip() and given["domain"] or old["domain"])
        whole = old["is_abstract"] or given.get("isAbstractQuery", False)
        specific = min(1.0, max(0.0, given["specificity"])) if "specificity" in given else old["specificity"]
        assert r["is_abstract"] == whole and abs(r["specificity"] - (min(specific, 0.45) if whole else specific)) < 1e-9
        types = [x for x in (x.strip().lower() for x in given.get("preferredTypes", [])) if x in ask.TYPE_WORDS][:4]
        assert r["preferred_types"] == (types or old["preferred_types"]) and r["document_scoped"] == (old["document_scoped"] or given.get("documentScoped", False))


def fragment(label):
    bare = label.strip(" \t\n\r\f\v")
    if len(bare) < 3 or len(bare) > 80 or re.search(r"[!?;]|,\s|\.\s", bare, re.A):
        return True
    words = [re.sub("[^a-z]", "", w.lower()) for w in bare.split()]
    n = len(words)
    return n > 6 or (bool(words) and words[-1] in text.CONNECTORS) or (n >= 3 and (bool(re.match(r"(?i)(it|this|that|these|those|there|here|they|we|you|he|she)\s+", bare)) or any(w in text.FRAGMENT_VERBS for w in words))) or (n == 1 and words[0] in text.GENERIC_WORDS)


def plain_words(x):
    x = re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", "", x.lower(), flags=re.A), flags=re.A).strip()
    return [w for w in x.split(" ") if len(w) > 3 and w not in text.GENERIC_WORDS]


def root_of(word):
    return re.sub("(ing|tion|ment|ence|ance|ness|ity|ies|es|s)$", "", re.sub("[^a-z]", "", word.lower()))


def restated(label, definition):
    lab, words = plain_words(label), plain_words(definition)
    m = re.match(r"(?i)(?:the\s+)?(?:process|act|practice|concept|idea|system|method|notion)\s+of\s+([a-z]+)", definition.strip())
    root = root_of(m[1]) if m else ""
    short, whole = label.lower().strip(), definition.lower()
    if len(short) >= 4 and (whole == short or (short in whole and len(whole) < 4 * len(short))):
        return True
    fresh, shared = sum(w not in lab for w in words), sum(w in words for w in lab)
    overlap = shared / len(lab) if lab else 0.0
    same = root in "".join(lab) or any(w.startswith(root) or root.startswith(w[:4]) or root_of(w) == root for w in lab)
    return not words or fresh < 3 or (overlap >= 0.5 and fresh < 4) or (len(root) >= 3 and same)


def test_concept_filters_equal_a_loop(t):
    made = [("Caching", "The process of caching data for later"), ("it is what we have", "some longer definition of this thing here"), ("the", "nothing"), ("Query Planner", "Chooses join order from table statistics and indexes"), ("Query Planner", "A query planner"), ("wide-area network of", "links distant offices through leased lines"), ("x", "y"), ("Bolts, nuts and more", "fasteners sold by weight in boxes"), ("Routing", "concept of routes between hosts across networks")]
    rows = [(r["item_id"], r["label"], r["definition"]) for r in t.items.select("item_id", "label", "definition").collect()] + [(-i - 1, *m) for i, m in enumerate(made)]
    df = t.spark.createDataFrame(rows, "id long, label string, definition string")
    got = {r["id"]: r for r in df.select("id", text.is_fragment(F.col("label")).alias("fragment"), text.restates(F.col("label"), F.col("definition")).alias("restates"), text.is_low_quality(F.col("label"), F.col("definition")).alias("low")).collect()}
    for i, label, definition in rows:
        f, r = fragment(label), restated(label, definition)
        low_quality = len(label.strip()) < 3 or len(definition.strip()) < 12 or f or r
        assert (got[i]["fragment"], got[i]["restates"], got[i]["low"]) == (f, r, low_quality), (label, definition[:100])
    assert {got[-i - 1]["low"] for i in range(len(made))} == {True, False}
    assert __spark_entry__.queries()["concept_quality_filter"](t.spark, DATA).count() == t.items.count()
