"""Registered queries: texts, questions, scoring and assembly, parsing, ingestion, exports, vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import query as ask
from ..functions import text, vector
from ..functions.numbers import settled as r4
from ..operators import scoring
from ..schema import AS_OF
from ..sources import conversations, formats, store
from . import ingest, retrieve
from .catalog import AS_OF_SQL, best_of, distinct, domain_rows, holds, matches, query, quoted, trimmed, words
from .catalog import settled as sql_r4


def body():
    """The text of a document or message."""
    return F.col("content")


WORDS = r"list_filter(regexp_split_to_array(content, '[ \t\n\r\f\v]+'), lambda w: w <> '')"


def of_documents(t, **columns):
    return t.documents.select("document_id", *(c.alias(n) for n, c in columns.items()))


@query("word_counts", rf"SELECT document_id, CAST(len({WORDS}) AS BIGINT) AS words, CAST(len(list_filter(regexp_split_to_array(content, '\n[ \t\n\r\f\v]*\n'), lambda p: regexp_matches(p, '[^ \t\n\r\f\v]'))) AS BIGINT) AS paragraphs FROM m_documents")
def _(t):
    return of_documents(t, words=text.word_count(body()), paragraphs=text.paragraph_count(body()))


@query("token_estimate", f"SELECT document_id, CAST(coalesce(list_sum(list_transform({WORDS}, lambda w: 1 + CASE WHEN length(w) > 6 THEN length(w) // 4 ELSE 0 END + CASE WHEN length(w) > 12 THEN 1 ELSE 0 END)), 0) AS BIGINT) AS tokens, CAST(coalesce(list_sum(list_transform({WORDS}, lambda w: 1 + CASE WHEN length(w) > 6 THEN length(w) // 4 - 1 ELSE 0 END)), 0) AS BIGINT) AS light FROM m_documents")
def _(t):
    return of_documents(t, tokens=text.token_estimate(body()), light=text.token_estimate_light(body()))


def of_language(words: str) -> str:
    return f"len(list_filter([{', '.join(repr(w) for w in words)}], lambda w: list_contains(ws, w)))"


@query("language_detect", r"WITH w AS (SELECT document_id, regexp_split_to_array(lower(substr(content, 1, 2000)), '[ \t\n\r\f\v]+') AS ws FROM m_documents), s AS (SELECT document_id, " + ", ".join(f"{of_language(ws)} AS {k}" for k, ws in text.LANGUAGE_WORDS.items()) + " FROM w) SELECT document_id, CASE greatest(en, es, fr, de) WHEN en THEN 'en' WHEN es THEN 'es' WHEN fr THEN 'fr' ELSE 'de' END AS language FROM s")
def _(t):
    return of_documents(t, language=text.detect_language(body()))


#: What structure_flags looks for, as SQL.
FLAGS = {
    "has_references": matches("content", [r"(?im)(?:^|\n)\s*(?:references|bibliography|works\s+cited)\s*$"]),
    "has_formulas": matches("content", [r"\$[^$]+\$", r"\\frac\{|\\sum\b|\\int\b", "[∑∏∫∂∇√∞≈≠≤≥±]"]),
    "has_code": matches("content", [r"(?s)```.*?```", r"(?:^|\n)(?:def |class |import |from |function |const |let |var )"]),
    "has_tables": matches("content", [r"\|[^|]+\|[^|]+\|", r"\t[^\t]+\t[^\t]+\t"]),
    "has_images": matches("content", [r"(?i)fig(?:ure)?\.?\s*[0-9]+"]),
    "has_numbered_sections": r"len(regexp_extract_all(content, '(?m)^([0-9]+\.\s+[A-Z])', 1)) >= 2",
}
CITATIONS = r"CAST(len(list_distinct(flatten(list_transform(regexp_extract_all(content, '(\[[0-9]+(?:[, \-]+[0-9]+)*\])', 1), lambda g: regexp_extract_all(g, '([0-9]+)', 1))))) AS BIGINT)"


@query("structure_flags", f"SELECT document_id, {', '.join(f'{sql} AS {name}' for name, sql in FLAGS.items())}, {CITATIONS} AS citations FROM m_documents")
def _(t):
    return of_documents(t, **text.structure_flags(body()), citations=text.citation_count(body()))


@query("concept_counts_asked", f"SELECT document_id, CAST(CASE WHEN n < 500 THEN 1 WHEN n < 3000 THEN 3 ELSE 10 END AS INT) AS required, CAST(least(greatest(floor(n / 350.0 + 0.5), 3), 12) AS INT) AS target FROM (SELECT document_id, len({WORDS}) AS n FROM m_documents)")
def _(t):
    return of_documents(t, required=text.required_concepts(text.word_count(body())), target=text.target_concepts(text.word_count(body())))


def duck(step: tuple[str, str], inner: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return f"regexp_replace({inner}, {quoted(step[0])}, {quoted(step[1].replace('$1', chr(92) + '1'))}, 'g')"


def cleaned_sql() -> str:
    out = "content"
    for step in text.MARKDOWN:
        out = duck(step, out)
    lines = f"list_filter(list_transform(string_split({out}, chr(10)), lambda x: regexp_replace(x, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g')), lambda x: x <> '')"
    return f"trim(regexp_replace(array_to_string({lines}, chr(10)), '[ \\t]+', ' ', 'g'))"


@query("markdown_clean", f"SELECT message_id, sha256({cleaned_sql()}) AS digest FROM m_messages")
def _(t):
    return t.messages.select("message_id", F.sha2(text.clean_message(body()).cast("binary"), 256).alias("digest"))


HTML = [(r"(?i)<br\s*/?>", "\n"), (r"(?i)</p>", "\n\n"), (r"(?i)</(div|li|tr)>", "\n"), (r"(?i)</td>", " | "), (r"<[^>]+>", ""), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), (r"\n{3,}", "\n\n")]


def html_sql() -> str:
    out = "html"
    for step in HTML:
        out = duck(step, out)
    return out


@query("html_strip", f"SELECT page_id, sha256({html_sql()}) AS digest FROM pages")
def _(t):
    return t.raw("pages").select("page_id", F.sha2(text.strip_html(F.col("html")).cast("binary"), 256).alias("digest"))


@query("html_sections")
def _(t):
    rows = t.raw("pages").select("page_id", F.lit("html").alias("format"), F.col("html").alias("text"))
    return formats.parsed(rows).select("page_id", F.size("sections").alias("sections"), F.length("text").alias("characters"))


@query("repeated_line_removal", r"""
WITH l AS (SELECT document_id, unnest(string_split(content, chr(10))) AS line, unnest(range(len(string_split(content, chr(10))))) AS i, len(string_split(content, chr(10))) AS n FROM m_documents),
t AS (SELECT *, regexp_replace(line, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g') AS bare FROM l),
c AS (SELECT *, count(*) OVER (PARTITION BY document_id, bare) AS k FROM t)
SELECT d.document_id, sha256(coalesce(k.rest, '')) AS digest FROM m_documents d LEFT JOIN (SELECT document_id, string_agg(line, chr(10) ORDER BY i) AS rest FROM c WHERE NOT (length(bare) BETWEEN 3 AND 120 AND k >= greatest(3, CAST(floor(n * 0.2) AS INT))) GROUP BY 1) k ON k.document_id = d.document_id""")
def _(t):
    return of_documents(t, digest=F.sha2(text.without_repeated_lines(body()).cast("binary"), 256))


NOISE_SQL = f"""WITH l AS (SELECT document_id, list_transform(string_split(content, chr(10)), lambda x: {trimmed('x')}) AS lines FROM m_documents)
SELECT document_id,
 CAST(greatest(1, len(list_filter(lines, lambda x: NOT (x <> '' AND (regexp_matches(x, {quoted(text.NOISE_PATTERN)}) OR (len({words('x')}) > 2 AND len(regexp_extract_all(x, '([0-9]+\\.?[0-9]*)', 1)) / len({words('x')}) > 0.6)))))) AS INT) AS kept,
 CAST(greatest(1, len(list_filter(lines, lambda x: NOT {matches('x', text.PAGE_NUMBERS)} AND NOT (length(x) <= 80 AND {matches('x', text.WATERMARKS)})))) AS INT) AS unmarked FROM l"""


@query("noise_line_filter", NOISE_SQL)
def _(t):
    return of_documents(t, kept=F.size(text.lines_of(text.without_noise(body()))), unmarked=F.size(text.lines_of(text.without_watermarks(text.without_page_numbers(body())))))


@query("fixed_window_chunks", "WITH s AS (SELECT document_id, unnest(range(0, length(content), 1300)) AS pos, content FROM m_documents WHERE length(content) > 0), c AS (SELECT document_id, pos, trim(substr(content, CAST(pos + 1 AS BIGINT), 1500), ' ') AS chunk FROM s) SELECT document_id, count(*) AS chunks, CAST(sum(length(chunk)) AS BIGINT) AS characters FROM c WHERE length(chunk) > 30 GROUP BY 1")
def _(t):
    rows = t.documents.select("document_id", F.explode(text.window_chunks(body())).alias("chunk"))
    return rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("chunk")).cast("long").alias("characters"))


def signs(column: str, patterns) -> str:
    return " + ".join(f"CAST(regexp_matches({column}, {quoted(p)}) AS INT)" for p in patterns)


FIELD_SQL = f"""{{}},
f AS (SELECT document_id, lower(filename) AS name, substr(lower(content), 1, 8000) AS low, {matches('content', [r'(?m)^#\s+'])} AS headed, len({WORDS}) AS words, {signs('content', text.BOOK_SIGNS)} AS book, {signs('content', text.TEXTBOOK_SIGNS)} AS textbook, {signs('substr(content, 1, 15000)', text.NARRATIVE_SIGNS)} AS told FROM m_documents),
g AS (SELECT *, {matches('name', [r'[0-9]{4}\.[0-9]{4,5}(v[0-9]+)?|arxiv'])} OR ({matches('low', [r'\b(?:references|bibliography)\b'])} AND {matches('low', [r'\b(introduction|method|methods|methodology|results|discussion|conclusion)\b', r'\babstract\b'])}) AS paper, {matches('low', [r'\b(chapter|unit)\s+[0-9]'])} AS unit FROM f)
SELECT document_id, domain, CASE WHEN {matches('name', [r'\.(py|ts|js|java|go|rs|cpp|c|rb|php|swift|kt|scala|sh|bash)$'])} THEN 'code' WHEN {matches('name', [r'\.(md|markdown)$'])} THEN CASE WHEN headed THEN 'documentation' ELSE 'notes' END WHEN {matches('name', [r'\.txt$'])} THEN CASE WHEN headed THEN 'notes' ELSE 'other' END
 WHEN NOT {matches('name', [r'\.(pdf|docx)$'])} THEN 'other' WHEN paper THEN 'research-paper' WHEN textbook >= 3 THEN 'textbook' WHEN told >= 3 OR (told >= 2 AND book >= 2) THEN 'book' WHEN book >= 2 OR (book >= 1 AND words > 10000) THEN 'book' WHEN unit AND textbook >= 1 THEN 'textbook' WHEN unit OR words > 20000 THEN 'book' ELSE 'report' END AS field
FROM g JOIN dom USING (document_id)"""


@query("domain_classify", FIELD_SQL.replace("{}", "WITH " + domain_rows(text.DOMAINS), 1))
def _(t):
    return of_documents(t, domain=text.content_domain(body(), F.col("filename")), field=text.field_type(body(), F.col("filename")))


CUT_SQL = """WITH h AS (SELECT document_id, content, substr(content, 1, 200) AS head, strpos(reverse(substr(content, 1, 200)), '.') AS dot, strpos(reverse(substr(content, 1, 200)), ' ') AS gap FROM m_documents)
SELECT document_id, sha256(CASE WHEN length(content) <= 200 THEN content WHEN dot > 0 AND 201 - dot > 100 THEN substr(head, 1, 201 - dot) WHEN gap > 0 AND 201 - gap > 100 THEN substr(head, 1, 200 - gap) ELSE head END) AS digest FROM h"""


@query("embedding_text_cut", CUT_SQL)
def _(t):
    return of_documents(t, digest=F.sha2(text.cut_at_boundary(body(), 200).cast("binary"), 256))


@query("content_digest", "SELECT document_id, sha256(content) AS digest FROM m_documents")
def _(t):
    return of_documents(t, digest=F.sha2(body().cast("binary"), 256))


@query("concept_quality_filter")
def _(t):
    label, definition = F.col("label"), F.col("definition")
    return t.items.select("item_id", text.is_fragment(label).alias("fragment"), text.restates(label, definition).alias("restates"), text.is_low_quality(label, definition).alias("low_quality"))


@query("structural_labels", "SELECT bucket_id, lower(trim(x)) IN ('conclusion', 'conclusions', 'related work', 'references', 'acknowledgments', 'bibliography', 'appendix', 'table of contents', 'abstract', 'introduction', 'overview', 'summary') AS structural FROM (SELECT bucket_id, CASE bucket_id % 3 WHEN 0 THEN ' Related Work' WHEN 1 THEN 'Abstract' ELSE canonical END AS x FROM m_buckets)")
def _(t):
    x = F.when(F.col("bucket_id") % 3 == 0, " Related Work").when(F.col("bucket_id") % 3 == 1, "Abstract").otherwise(F.col("canonical"))
    return t.buckets.select("bucket_id", text.is_structural(x).alias("structural"))


@query("concept_normalisation", "SELECT bucket_id, CASE bucket_id % 4 WHEN 0 THEN 'problem' WHEN 1 THEN 'decision' WHEN 2 THEN 'entity' ELSE 'fact' END AS concept_type, CAST(CASE WHEN bucket_id % 4 = 3 THEN 5 ELSE least(greatest(importance * 2 - 3, 1), 10) END AS INT) AS importance, CASE bucket_id % 4 WHEN 0 THEN 'causes' WHEN 1 THEN 'requires' ELSE 'related_to' END AS relation_type FROM m_buckets")
def _(t):
    k = F.col("bucket_id") % 4
    kind = F.when(k == 0, "Known Issue").when(k == 1, "a choice").when(k == 2, "Organisation").otherwise("whatever")
    relation = F.when(k == 0, "caused_by").when(k == 1, " Depends_On").otherwise("unknown")
    value = F.when(k == 3, "none").otherwise((F.col("importance") * 2 - 3).cast("string"))
    return t.buckets.select("bucket_id", text.concept_type(kind).alias("concept_type"), text.importance(value).alias("importance"), text.relation_type(relation).alias("relation_type"))


#: Questions of several kinds, asked of tenants in turn.
QUESTIONS = [
    "What was the decision about the database migration?", "hello", "Summarize my documents", "Compare Python and TypeScript for the server project", "What problem does it solve?", "why did the build fail with error 42?", "Tell me about \"ring bolt\" in this document",
    "Is it true that the contract was signed by Anna Schmidt?", "how many documents are in my archive", "next step for the ring system", "what are the results and the accuracy of the benchmark", "thanks!", "ring", "",
]


def questions(t):
    rows = [(i, i % 5, q) for i, q in enumerate(QUESTIONS)]
    return t.spark.createDataFrame(rows, "question_id long, user_id long, text string")


@query("query_analysis")
def _(t):
    out = ask.analysed(t.messages.select("message_id", body().alias("text")))
    return out.select("message_id", "is_chitchat", "intent", F.array_join("key_terms", "|").alias("key_terms"), F.array_join("expanded_terms", "|").alias("expanded_terms"), r4(F.col("specificity")).alias("specificity"), "is_abstract", "document_scoped", "is_archive_question", "domain", F.array_join("preferred_types", "|").alias("preferred_types"))


def is_any(word: str, values) -> str:
    return f"regexp_matches({word}, {quoted('^(?:' + '|'.join(values) + ')$')})"


def chitchat(x: str) -> str:
    return f"(length({trimmed(x)}) BETWEEN 1 AND 48 AND {matches(trimmed(x), ask.CHITCHAT)})"


TARGETS = ", ".join(f"CASE WHEN regexp_matches(content, {quoted(p)}) THEN [{', '.join(map(quoted, ts))}] ELSE [] END" for p, ts in ((ask.RESULTS_ASKED, ask.RESULT_TERMS), (ask.MAIN_ASKED, ask.MAIN_TERMS), (ask.PROBLEM_ASKED, ask.PROBLEM_TERMS)))
FIT = r"trim(regexp_replace(regexp_replace(lower(x), '[%_\\]', ' ', 'g'), '\s+', ' ', 'g'))"
KEY_TERMS_SQL = rf"""WITH u AS (SELECT message_id, content, list_filter({words("regexp_replace(lower(content), '[^a-z0-9" + chr(92) + "s-]', '', 'g')")}, lambda w: length(w) > 2 AND NOT {is_any('w', ask.STOPWORDS)}) AS w FROM m_messages),
p AS (SELECT *, list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])) AS pairs FROM u),
k AS (SELECT message_id, list_slice(list_concat({distinct('w')}, {distinct('pairs')}), 1, 10) AS terms, flatten([{TARGETS}]) AS asked FROM p),
s AS (SELECT *, list_filter(list_transform(terms, lambda x: {FIT}), lambda x: length(x) >= 2) AS fit FROM k)
SELECT message_id, array_to_string(terms, '|') AS terms, array_to_string({distinct('fit')}, '|') AS search_terms, array_to_string(list_slice({distinct('asked')}, 1, 12), '|') AS targets FROM s"""


@query("query_key_terms", KEY_TERMS_SQL)
def _(t):
    return t.messages.select("message_id", F.array_join(ask.key_terms(body()), "|").alias("terms"), F.array_join(ask.search_terms(ask.key_terms(body())), "|").alias("search_terms"), F.array_join(ask.target_terms(body()), "|").alias("targets"))


@query("query_intent", f"SELECT message_id, CASE WHEN {chitchat('content')} THEN 'chitchat' " + " ".join(f"WHEN " + " OR ".join(f"starts_with(low, '{w}') OR contains(low, ' {w} ')" for w in ws) + f" THEN '{k}'" for k, ws in ask.INTENTS.items()) + r" WHEN ends_with(low, '?') THEN 'explore' ELSE 'recall' END AS intent FROM (SELECT message_id, regexp_replace(lower(content), '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g') AS low, content FROM m_messages)")
def _(t):
    return t.messages.select("message_id", ask.intent(body()).alias("intent"))


NAMES = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
QUOTES = "\"[^\"]+\"|'[^']+'"
SHARE = f"CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: NOT {is_any('x', ask.STOPWORDS)})) / len(w) ELSE 0.0 END"
RAW = f"least(greatest({SHARE} + len(regexp_extract_all(content, {quoted(NAMES)})) * 0.1 + CASE WHEN {matches('content', [QUOTES])} THEN 0.15 ELSE 0 END + CASE WHEN {matches('content', [r'\b[0-9]+(?:\.[0-9]+)?%?\b'])} THEN 0.1 ELSE 0 END - CASE WHEN {matches('content', ask.BROAD)} THEN 0.2 ELSE 0 END, 0), 1)"
OF_DOMAIN = ", ".join(f"len(list_filter([{', '.join(map(quoted, ws))}], lambda v: contains(low, v)))" for ws in ask.DOMAIN_WORDS.values())
SPECIFICITY_SQL = f"""WITH a AS (SELECT message_id, content, lower(content) AS low, {words('lower(content)')} AS w FROM m_messages),
b AS (SELECT *, {RAW} AS raw, [{OF_DOMAIN}] AS s, {holds('low', ask.ABSTRACT_PHRASES)} OR {matches('content', ask.BROAD)} OR {holds('low', ask.EXPANSIONS)} AS abstract, {matches('content', ask.SCOPED)} AS scoped FROM a)
SELECT message_id, CAST({sql_r4(f"CASE WHEN {chitchat('content')} THEN 0.0 WHEN abstract OR scoped THEN least(raw, 0.45) ELSE raw END")} AS DOUBLE) AS specificity, {best_of('s', ask.DOMAIN_WORDS)} AS domain, {matches('content', [r'(?i)\b(it|this|that|these|the document|the paper|the file|the book|again|more|overview|summary|summarize|read)\b'])} AS follow_up FROM b"""


@query("query_specificity", SPECIFICITY_SQL)
def _(t):
    return t.messages.select("message_id", r4(ask.specificity(body())).alias("specificity"), ask.query_domain(body()).alias("domain"), ask.is_follow_up(body()).alias("follow_up"))


TOPICS_FOUND = "flatten([" + ", ".join(f"regexp_extract_all(content, {quoted(p)}, 1)" for p in ask.TOPICS) + "])"
REPLY_SQL = f"""WITH a AS (SELECT message_id, content, lower(content) AS low, list_filter(list_transform({TOPICS_FOUND}, lambda x: {trimmed('x')}), lambda x: length(x) BETWEEN 2 AND 50) AS found FROM m_messages WHERE role = 'assistant')
SELECT message_id, {holds('low', ask.CONFIRMING)} AS confirms, {holds('low', ask.NEWS)} AS has_news, array_to_string(list_filter([{', '.join(f"CASE WHEN {holds('low', ps)} THEN {quoted(n)} END" for n, ps in ask.HINTS.items())}], lambda x: x IS NOT NULL), '|') AS hints,
 array_to_string(list_slice({distinct('found')}, 1, 10), '|') AS topics, {holds('low', ask.NEWS)} OR len({words('content')}) > 20 AS reingest FROM a"""


@query("reply_signs", REPLY_SQL)
def _(t):
    signs = ask.reply_signs(body())
    return t.messages.filter("role = 'assistant'").select("message_id", *(F.array_join(c, "|").alias(k) if k in ("hints", "topics") else c.alias(k) for k, c in signs.items()))


def candidates(t):
    """Memories as candidates of one question each, with scores that follow from their ids."""
    b = t.buckets.join(t.items.filter("item_id % 2 = 0").select("bucket_id", "definition", "source"), "bucket_id")
    n = F.col("bucket_id")
    terms = F.array(F.lit("ring"), F.lit("bolt"))
    return b.select("*", (n % 25).alias("question_id"), ((n * 7 % 100) / 100.0).alias("vector_score"), ((n % 3 == 0).cast("double")).alias("text_score"), ((n % 5) / 4.0).alias("graph_score"), ((n * 3 % 10) / 10.0).alias("connectivity"), (n % 11 == 1).alias("to_current"), (n % 13 == 2).alias("to_recent"), F.lit("").alias("significance"), terms.alias("key_terms"), F.array().cast("array<string>").alias("expanded_terms"), F.array(F.lit("fact"), F.lit("code")).alias("preferred_types"), (n % 2 == 0).alias("is_abstract"), F.lit(False).alias("document_scoped"), F.lit(None).cast("long").alias("current_document"), F.lit("recall").alias("intent"), F.lit(0.3).alias("specificity"), F.lit(False).alias("is_chitchat"), F.col("strength").alias("current"))


SCORED = f"""
WITH c AS (SELECT b.*, i.definition, i.source, b.bucket_id % 25 AS question_id, (b.bucket_id * 7 % 100) / 100.0 AS v, CASE WHEN b.bucket_id % 3 = 0 THEN 1.0 ELSE 0.0 END AS t, (b.bucket_id % 5) / 4.0 AS g, (b.bucket_id * 3 % 10) / 10.0 AS k FROM m_buckets b JOIN m_items i ON b.bucket_id = i.bucket_id AND i.item_id % 2 = 0),
p AS (SELECT *, least(1.0, (0.5 * v + 0.3 * t + 0.2 * g) * CASE WHEN concept_type IN ('fact', 'code') THEN 1.15 ELSE 1.0 END) AS semantic, exp(-0.1 * (epoch_us({AS_OF_SQL}) - epoch_us(last_accessed)) / 3600000000.0) AS recency,
 least(1.0, k + CASE WHEN bucket_id % 11 = 1 THEN 0.1 ELSE 0 END + CASE WHEN bucket_id % 13 = 2 THEN 0.05 ELSE 0 END) AS conn, lower(canonical) AS low,
 CASE WHEN contains(lower(canonical), 'ring') THEN 2 WHEN contains(lower(definition), 'ring') THEN 1 ELSE 0 END + CASE WHEN contains(lower(canonical), 'bolt') THEN 2 WHEN contains(lower(definition), 'bolt') THEN 1 ELSE 0 END AS hits FROM c),
o AS (SELECT *, regexp_matches(low, 'overview|summary|introduction|abstract|preface') AS ov FROM p),
s AS (SELECT *, CAST(0.45 * semantic + 0.30 * strength + 0.25 * recency + 0.12 * conn
 + CASE WHEN bucket_id % 2 = 0 AND importance >= 9 THEN 0.35 WHEN bucket_id % 2 = 0 AND importance >= 8 THEN 0.25 WHEN bucket_id % 2 = 0 AND importance >= 7 THEN 0.15 WHEN importance >= 9 THEN 0.1 ELSE 0 END
 + CASE WHEN bucket_id % 2 = 0 AND ov AND importance >= 8 THEN 0.3 WHEN bucket_id % 2 = 0 AND ov THEN 0.15 ELSE 0 END + CASE WHEN hits >= 6 THEN 0.15 WHEN hits >= 4 THEN 0.1 WHEN hits >= 2 THEN 0.05 ELSE 0 END
 - CASE WHEN low IN ('introduction', 'conclusion', 'summary', 'overview', 'background', 'related work', 'methodology', 'discussion', 'references', 'acknowledgments') THEN 0.05 WHEN concept_type = 'fact' AND importance <= 3 AND length(definition) < 30 THEN 0.03 ELSE 0 END AS DOUBLE) AS raw FROM o),
w AS (SELECT *, max(raw) OVER q AS hi, max(raw) OVER q - min(raw) OVER q AS spread, count(*) OVER q AS n, row_number() OVER (PARTITION BY question_id ORDER BY round(raw, 9) DESC, bucket_id) AS rank FROM s WINDOW q AS (PARTITION BY question_id)),
x AS (SELECT *, exp((raw - hi) / greatest(spread, 0.1)) AS e FROM w), y AS (SELECT *, CASE WHEN spread < 0.001 THEN 1.0 / n ELSE e / sum(e) OVER (PARTITION BY question_id) END AS share FROM x)"""


@query("semantic_score", f"{SCORED} SELECT bucket_id, CAST({sql_r4('semantic')} AS DOUBLE) AS semantic, CAST({sql_r4('raw')} AS DOUBLE) AS raw FROM s")
def _(t):
    return scoring.raw_relevance(candidates(t), AS_OF).select("bucket_id", r4(F.col("semantic")).alias("semantic"), r4(F.col("raw")).alias("raw"))


@query("relevance_softmax", f"{SCORED} SELECT question_id, bucket_id, CAST({sql_r4('share')} AS DOUBLE) AS relevance, CAST(rank AS INT) AS rank FROM y WHERE rank <= 20")
def _(t):
    return scoring.softmax_ranked(scoring.raw_relevance(candidates(t), AS_OF)).select("question_id", "bucket_id", "relevance", "rank")


@query("source_cap_diversity", f"{SCORED}, z AS (SELECT question_id, bucket_id, rank, n, row_number() OVER (PARTITION BY question_id, coalesce(source, 'unknown') ORDER BY rank) AS nth FROM y WHERE rank <= 20), f AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN nth > 3 THEN 1 ELSE 0 END, rank) AS position FROM z) SELECT question_id, bucket_id, CAST(position AS INT) AS position FROM f WHERE position <= 6")
def _(t):
    ranked = scoring.softmax_ranked(scoring.raw_relevance(candidates(t), AS_OF))
    return scoring.source_capped(ranked, 6).select("question_id", "bucket_id", "position")


@query("greedy_budget")
def _(t):
    ranked = scoring.softmax_ranked(scoring.raw_relevance(candidates(t), AS_OF)).withColumn("budget", F.lit(8))
    return scoring.within_budget(ranked).select("question_id", "bucket_id", "concept_type")


@query("budget_size", "SELECT n AS candidates, s AS specificity, CAST(CASE WHEN n = 0 THEN 0 ELSE greatest(1, least(CASE WHEN s > 0.8 THEN 12 WHEN s > 0.5 THEN 16 ELSE 20 END, n)) END AS INT) AS budget FROM (SELECT CAST(bucket_id % 40 AS INT) AS n, CAST(bucket_id % 10 AS DOUBLE) / 10 AS s FROM m_buckets)")
def _(t):
    n, s = (F.col("bucket_id") % 40).cast("int"), (F.col("bucket_id") % 10).cast("double") / 10
    return t.buckets.select(n.alias("candidates"), s.alias("specificity"), scoring.budget_of(s, n).alias("budget"))


@query("type_priority_sort", "SELECT bucket_id, concept_type, CAST(row_number() OVER (ORDER BY CASE concept_type WHEN 'decision' THEN 0 WHEN 'problem' THEN 1 WHEN 'fact' THEN 2 WHEN 'code' THEN 3 WHEN 'entity' THEN 4 WHEN 'event' THEN 5 ELSE 6 END, strength DESC, bucket_id) AS INT) AS place FROM m_buckets WHERE document_id = 7")
def _(t):
    from pyspark.sql import Window

    return t.buckets.filter("document_id = 7").select("bucket_id", "concept_type", F.row_number().over(Window.orderBy(scoring.type_order(F.col("concept_type")), F.desc("strength"), "bucket_id")).alias("place"))


@query("candidate_merge", "WITH a AS (SELECT bucket_id, (bucket_id * 7 % 100) / 100.0 AS v, 0.0 AS x FROM m_buckets WHERE bucket_id % 2 = 0 UNION ALL SELECT bucket_id, 0.0, 1.0 FROM m_buckets WHERE bucket_id % 3 = 0) SELECT bucket_id, CAST(max(v) AS DOUBLE) AS vector_score, CAST(max(x) AS DOUBLE) AS text_score FROM a GROUP BY 1 ORDER BY max(v) + 0.25 * max(x) DESC, 1 LIMIT 80")
def _(t):
    n = F.col("bucket_id")
    a = t.buckets.filter(n % 2 == 0).select("bucket_id", ((n * 7 % 100) / 100.0).alias("vector_score"), F.lit(0.0).alias("text_score"))
    b = t.buckets.filter(n % 3 == 0).select("bucket_id", F.lit(0.0).alias("vector_score"), F.lit(1.0).alias("text_score"))
    merged = a.unionByName(b).groupBy("bucket_id").agg(F.max("vector_score").alias("vector_score"), F.max("text_score").alias("text_score"))
    return merged.orderBy(F.desc(F.round(F.col("vector_score") + 0.25 * F.col("text_score"), 9)), "bucket_id").limit(80)


@query("serverless_additive_score", f"WITH v AS (SELECT bucket_id, (bucket_id * 7 % 100) / 100.0 AS s FROM m_buckets), h AS (SELECT bucket_id, 0 AS i FROM m_buckets WHERE canonical ILIKE '%ring%' UNION ALL SELECT bucket_id, 1 FROM m_buckets WHERE canonical ILIKE '%bolt%') SELECT bucket_id, CAST({sql_r4('sum(p)')} AS DOUBLE) AS score FROM (SELECT bucket_id, s AS p FROM v WHERE s > 0.3 UNION ALL SELECT bucket_id, 1 - 0.5 * i / 2 FROM h) GROUP BY 1")
def _(t):
    n = F.col("bucket_id")
    near = t.buckets.select("bucket_id", ((n * 7 % 100) / 100.0).alias("similarity"))
    hits = t.buckets.filter(F.col("canonical").ilike("%ring%")).select("bucket_id", F.lit(0).alias("term_place")).unionByName(t.buckets.filter(F.col("canonical").ilike("%bolt%")).select("bucket_id", F.lit(1).alias("term_place")))
    return scoring.additive_scores(near, hits, 2).select("bucket_id", r4(F.col("score")).alias("score"))


def vector_questions(t):
    """Questions with the vectors of memories that stand for them."""
    vectors = t.embeddings.select(F.col("bucket_id").alias("v"), F.col("embedding").alias("vector"))
    return questions(t).join(vectors, F.col("question_id") * 10 == F.col("v")).drop("v").withColumn("current_document", F.lit(None).cast("long"))


@query("retrieve")
def _(t):
    return retrieve.retrieve(t, vector_questions(t), AS_OF).select("question_id", "bucket_id", "relevance", "rank")


@query("assemble_context")
def _(t):
    return retrieve.assemble(retrieve.retrieve(t, vector_questions(t), AS_OF)).select("question_id", "memories", F.length("context").alias("characters"))


ASKED = "What does doc-12.txt say?"
TARGET_SQL = f"""WITH n AS (SELECT document_id, filename, lower(filename) AS name, trim(regexp_replace(regexp_replace(lower(filename), '\\.[^.]+$', ''), '[_.\\-]+', ' ', 'g')) AS base FROM m_documents),
s AS (SELECT document_id, filename, CAST(CASE WHEN contains({quoted(ASKED.lower())}, name) THEN 8 ELSE 0 END + CASE WHEN contains({quoted(ASKED.lower())}, base) THEN 6 ELSE 0 END + CASE WHEN length(replace(base, ' ', '')) > 5 AND contains({quoted("".join(ASKED.lower().split()))}, replace(base, ' ', '')) THEN 5 ELSE 0 END
 + coalesce(list_sum(list_transform(list_filter(list_distinct(string_split(base, ' ')), lambda w: w IN ('what', 'does', 'doc', 'txt', 'say')), lambda w: CASE WHEN w IN ('document', 'paper', 'file', 'pdf', 'text', 'doc', 'docx', 'book', 'report', 'article', 'notes') THEN 0.5 WHEN length(w) >= 5 THEN 3 ELSE 2 END)), 0) AS DOUBLE) AS score FROM n),
o AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS second FROM s WHERE score >= 2.5 WINDOW w AS (ORDER BY score DESC, length(filename), document_id))
SELECT document_id, filename, score FROM o WHERE k = 1 AND (second IS NULL OR second < score - 1)"""


@query("target_document", TARGET_SQL)
def _(t):
    return scoring.title_match(t.documents.select("document_id", "filename"), ASKED)


@query("ingest_documents")
def _(t):
    known = t.documents.filter("document_id % 2 = 0")
    from ..operators import merge

    result = ingest.ingest(t.documents.filter("document_id % 2 = 1"), known, merge.merged_buckets(t.buckets), AS_OF)
    return result["concepts"].groupBy("document_id").agg(F.count(F.lit(1)).alias("concepts"), F.max("importance").alias("importance"), F.sum(F.size("related")).alias("related"))


@query("json_repair", "SELECT bucket_id, CASE WHEN bucket_id % 5 = 4 THEN 0 ELSE 1 END AS concepts, CASE WHEN bucket_id % 5 < 4 THEN canonical END AS label FROM m_buckets")
def _(t):
    k = F.col("bucket_id") % 5
    one = F.concat(F.lit('{"label": "'), F.col("canonical"), F.lit('", "definition": "what it is", "importance": 7}'))
    reply = F.when(k == 0, F.concat(F.lit("["), one, F.lit("]"))).when(k == 1, F.concat(F.lit("Here:\n```json\n["), one, F.lit(",]\n```"))).when(k == 2, F.concat(F.lit("Sure. ["), one, F.lit("] Done."))).when(k == 3, one).otherwise("no concepts")
    return t.buckets.select("bucket_id", F.size(ingest.repaired(reply)).alias("concepts"), F.try_element_at(ingest.repaired(reply), F.lit(1))["label"].alias("label"))


@query("memories_export", "SELECT b.bucket_id, count(i.item_id) AS items FROM m_buckets b LEFT JOIN m_items i ON b.bucket_id = i.bucket_id WHERE b.user_id = 1 GROUP BY 1")
def _(t):
    lines = conversations.memories_export(t.buckets, t.items, t.edges, 1)
    return lines.select("bucket_id", F.size(F.from_json("json", "items array<struct<item_id:long>>")["items"]).cast("long").alias("items"))


@query("conversations_export", "SELECT session_id, count(*) AS messages FROM m_messages WHERE user_id = 1 GROUP BY 1")
def _(t):
    return conversations.conversations_export(t.messages, 1).select("session_id", F.size(F.from_json("json", "messages array<struct<message_id:long>>")["messages"]).cast("long").alias("messages"))


@query("sealed_round_trip", "SELECT document_id, true AS same FROM m_documents")
def _(t):
    key = F.lit(b"0123456789abcdef0123456789abcdef")
    return of_documents(t, same=store.opened(store.sealed(body(), key), key) == body())


@query("vector_math", f"WITH p AS (SELECT a.bucket_id, a.embedding AS a, b.embedding AS b FROM m_embeddings a JOIN m_embeddings b ON b.bucket_id = a.bucket_id + 1), z AS (SELECT bucket_id, list_zip(a, b) AS z FROM p) SELECT bucket_id, CAST({sql_r4('sqrt(list_sum(list_transform(z, lambda p: (p[1] - p[2]) * (p[1] - p[2]))))')} AS DOUBLE) AS euclidean, CAST({sql_r4('list_sum(list_transform(z, lambda p: abs(p[1] - p[2])))')} AS DOUBLE) AS manhattan, CAST({sql_r4('list_sum(list_transform(z, lambda p: p[1] * p[2]))')} AS DOUBLE) AS dot FROM z")
def _(t):
    e = t.embeddings
    pairs = e.select("bucket_id", F.col("embedding").alias("a")).join(e.select((F.col("bucket_id") - 1).alias("bucket_id"), F.col("embedding").alias("b")), "bucket_id")
    a, b = F.col("a"), F.col("b")
    return pairs.select("bucket_id", r4(vector.euclidean(a, b)).alias("euclidean"), r4(vector.manhattan(a, b)).alias("manhattan"), r4(vector.dot(a, b)).alias("dot"))


@query("vector_text_round_trip", "SELECT bucket_id, CAST(len(embedding) AS INT) AS size, true AS same FROM m_embeddings")
def _(t):
    back = vector.from_text(vector.to_text(F.col("embedding")))
    return t.embeddings.select("bucket_id", F.size(back).alias("size"), (back == F.col("embedding")).alias("same"))


def talk_sql() -> str:
    x = trimmed("content")
    return f"SELECT message_id, (length({x}) BETWEEN 1 AND 48 AND {matches(x, [ask.PLEASANTRY])}) OR (length({x}) BETWEEN 1 AND 60 AND {matches(x, [ask.ABOUT_ASSISTANT])}) AS small_talk, {chitchat('content')} AS chitchat FROM m_messages"


@query("small_talk", talk_sql())
def _(t):
    return t.messages.select("message_id", ask.is_small_talk(body()).alias("small_talk"), ask.is_chitchat(body()).alias("chitchat"))


@query("query_analysis_overlay")
def _(t):
    reply = F.when(F.col("message_id") % 2 == 0, '{"intent": "verify", "specificity": 0.9, "keyTerms": ["Alpha beta"], "preferredTypes": ["Code", "none"]}').otherwise("not json")
    out = ask.overlaid(ask.analysed(t.messages.select("message_id", body().alias("text"))).withColumn("reply", reply))
    return out.select("message_id", "intent", F.array_join("key_terms", "|").alias("key_terms"), F.array_join("expanded_terms", "|").alias("expanded_terms"), r4(F.col("specificity")).alias("specificity"), F.array_join("preferred_types", "|").alias("preferred_types"), "is_abstract")


@query("available_memories", f"{SCORED} SELECT question_id, bucket_id, CAST(rank - 6 AS INT) AS n FROM y WHERE rank BETWEEN 7 AND 14")
def _(t):
    ranked = scoring.softmax_ranked(scoring.raw_relevance(candidates(t), AS_OF))
    return scoring.available(ranked, ranked.filter("rank <= 6")).select("question_id", "bucket_id", "n")


@query("serverless_selection", f"{SCORED}, z AS (SELECT *, row_number() OVER (PARTITION BY question_id, coalesce(source, 'unknown') ORDER BY rank) AS nth FROM y WHERE rank <= 20), f AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN nth > 3 THEN 1 ELSE 0 END, rank) AS position FROM z) SELECT question_id, bucket_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY CASE concept_type WHEN 'decision' THEN 0 WHEN 'problem' THEN 1 WHEN 'fact' THEN 2 WHEN 'code' THEN 3 WHEN 'entity' THEN 4 WHEN 'event' THEN 5 ELSE 6 END, rank) AS INT) AS place FROM f WHERE position <= 6")
def _(t):
    ranked = scoring.softmax_ranked(scoring.raw_relevance(candidates(t), AS_OF))
    return scoring.serverless_selection(ranked, 6).select("question_id", "bucket_id", "place")


@query("source_documents", f"{SCORED}, g AS (SELECT question_id, document_id, count(*) AS n FROM y WHERE rank <= 20 AND document_id IS NOT NULL GROUP BY 1, 2) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY n DESC, document_id) AS INT) AS place FROM g) WHERE place <= 5")
def _(t):
    from ..operators import cortex

    return cortex.source_documents(scoring.softmax_ranked(scoring.raw_relevance(candidates(t), AS_OF)))


@query("most_frequent_document", f"{SCORED}, g AS (SELECT question_id, document_id, count(*) AS n, min(rank) AS f FROM y WHERE rank <= 20 AND document_id IS NOT NULL GROUP BY 1, 2) SELECT question_id, document_id FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, f) AS k FROM g) WHERE k = 1")
def _(t):
    from ..operators import cortex

    return cortex.most_frequent_document(scoring.softmax_ranked(scoring.raw_relevance(candidates(t), AS_OF)))


@query("connection_confidence", f"{SCORED} SELECT question_id, CAST({sql_r4('coalesce(avg(CASE WHEN k > 0 THEN k END), 0)')} AS DOUBLE) AS mean, CAST(coalesce(max(CASE WHEN k > 0 THEN k END), 0) AS DOUBLE) AS largest, count(CASE WHEN k > 0 THEN 1 END) AS connected FROM y WHERE rank <= 20 GROUP BY 1")
def _(t):
    from ..operators import cortex

    return cortex.connection_confidence(scoring.softmax_ranked(scoring.raw_relevance(candidates(t), AS_OF))).withColumn("mean", r4(F.col("mean")))


@query("ingestion_rates", "WITH s AS (SELECT CAST(sum(access_count) AS BIGINT) AS chunks, CAST(sum(importance) AS BIGINT) AS concepts, CAST(sum(importance // 2) AS BIGINT) AS created, CAST(sum(importance // 3) AS BIGINT) AS merged, count(*) FILTER (bucket_id % 10 = 0) AS failed FROM m_buckets) SELECT *, floor(concepts / chunks * 100.0 + 0.5) / 100.0 AS concepts_per_chunk, floor(created / concepts * 100.0 + 0.5) / 100.0 AS created_rate, floor((chunks - failed) / chunks * 100.0 + 0.5) / 100.0 AS success_rate FROM s")
def _(t):
    from ..operators import cortex

    rows = t.buckets.select(F.col("access_count").alias("chunks"), F.col("importance").alias("concepts"), F.floor(F.col("importance") / 2).alias("created"), F.floor(F.col("importance") / 3).alias("merged"), (F.col("bucket_id") % 10 == 0).cast("int").alias("failed"))
    return cortex.rates(rows)
