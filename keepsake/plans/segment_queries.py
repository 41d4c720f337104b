"""Registered queries over lines, sections and chunks of texts. The SQL numbers lines and parts and uses windows and recursion instead of arrays and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lines, text
from ..functions.numbers import median_of
from ..operators import segment
from . import ingest
from .catalog import BLANK, query, quoted, trimmed, words


def digest(column):
    return F.sha2(column.cast("binary"), 256)


def steps(inner: str, patterns) -> str:
    for pattern, into in patterns:
        inner = f"regexp_replace({inner}, {quoted(pattern)}, {quoted(into)}, 'g')"
    return inner


# ---------------------------------------------------------------- lines

LINES = f"""line AS (SELECT document_id, i, line, regexp_replace(line, '^{BLANK}+|{BLANK}+$', '', 'g') AS bare, regexp_replace(line, '{BLANK}+$', '') AS own
  FROM (SELECT document_id, unnest(string_split(content, chr(10))) AS line, unnest(range(len(string_split(content, chr(10))))) AS i FROM source)),
placed AS (SELECT *, lag(bare) OVER w AS before, lead(bare) OVER w AS after FROM line WINDOW w AS (PARTITION BY document_id ORDER BY i))"""

TEXT_SECTIONS = rf"""
WITH source AS (SELECT document_id, content FROM m_documents), {LINES},
kind AS (SELECT *, regexp_matches(bare, '^[0-9]+(\.[0-9]+)*{BLANK}+[A-Z].{{2,80}}$') AS numbered, regexp_matches(bare, '^[A-Z][A-Z \t\n\r\f\v]{{3,50}}$') AND length(bare) < 60 AS capitals,
    length(bare) > 5 AND length(bare) < 60 AND regexp_matches(bare, '^[A-Z]') AND NOT regexp_matches(bare, '[.;,]$') AND before = '' AND length(after) > length(bare) AND len({words('bare')}) <= 8 AS standing FROM placed),
head AS (SELECT *, coalesce(numbered OR capitals OR standing, false) AS is_head, CASE WHEN numbered THEN regexp_replace(bare, '^[0-9.]+{BLANK}+', '') ELSE bare END AS heading,
    CASE WHEN numbered THEN len(string_split(regexp_extract(bare, '^[0-9.]+'), '.')) WHEN capitals THEN 1 ELSE 2 END AS level FROM kind),
island AS (SELECT *, sum(CAST(is_head AS INT)) OVER (PARTITION BY document_id ORDER BY i) AS n FROM head),
part AS (SELECT document_id, n, max(CASE WHEN is_head THEN heading END) AS heading, max(CASE WHEN is_head THEN level ELSE 0 END) AS level, {trimmed("coalesce(string_agg(CASE WHEN NOT is_head THEN line END, chr(10) ORDER BY i), '')")} AS text FROM island GROUP BY document_id, n),
paragraph AS (SELECT document_id, unnest(ps) AS text, unnest(range(len(ps))) AS n FROM (SELECT document_id, list_filter(list_transform(regexp_split_to_array(content, '\n{BLANK}*\n'), lambda p: {trimmed('p')}), lambda p: p <> '') AS ps FROM source WHERE document_id NOT IN (SELECT document_id FROM head WHERE is_head))),
told AS (SELECT document_id, n, heading, level, text FROM part WHERE document_id IN (SELECT document_id FROM head WHERE is_head) AND ((n = 0 AND length(text) > 100)
    OR (n > 0 AND length(heading) >= 3 AND NOT regexp_matches(heading, '^[0-9]+$') AND NOT (len({words('heading')}) > 1 AND len(list_filter({words('heading')}, lambda w: length(w) > 1)) = 0)))
  UNION ALL SELECT document_id, n, NULL, 0, text FROM paragraph)
SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY n) - 1 AS INT) AS section_index, heading, CAST(level AS INT) AS level, sha256(text) AS digest FROM told"""


@query("text_sections", TEXT_SECTIONS)
def _(t):
    parts = t.documents.select("document_id", F.posexplode(lines.text_sections(F.col("content"))).alias("section_index", "s"))
    return parts.select("document_id", "section_index", "s.heading", "s.level", digest(F.col("s.text")).alias("digest"))


#: Characters in plain form: ligatures, quotes, dashes, signs, text decoded twice.
PLAIN = [("â\x80\x99", "'"), ("â\x80\x9c", '"'), ("â\x80\x9d", '"'), ("â\x80\x98", "'"), ("â\x80\x93", "-"), ("â\x80\x94", " -- "), ("â\x80¦", "..."), ("Â\xa0", " "), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬆ", "st"), ("–", "-"), ("—", " -- "), ("…", "..."), ("·", " "), ("•", " "), ("−", "-"), ("×", "x"), ("÷", "/"), ("≤", "<="), ("≥", ">="), ("≠", "!="), ("≈", "~"), ("∞", "infinity"), ("∑", "sum"), ("∏", "prod"), ("∫", "integral"), ("∂", "partial"), ("∇", "nabla"), ("√", "sqrt")]


def plain_sql(inner: str) -> str:
    for bad, good in PLAIN:
        inner = f"replace({inner}, {quoted(bad)}, {quoted(good)})"
    inner = f"translate({inner}, '“”„‟″‶‘’‚‛′‵\xa0', {quoted(chr(34) * 6 + chr(39) * 6 + ' ')})"
    inner = f"regexp_replace({inner}, '[\\x{{00ad}}\\x{{200b}}-\\x{{200f}}\\x{{feff}}\\x{{2060}}\\x{{180e}}\\x{{fffd}}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}]', '', 'g')"
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    return f"translate({inner}, {quoted(wide)}, {quoted(''.join(chr(ord(c) - 0xFEE0) for c in wide))})"


def tidy_sql(inner: str) -> str:
    return trimmed(steps(inner, [(r"\r\n", "\n"), (r"[\r\f]", "\n"), ("\xa0", " "), (r"[\x{200b}\x{200c}\x{200d}\x{feff}]", ""), (r"[ \t]+(\n|$)", r"\1"), (r"\n{4,}", "\n\n"), (" {2,}", " "), (r"\t+", " ")]))


#: joined: the lines of ``source`` with broken ones put together. Of a run of lines that may take in their next, every other one does.
JOINED = rf"""{LINES},
may AS (SELECT *, NOT (bare = '' OR coalesce(after, '') = '' OR starts_with(bare, '## ')
    OR (coalesce(before, '') = '' AND length(bare) >= 3 AND length(bare) < 80 AND regexp_matches(bare, '^[A-Z]') AND NOT regexp_matches(bare, '[.;,]$') AND len({words('bare')}) <= 10 AND length(after) > length(bare))
    OR regexp_matches(bare, '[.!?;:\])}}"'']$') OR regexp_matches(after, '^[0-9]+[.)]{BLANK}|^[A-Z][A-Z \t\n\r\f\v]{{4,}}$|^#{{1,6}}{BLANK}|^[•*-]{BLANK}|^\([a-z]\){BLANK}')
    OR regexp_matches(lower(after), '^(chapter|section|figure|table|abstract|introduction|method|result|discussion|conclusion|references|appendix|acknowledgment)([^a-z0-9_]|$)|^(chapter|section|part|unit){BLANK}+[0-9]+$')) AS joins FROM placed),
run AS (SELECT *, i - row_number() OVER (PARTITION BY document_id, joins ORDER BY i) AS run FROM may),
taking AS (SELECT *, joins AND (row_number() OVER (PARTITION BY document_id, joins, run ORDER BY i)) % 2 = 1 AS takes FROM run),
left_over AS (SELECT *, coalesce(lag(takes) OVER (PARTITION BY document_id ORDER BY i), false) AS taken FROM taking),
joined AS (SELECT document_id, string_agg(CASE WHEN takes THEN own || ' ' || after ELSE own END, chr(10) ORDER BY i) AS text FROM left_over WHERE NOT taken GROUP BY document_id)"""


@query("line_joining", f"WITH source AS (SELECT document_id, content FROM m_documents), {JOINED} SELECT document_id, sha256(text) AS digest FROM joined")
def _(t):
    return t.documents.select("document_id", digest(lines.joined_lines(F.col("content"))).alias("digest"))


BACK_MATTER = rf"""
WITH source AS (SELECT document_id, content FROM m_documents), {LINES},
sized AS (SELECT *, count(*) OVER (PARTITION BY document_id) AS n, {trimmed(rf"regexp_replace(bare, '^\[Page{BLANK}+[0-9]+\]$', '')")} AS told FROM line),
cut AS (SELECT document_id, max(CASE WHEN i >= floor(n * 0.5) AND (lower(told) IN ('references', 'bibliography', 'works cited', 'literature cited', 'subject index', 'author index', 'name index', 'general index', 'about the author', 'about the editor', 'about the publisher') OR (lower(told) = 'index' AND i > n * 0.7)) THEN i END) AS ends,
  min(CASE WHEN bare <> '' AND NOT regexp_matches(bare, '^\[Page{BLANK}+[0-9]+\]$') THEN i END) AS first FROM sized GROUP BY document_id),
front AS (SELECT s.document_id, any_value(c.ends) AS ends, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.ends IS NULL OR i < c.ends), '') AS text, {trimmed(f"max(CASE WHEN i = c.first THEN regexp_replace(bare, '^##{BLANK}+', '') END)")} AS title FROM sized s JOIN cut c ON s.document_id = c.document_id GROUP BY s.document_id)
SELECT document_id, sha256(CASE WHEN ends IS NULL THEN text ELSE {trimmed('text')} END) AS digest, ends IS NOT NULL AS cut, CASE WHEN length(title) BETWEEN 5 AND 250 AND NOT regexp_matches(title, '^[0-9]') THEN title END AS title FROM front"""


@query("back_matter_cut", BACK_MATTER)
def _(t):
    rest = lines.without_back_matter(F.col("content"))
    return t.documents.select("document_id", digest(rest).alias("digest"), (rest != F.col("content")).alias("cut"), lines.title_guess(F.col("content")).alias("title"))


@query("median_line_length", "SELECT document_id, median(length(line)) AS median FROM (SELECT document_id, unnest(string_split(content, chr(10))) AS line FROM m_documents) GROUP BY document_id")
def _(t):
    return t.documents.select("document_id", median_of(F.transform(text.lines_of(F.col("content")), F.length)).alias("median"))


def heading_sql(bare: str) -> str:
    return rf"({bare} <> '' AND length({bare}) <= 120 AND (regexp_matches({bare}, '^#{{1,6}}{BLANK}|^[0-9]+(\.[0-9]+)*\.?{BLANK}+[A-Z]') OR regexp_matches(lower({bare}), '^(abstract|introduction|method|methods|methodology|results?|discussion|conclusion|related work|references|background|experiments?|evaluation|appendix|preliminaries|setup)([^a-z0-9_]|$)') OR (upper({bare}) = {bare} AND regexp_matches({bare}, '[A-Z]') AND length({bare}) BETWEEN 4 AND 60)))"


@query("heading_lines", rf"WITH source AS (SELECT document_id, content FROM m_documents), {LINES} SELECT document_id, i AS line, {trimmed(rf"regexp_replace(regexp_replace(bare, '^#+{BLANK}*', ''), '^[0-9]+(\.[0-9]+)*\.?{BLANK}*', '')")} AS heading FROM line WHERE {heading_sql('bare')}")
def _(t):
    rows = t.documents.select("document_id", F.posexplode(F.transform(text.lines_of(F.col("content")), text.trimmed)).alias("line", "bare"))
    return rows.filter(lines.looks_like_heading(F.col("bare"))).select("document_id", F.col("line").cast("long"), lines.clean_heading(F.col("bare")).alias("heading"))


CLEAN_MARKDOWN = [
    (r"(?s)```[A-Za-z0-9_]*\n?(.*?)```", r"\1"), (r"`([^`\n]+)`", r"\1"), (r"(?m)^#{1,6}[ \t]+", ""), (r"\*{1,3}([^*]+)\*{1,3}", r"\1"), (r"_{1,3}([^_]+)_{1,3}", r"\1"), (r"!\[([^\]]*)\]\([^)]+\)", ""),
    (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"(?m)^>[ \t]+", ""), (r"(?m)^[-*+][ \t]+", "  "), (r"(?m)^[0-9]+\.[ \t]+", "  "), (r"---+", ""), (r"\|", " "),
]
CLEAN_LINES = f"list_filter(list_transform(string_split({steps('content', CLEAN_MARKDOWN)}, chr(10)), lambda x: {trimmed('x')}), lambda x: x <> '')"


@query("document_clean", f"SELECT document_id, sha256(trim(regexp_replace(array_to_string({CLEAN_LINES}, chr(10)), '[ \\t]+', ' ', 'g'), ' ')) AS digest, sha256({tidy_sql(plain_sql('content'))}) AS plain FROM m_documents")
def _(t):
    return t.documents.select("document_id", digest(text.clean_document(F.col("content"), True)).alias("digest"), digest(text.clean_text(F.col("content"))).alias("plain"))


PDF_TEXT = rf"""
WITH plain AS (SELECT document_id, {plain_sql('content')} AS content FROM m_documents),
p_line AS (SELECT *, {trimmed('line')} AS bare FROM (SELECT document_id, unnest(string_split(content, chr(10))) AS line, unnest(range(len(string_split(content, chr(10))))) AS i, len(string_split(content, chr(10))) AS n FROM plain)),
p_kept AS (SELECT document_id, i, line, bare, count(*) OVER (PARTITION BY document_id, bare) AS k, n FROM p_line),
source AS (SELECT p.document_id, regexp_replace(coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (WHERE k.bare = '' OR NOT (regexp_matches(k.bare, {quoted(text.NOISE_PATTERN)}) OR (len({words('k.bare')}) > 2 AND len(regexp_extract_all(k.bare, '([0-9]+\.?[0-9]*)', 1)) / len({words('k.bare')}) > 0.6))), ''), '([A-Za-z0-9_]{{3,}})-\s*\n\s*([A-Za-z0-9_]{{2,}})', '\1\2', 'g') AS content
  FROM plain p LEFT JOIN (SELECT * FROM p_kept WHERE NOT (length(bare) BETWEEN 3 AND 120 AND k >= greatest(3, CAST(floor(n * 0.2) AS INT)))) k ON p.document_id = k.document_id GROUP BY p.document_id), {JOINED}
SELECT document_id, sha256({tidy_sql('text')}) AS digest FROM joined"""


@query("pdf_text_clean", PDF_TEXT)
def _(t):
    told = text.dehyphenated(text.without_noise(text.without_repeated_lines(text.plain_characters(F.col("content")))))
    return t.documents.select("document_id", digest(text.tidy_white_space(lines.joined_lines(told))).alias("digest"))


# ---------------------------------------------------------------- chunks


def tokens_sql(x: str, light: bool = False) -> str:
    more = "" if light else " + CASE WHEN length(w) > 12 THEN 1 ELSE 0 END"
    return f"CAST(coalesce(list_sum(list_transform({words(x)}, lambda w: 1 + CASE WHEN length(w) > 6 THEN length(w) // 4{' - 1' if light else ''} ELSE 0 END{more})), 0) AS BIGINT)"


def unnested(table: str, keys: str, number: str, parts: str) -> str:
    return f"SELECT * FROM (SELECT {keys}, unnest(parts) AS part, unnest(range(len(parts))) AS {number} FROM (SELECT *, {parts} AS parts FROM {table})) WHERE {trimmed('part')} <> ''"


def chunks_sql(rows: str, key: str, light: bool = False, cut: bool = False, least: int = 150, most: int = 250) -> str:
    """Units (paragraphs, sentences, words) numbered, then put into chunks one after another by recursion."""
    split, joiner = (r"regexp_extract_all(part, '[^.!?]*[.!?]+\s*|[^.!?]+$')", "''") if light else (r"string_split(regexp_replace(part, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))", "' '")
    finer = ("  UNION ALL SELECT key, p, s, -1, 'sentence', part, size FROM sentence" if cut else "") if light else rf"""
  UNION ALL SELECT key, p, s, 0, 'sentence', part, size FROM sentence WHERE size <= {most}
  UNION ALL SELECT key, p, s, x, CASE WHEN size > {most} THEN 'forced' ELSE 'word' END, part, size FROM (SELECT *, {tokens_sql('part')} AS size FROM ({unnested(f'(SELECT * FROM sentence WHERE size > {most})', 'key, p, s', 'x', f"regexp_split_to_array(part, '{BLANK}+')")}))"""
    return rf"""
WITH RECURSIVE source AS ({rows}),
whole AS (SELECT *, {tokens_sql('content', light)} AS size FROM source),
paragraph AS MATERIALIZED (SELECT *, {tokens_sql('part', light)} AS size FROM ({unnested(f'(SELECT * FROM whole WHERE size > {most})', 'key', 'p', r"regexp_split_to_array(content, '\n\n+')")})),
sentence AS MATERIALIZED (SELECT *, {tokens_sql('part', light)} AS size FROM ({unnested(f'(SELECT * FROM paragraph WHERE size > {most})', 'key, p', 's', split)})),
unit AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY p, s, x) AS n, CASE kind WHEN 'paragraph' THEN 'p' WHEN 'sentence' THEN 's' || p ELSE 'w' || p || '.' || s END AS home FROM (
  SELECT key, p, -1 AS s, -1 AS x, 'paragraph' AS kind, part, size FROM paragraph WHERE {'true' if light and not cut else f'size <= {most}'}{finer})),
fold(key, n, chunk, held, home) AS (SELECT key, n, 0, size, home FROM unit WHERE n = 1
  UNION ALL SELECT u.key, u.n, CASE WHEN f.home = u.home AND f.held + u.size <= {most} THEN f.chunk ELSE f.chunk + 1 END, CASE WHEN f.home = u.home AND f.held + u.size <= {most} THEN f.held + u.size ELSE u.size END, u.home
  FROM fold f JOIN unit u ON f.key = u.key AND u.n = f.n + 1),
chunk AS (SELECT key, chunk, max(kind) AS kind, {trimmed(f"CASE max(kind) WHEN 'paragraph' THEN string_agg(part, chr(10) || chr(10) ORDER BY n) ELSE string_agg(part, {joiner} ORDER BY n) END")} AS text, CAST(sum(size) AS BIGINT) AS size FROM fold JOIN unit USING (key, n) GROUP BY key, chunk),
tail AS (SELECT *, lag(size) OVER w AS size_before, lead(kind) OVER w AS kind_after, lead(size) OVER w AS size_after, lead(text) OVER w AS text_after, chunk = max(chunk) OVER (PARTITION BY key) AS is_last, chunk + 1 = max(chunk) OVER (PARTITION BY key) AS is_before FROM chunk WINDOW w AS (PARTITION BY key ORDER BY chunk)),
done AS (SELECT key, chunk, kind, CASE WHEN is_before AND kind_after = 'paragraph' AND size_after < {0 if light else least} AND size + size_after <= {most} THEN text || chr(10) || chr(10) || text_after ELSE text END AS text, CASE WHEN is_before AND kind_after = 'paragraph' AND size_after < {0 if light else least} AND size + size_after <= {most} THEN size + size_after ELSE size END AS size
  FROM tail WHERE NOT coalesce(is_last AND kind = 'paragraph' AND size < {0 if light else least} AND size_before + size <= {most}, false))
SELECT key AS {key}, CAST(chunk AS INT) AS chunk_index, CAST(size AS INT) AS token_estimate, kind AS split_method, sha256(text) AS digest FROM done
UNION ALL SELECT key, 0, CAST(size AS INT), 'paragraph', sha256(content) FROM whole WHERE size <= {most} AND content <> ''"""


def chunk_rows(df, key):
    return df.select(key, "chunk_index", "token_estimate", "split_method", digest(F.col("chunk")).alias("digest"))


@query("paragraph_chunks", chunks_sql("SELECT document_id AS key, content FROM m_documents", "document_id"))
def _(t):
    return chunk_rows(segment.chunked(t.documents.select("document_id", "content")), "document_id")


@query("light_chunks", chunks_sql("SELECT message_id AS key, content FROM m_messages", "message_id", True))
def _(t):
    return chunk_rows(segment.lightly_chunked(t.messages.select("message_id", "content")), "message_id")


def _message_sql() -> str:
    from .text_queries import cleaned_sql

    return chunks_sql(f"SELECT * FROM (SELECT message_id AS key, {cleaned_sql()} AS content FROM m_messages) WHERE content <> ''", "message_id")


@query("message_chunks", _message_sql())
def _(t):
    return chunk_rows(ingest.ingest_messages(t.messages.select("message_id", "content")), "message_id")


@query("document_sections")
def _(t):
    return segment.sectioned(t.documents.select("document_id", "content")).select("document_id", "section_index", "heading", digest(F.col("section")).alias("digest"))


@query("imported_chunks", chunks_sql("SELECT document_id AS key, content FROM m_documents", "document_id", True, True))
def _(t):
    return chunk_rows(segment.lightly_chunked(t.documents.select("document_id", "content"), cut=True), "document_id")
