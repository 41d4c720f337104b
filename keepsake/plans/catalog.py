"""The registry of queries: a name, a function of the tables, and SQL for DuckDB where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..adapters import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"


def query(name: str, sql: str | None = None):
    """Registers a function of the tables under a name."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return register


def r4(x: str) -> str:
    return f"(floor(({x}) * 10000.0 + 0.5) / 10000.0)"


def settled(x: str) -> str:
    return f"(floor(({x}) * 10000.0 + 0.500001) / 10000.0)"


def unit(x: str) -> str:
    return f"least(greatest(CAST({x} AS DOUBLE), 0.0), 1.0)"


DAYS = f"((epoch_us({AS_OF_SQL}) - epoch_us(last_accessed)) / 86400000000.0)"
CURRENT = f"(CASE WHEN {DAYS} <= 0 THEN strength ELSE {unit(r4(f'strength * pow(1 - decay_rate, {DAYS})'))} END)"


def tier(x: str) -> str:
    return f"(CASE WHEN {x} >= 0.7 THEN 'strong' WHEN {x} >= 0.4 THEN 'fading' WHEN {x} >= 0.1 THEN 'critical' ELSE 'forgotten' END)"


#: Cosine of two DOUBLE[] expressions.
def cosine(a: str, b: str) -> str:
    dot = lambda x, y: f"list_sum(list_transform(list_zip({x}, {y}), lambda p: p[1] * p[2]))"
    return f"({dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})))"


#: Half-edges with tenants and documents of both ends.
HALVES = """halves AS (
  SELECT source_bucket_id AS bucket_id, target_bucket_id AS other_id, relation_type, confidence, 'out' AS direction FROM m_edges
  UNION ALL SELECT target_bucket_id, source_bucket_id, relation_type, confidence, 'in' FROM m_edges),
near AS (SELECT h.*, b.user_id, b.document_id, o.user_id AS other_user, o.document_id AS other_document FROM halves h JOIN m_buckets b ON h.bucket_id = b.bucket_id JOIN m_buckets o ON h.other_id = o.bucket_id)"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def matches(column: str, patterns, joiner: str = " OR ") -> str:
    return "(" + joiner.join(f"regexp_matches({column}, {quoted(p)})" for p in patterns) + ")"


def holds(column: str, parts) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(p)})" for p in parts) + ")"


BLANK = r"[ \t\n\r\f\v]"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{BLANK}+'), lambda w: w <> '')"


def distinct(x: str) -> str:
    """Without repeats, the first of each kept in its place."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def best_of(scores: str, names, least: int = 2, otherwise: str = "general") -> str:
    return f"CASE WHEN list_max({scores}) >= {least} THEN [{', '.join(map(quoted, names))}][list_position({scores}, list_max({scores}))] ELSE {quoted(otherwise)} END"


def domain_rows(domains: dict) -> str:
    """dom: document_id and domain of each document."""
    counts = ", ".join(" + ".join(f"len(regexp_extract_all(sample, {quoted(p)}))" for p in ps) for ps in domains.values())
    return f"""sampled AS (SELECT document_id, substr(lower(content), 1, 10000) AS sample, regexp_matches(lower(filename), 'paper|arxiv|proceedings') AS paper FROM m_documents),
counted AS (SELECT document_id, list_transform([{counts}], lambda h: CASE WHEN paper AND h > 0 THEN h + 2 ELSE h END) AS s FROM sampled),
dom AS (SELECT document_id, {best_of('s', domains)} AS domain FROM counted)"""
