"""The engine's tables derived from the driver's: one SQL text for both engines, ``{name}`` standing for a table."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "m_buckets": """
SELECT p_partkey AS bucket_id,
 CAST(p_partkey % 5 AS BIGINT) AS user_id,
 CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST((p_partkey * 7) % 200 AS BIGINT) END AS document_id,
 concat(p_name, CASE p_partkey % 6 WHEN 0 THEN ' System' WHEN 1 THEN ' Module' WHEN 2 THEN ' (v2)' ELSE '' END) AS canonical,
 CASE p_partkey % 7 WHEN 0 THEN 'problem' WHEN 1 THEN 'decision' WHEN 2 THEN 'fact' WHEN 3 THEN 'entity' WHEN 4 THEN 'event' WHEN 5 THEN 'preference' ELSE 'code' END AS concept_type,
 CAST(1 + p_size % 10 AS INT) AS importance,
 CAST(5 + (p_partkey * 37) % 96 AS DOUBLE) / 100 AS strength,
 CASE WHEN 1 + p_size % 10 >= 8 THEN CAST(0.10 AS DOUBLE) WHEN 1 + p_size % 10 >= 5 THEN CAST(0.15 AS DOUBLE) ELSE CAST(0.20 AS DOUBLE) END AS decay_rate,
 CAST(1 + p_partkey % 9 AS INT) AS access_count,
 TIMESTAMP '2024-01-31 00:00:00' - ((p_partkey * 13) % 45) * INTERVAL '1' DAY AS last_accessed,
 TIMESTAMP '2023-12-01 00:00:00' + (p_partkey % 30) * INTERVAL '1' DAY AS created_at
FROM {part}""",
    "m_edges": """
SELECT source_bucket_id, target_bucket_id, relation_type, max(confidence) AS confidence, min(method) AS method FROM (
 SELECT a.l_partkey AS source_bucket_id, b.l_partkey AS target_bucket_id,
 CASE CAST(a.l_quantity AS BIGINT) % 6 WHEN 0 THEN 'causes' WHEN 1 THEN 'related_to' WHEN 2 THEN 'replaces' WHEN 3 THEN 'part_of' WHEN 4 THEN 'requires' ELSE 'evolves_into' END AS relation_type,
 CAST(30 + (a.l_orderkey * 3 + a.l_linenumber) % 70 AS DOUBLE) / 100 AS confidence,
 CASE a.l_orderkey % 3 WHEN 0 THEN 'vector' WHEN 1 THEN 'extraction' ELSE 'ai' END AS method
 FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
 WHERE a.l_partkey <> b.l_partkey) e GROUP BY source_bucket_id, target_bucket_id, relation_type""",
    "m_documents": """
SELECT doc_id AS document_id, CAST(doc_id % 5 AS BIGINT) AS user_id,
 concat('doc-', CAST(doc_id AS STRING), CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.pdf' ELSE '.docx' END) AS filename,
 text AS content, n_chars, lang, source FROM {documents}""",
    "m_messages": """
SELECT conv_id * 100 + turn AS message_id, conv_id AS session_id, CAST(conv_id % 5 AS BIGINT) AS user_id, role, text AS content,
 TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL '6' HOUR + turn * (CASE WHEN turn >= 5 THEN 20 ELSE 2 END) * INTERVAL '1' MINUTE AS ts
FROM {conversations}""",
    "m_embeddings": """
SELECT vec_id AS bucket_id, CAST(embedding AS {doubles}) AS embedding FROM {embeddings}""",
    "m_items": """
SELECT b.bucket_id * 2 AS item_id, b.bucket_id, b.canonical AS label,
 CASE WHEN d.content IS NULL THEN concat('Noted without a source: ', b.canonical) ELSE d.content END AS definition,
 coalesce(d.filename, 'conversation') AS source, b.created_at AS item_ts
FROM {m_buckets} b LEFT JOIN {m_documents} d ON b.document_id = d.document_id
UNION ALL
SELECT b.bucket_id * 2 + 1 AS item_id, b.bucket_id, concat(b.canonical, ' again') AS label,
 CASE WHEN d.content IS NULL THEN concat('Noted again, and still without any source: ', b.canonical) ELSE concat(d.content, ' (again)') END AS definition,
 coalesce(d.filename, 'conversation') AS source, b.created_at + INTERVAL '3' DAY AS item_ts
FROM {m_buckets} b LEFT JOIN {m_documents} d ON b.document_id = d.document_id WHERE b.bucket_id % 3 = 0""",
    "m_access": """
SELECT event_id, CAST(substr(props, 7, length(props) - 7) AS BIGINT) AS bucket_id, CAST(user_id % 5 AS BIGINT) AS user_id, CAST(ts AS TIMESTAMP) AS ts
FROM {events} WHERE event_type IN ('view', 'click')""",
    "m_jobs": """
SELECT o_orderkey AS job_id, CAST(o_custkey % 5 AS BIGINT) AS user_id,
 CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'queued' ELSE 'processing' END AS status, CAST(o_orderdate AS TIMESTAMP) AS started_at
FROM {orders}""",
    "m_users": """
SELECT user_id, concat('User', CAST(user_id AS STRING), '@Example.org') AS email, user_id = 4 AS sandbox,
 CASE WHEN user_id = 4 THEN TIMESTAMP '2024-01-30 00:00:00' END AS expires_at
FROM (SELECT DISTINCT CAST(r_regionkey AS BIGINT) AS user_id FROM {region}) u""",
}
NEEDS = {name: re.findall(r"\{(m_\w+)\}", sql) for name, sql in VIEWS.items()}

#: Rows of {lineitem} for a task of what is made of edges.
ROWS_A_TASK = 250_000


class Tables:
    """The engine's tables over the Parquet files of a folder; each attribute is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _sql(self, name: str) -> str:
        return re.sub(r"\{(\w+)\}", lambda m: "ARRAY<DOUBLE>" if m[1] == "doubles" else f"({self._sql(m[1])})" if m[1] in VIEWS else f"parquet.`{self.folder}/{m[1]}.parquet`", VIEWS[name])

    def _view(self, name: str) -> DataFrame:
        return self.spark.sql(self._sql(name))

    def parts_of(self, name: str, rows: int) -> int | None:
        """Partitions of so many rows of a table, so that a task's share stays the same however large the table is; None where the session's own number does. Counts rows by the files' footers."""
        wanted = -(-self.raw(name).count() // rows)
        return wanted if wanted > int(self.spark.conf.get("spark.sql.shuffle.partitions")) else None

    @cached_property
    def parts(self) -> int | None:
        """Partitions for what is made of edges."""
        return self.parts_of("lineitem", ROWS_A_TASK)

    def _dealt_edges(self) -> DataFrame:
        """The same SQL over rows that are dealt over ``parts`` partitions by its join's keys, and its pairs by their source, which grouping and a join by the source then find in place."""
        items = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
        sql = VIEWS["m_edges"].replace("SELECT a.", f"SELECT /*+ REPARTITION({self.parts}, source_bucket_id) */ a.", 1).replace("{lineitem} a", "{first} a").replace("{lineitem} b", "{second} b")
        return self.spark.sql(sql, first=items.repartition(self.parts, "l_orderkey", F.col("l_linenumber") + 1), second=items.repartition(self.parts, "l_orderkey", "l_linenumber"))

    buckets = cached_property(lambda self: self._view("m_buckets"))
    edges = cached_property(lambda self: self._view("m_edges") if self.parts is None else self._dealt_edges())
    documents = cached_property(lambda self: self._view("m_documents"))
    messages = cached_property(lambda self: self._view("m_messages"))
    embeddings = cached_property(lambda self: self._view("m_embeddings"))
    items = cached_property(lambda self: self._view("m_items") if self.parts is None else self._dealt_items())
    access = cached_property(lambda self: self._view("m_access"))
    jobs = cached_property(lambda self: self._view("m_jobs"))
    users = cached_property(lambda self: self._view("m_users"))

    def _dealt_items(self) -> DataFrame:
        """The same SQL over memories that are dealt before they get texts, so that few files of them don't mean few tasks."""
        return self.spark.sql(VIEWS["m_items"], m_buckets=self.buckets.repartition(self.parts, "bucket_id"), m_documents=self.documents)


def with_views(sql: str) -> str:
    """DuckDB SQL that may name the views above: those it needs are put before it."""
    found: list[str] = []

    def need(name: str) -> None:
        for inner in NEEDS[name]:
            need(inner)
        if name not in found:
            found.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            need(name)
    text = lambda name: re.sub(r"\{(\w+)\}", lambda m: "DOUBLE[]" if m[1] == "doubles" else m[1], VIEWS[name])
    views = ",\n".join(f"{name} AS ({text(name)})" for name in found)
    if not views:
        return sql
    own = sql.strip()
    if own.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views},\n{own[14:]}"
    return f"WITH {views},\n{own[4:]}" if own.upper().startswith("WITH") else f"WITH {views}\n{own}"
