"""Registered queries: lists, lookups, search, counts, upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import settled as r4
from ..functions.text import normalize_key, preview
from ..operators import cortex, knn, merge, scan, search
from ..schema import AS_OF
from .catalog import cosine, query
from .catalog import settled as sql_r4


@query("bucket_list_filtered", "SELECT bucket_id, canonical, concept_type, strength FROM m_buckets WHERE user_id = 1 AND concept_type = 'fact' AND strength >= 0.3 AND strength <= 0.9 ORDER BY last_accessed DESC, bucket_id LIMIT 20 OFFSET 2")
def _(t):
    return scan.page(scan.buckets(t.buckets, user_id=1, concept_type="fact", min_strength=0.3, max_strength=0.9), F.desc("last_accessed"), F.col("bucket_id"), limit=20, offset=2).select("bucket_id", "canonical", "concept_type", "strength")


@query("bucket_search_ilike", "SELECT DISTINCT b.bucket_id, b.canonical, b.strength FROM m_buckets b LEFT JOIN m_items i ON b.bucket_id = i.bucket_id WHERE b.canonical ILIKE '%ring%' OR i.label ILIKE '%ring%' OR i.definition ILIKE '%ring%' ORDER BY b.strength DESC, b.bucket_id LIMIT 50")
def _(t):
    return search.by_text(t.buckets, t.items, "ring")


@query("text_search_multi_term", """
SELECT b.bucket_id, b.canonical, b.importance, b.strength FROM m_buckets b LEFT JOIN m_items i ON b.bucket_id = i.bucket_id
WHERE b.user_id = 2 AND (b.canonical ILIKE '%ring%' OR b.canonical ILIKE '%bolt%' OR i.label ILIKE '%ring%' OR i.label ILIKE '%bolt%' OR i.definition ILIKE '%ring%' OR i.definition ILIKE '%bolt%')
GROUP BY ALL ORDER BY max(b.importance) DESC, max(b.strength) DESC, b.bucket_id LIMIT 40""")
def _(t):
    return search.by_terms(t.buckets, t.items, ["ring", "bolt"], user_id=2)


@query("text_search_per_term", """
WITH h AS (SELECT bucket_id, canonical, strength, 0 AS place FROM m_buckets WHERE canonical ILIKE '%ring%' UNION ALL SELECT bucket_id, canonical, strength, 1 FROM m_buckets WHERE canonical ILIKE '%bolt%'),
r AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY strength DESC, bucket_id) AS n FROM h)
SELECT bucket_id, CAST(min(place) AS INT) AS term_place, min(canonical) AS canonical FROM r WHERE n <= 10 GROUP BY bucket_id ORDER BY 2, 1 LIMIT 20""")
def _(t):
    return search.by_each_term(t.buckets, ["ring", "bolt"], 20)


@query("point_lookup_with_items", "SELECT b.bucket_id, b.canonical, i.item_id, i.label, i.source FROM m_buckets b LEFT JOIN m_items i ON b.bucket_id = i.bucket_id WHERE b.bucket_id = 9")
def _(t):
    nested = scan.with_items(t.buckets.filter("bucket_id = 9"), t.items.filter("bucket_id = 9"))
    return nested.select("bucket_id", "canonical", F.explode_outer("items").alias("i")).select("bucket_id", "canonical", "i.item_id", "i.label", "i.source")


@query("batch_lookup", "SELECT bucket_id, canonical FROM m_buckets WHERE bucket_id IN (SELECT bucket_id FROM m_access)")
def _(t):
    return scan.by_ids(t.buckets, t.access).select("bucket_id", "canonical")


@query("lookup_by_key", "SELECT min(bucket_id) AS bucket_id FROM m_buckets WHERE user_id = 1 AND array_to_string(list_sort(list_filter(string_split(regexp_replace(lower(canonical), '[^a-z0-9 ]', '', 'g'), ' '), lambda x: x <> '')), '_') = (SELECT array_to_string(list_sort(list_filter(string_split(regexp_replace(lower(canonical), '[^a-z0-9 ]', '', 'g'), ' '), lambda x: x <> '')), '_') FROM m_buckets WHERE bucket_id = 16)")
def _(t):
    keyed = t.buckets.withColumn("normalized", normalize_key(F.col("canonical")))
    wanted = keyed.filter("bucket_id = 16").select(F.col("normalized").alias("k"))
    return keyed.filter("user_id = 1").join(wanted, F.col("normalized") == F.col("k"), "left_semi").agg(F.min("bucket_id").alias("bucket_id"))


@query("document_list", "SELECT document_id, filename, substr(content, 1, 200) AS preview, n_chars FROM m_documents WHERE user_id = 3 ORDER BY document_id DESC")
def _(t):
    return scan.documents(t.documents, 3)


@query("latest_definition", "SELECT bucket_id, arg_max(definition, item_ts) AS definition FROM m_items WHERE definition IS NOT NULL GROUP BY 1")
def _(t):
    return scan.latest_definition(t.items)


@query("longest_definition", "SELECT bucket_id, definition FROM (SELECT bucket_id, definition, row_number() OVER (PARTITION BY bucket_id ORDER BY length(definition) DESC, item_id) AS n FROM m_items) WHERE n = 1")
def _(t):
    return scan.longest_definition(t.items).select("bucket_id", "definition")


@query("session_last_message", "SELECT s.session_id, l.message_id, l.role, CASE WHEN length(l.content) <= 80 THEN l.content ELSE substr(l.content, 1, 80) || '...' END AS preview, s.n AS messages FROM (SELECT session_id, count(*) AS n FROM m_messages GROUP BY 1) s LEFT JOIN LATERAL (SELECT * FROM m_messages m WHERE m.session_id = s.session_id ORDER BY ts DESC, message_id DESC LIMIT 1) l ON true")
def _(t):
    return scan.last_message(t.messages)


@query("message_history_last", "SELECT session_id, message_id, CAST(n AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, message_id DESC) AS n FROM m_messages) WHERE n <= 4")
def _(t):
    return scan.last_rows(t.messages, "session_id", [F.desc("ts"), F.desc("message_id")], 4).select("session_id", "message_id", "position")


@query("messages_per_user", "SELECT user_id, count(*) AS messages, count(DISTINCT session_id) AS sessions FROM m_messages GROUP BY 1")
def _(t):
    return t.messages.groupBy("user_id").agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("session_id").alias("sessions"))


@query("recent_activity", "SELECT bucket_id, canonical FROM m_buckets ORDER BY last_accessed DESC, bucket_id LIMIT 15")
def _(t):
    return scan.recent(t.buckets, 15).select("bucket_id", "canonical")


@query("memories_of_document", "SELECT bucket_id, canonical, importance, strength FROM m_buckets WHERE document_id = 7 ORDER BY importance DESC, strength DESC, canonical, bucket_id")
def _(t):
    return scan.page(t.buckets.filter("document_id = 7"), F.desc("importance"), F.desc("strength"), F.col("canonical"), F.col("bucket_id"), limit=10_000).select("bucket_id", "canonical", "importance", "strength")


@query("strongest_memories", "SELECT bucket_id, strength, importance FROM m_buckets WHERE document_id IS NULL OR document_id <> 7 ORDER BY strength DESC, importance DESC, last_accessed DESC, bucket_id LIMIT 40")
def _(t):
    return scan.page(t.buckets.filter(scan.not_in_document(7)), F.desc("strength"), F.desc("importance"), F.desc("last_accessed"), F.col("bucket_id"), limit=40).select("bucket_id", "strength", "importance")


@query("uuid_guard", "SELECT count(*) AS n, count(*) FILTER (regexp_matches(x, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$')) AS valid FROM (SELECT CASE bucket_id % 3 WHEN 0 THEN '3f2504e0-4f89-41d3-9a0c-0305e82c3301' WHEN 1 THEN canonical ELSE NULL END AS x FROM m_buckets)")
def _(t):
    x = F.when(F.col("bucket_id") % 3 == 0, "3f2504e0-4f89-41d3-9a0c-0305e82c3301").when(F.col("bucket_id") % 3 == 1, F.col("canonical"))
    return t.buckets.agg(F.count(F.lit(1)).alias("n"), F.count_if(scan.is_uuid(x)).alias("valid"))


VECTOR = "(SELECT embedding FROM m_embeddings WHERE bucket_id = 0)"
SIMILAR = f"SELECT e.bucket_id, {cosine('e.embedding', 'q.embedding')} AS similarity FROM m_embeddings e, {VECTOR} q"


def out(df):
    return df.select("bucket_id", r4(F.col("similarity")).alias("similarity"))


@query("vector_topk", f"SELECT bucket_id, CAST({sql_r4('similarity')} AS DOUBLE) AS similarity FROM (SELECT * FROM ({SIMILAR}) ORDER BY similarity DESC, bucket_id LIMIT 20)")
def _(t):
    return out(search.by_vector(t.embeddings, search.vector_of(t.embeddings, 0), 20))


@query("vector_topk_threshold", f"SELECT bucket_id, CAST({sql_r4('similarity')} AS DOUBLE) AS similarity FROM (SELECT * FROM ({SIMILAR}) WHERE similarity >= 0.15 ORDER BY similarity DESC, bucket_id LIMIT 30)")
def _(t):
    return out(search.by_vector(t.embeddings, search.vector_of(t.embeddings, 0), 30, 0.15))


@query("vector_correlation_limit_then_threshold", f"SELECT bucket_id, CAST({sql_r4('similarity')} AS DOUBLE) AS similarity FROM (SELECT * FROM ({SIMILAR}) ORDER BY similarity DESC, bucket_id LIMIT 30) WHERE similarity >= 0.2")
def _(t):
    return out(search.by_vector(t.embeddings, search.vector_of(t.embeddings, 0), 30, 0.2, threshold_first=False))


@query("vector_topk_tenant", f"SELECT s.bucket_id, CAST({sql_r4('similarity')} AS DOUBLE) AS similarity FROM ({SIMILAR}) s JOIN m_buckets b ON s.bucket_id = b.bucket_id WHERE b.user_id = 1 ORDER BY s.similarity DESC, s.bucket_id LIMIT 20")
def _(t):
    own = scan.by_ids(t.embeddings, t.buckets.filter("user_id = 1"))
    return out(search.by_vector(own, search.vector_of(t.embeddings, 0), 20))


@query("vector_topk_document", f"SELECT s.bucket_id, CAST({sql_r4('similarity')} AS DOUBLE) AS similarity FROM ({SIMILAR}) s JOIN m_buckets b ON s.bucket_id = b.bucket_id WHERE b.document_id = 7 AND similarity >= -1 ORDER BY s.similarity DESC, s.bucket_id LIMIT 20")
def _(t):
    own = scan.by_ids(t.embeddings, t.buckets.filter("document_id = 7"))
    return out(search.by_vector(own, search.vector_of(t.embeddings, 0), 20))


@query("vector_statistics", f"SELECT count(*) AS n, CAST({sql_r4('avg(sqrt(list_sum(list_transform(embedding, lambda x: x * x))))')} AS DOUBLE) AS mean_norm FROM m_embeddings")
def _(t):
    from ..functions.vector import magnitude, valid

    return t.embeddings.filter(valid(F.col("embedding"))).agg(F.count(F.lit(1)).alias("n"), r4(F.avg(magnitude(F.col("embedding")))).alias("mean_norm"))


@query("vector_approximate_pairs")
def _(t):
    return knn.approximate(t.embeddings, t.embeddings, 0.2).select("query_id", "neighbour_id", r4(F.col("similarity")).alias("similarity"))


@query("orphan_embeddings", "SELECT e.bucket_id FROM m_embeddings e LEFT JOIN m_buckets b ON e.bucket_id = b.bucket_id WHERE b.bucket_id IS NULL")
def _(t):
    return merge.reconcile_embeddings(t.buckets, t.embeddings)[0].select("bucket_id")


@query("missing_embeddings", "SELECT b.bucket_id FROM m_buckets b LEFT JOIN m_embeddings e ON e.bucket_id = b.bucket_id WHERE e.bucket_id IS NULL")
def _(t):
    return merge.reconcile_embeddings(t.buckets, t.embeddings)[1].select("bucket_id")


@query("count_by_type", "SELECT concept_type, count(*) AS n FROM m_buckets GROUP BY 1")
def _(t):
    return cortex.counts_by(t.buckets, "concept_type")


@query("count_by_relation", "SELECT relation_type, count(*) AS n FROM m_edges GROUP BY 1")
def _(t):
    return cortex.counts_by(t.edges, "relation_type")


@query("storage_usage", "SELECT user_id, count(*) AS documents, CAST(sum(strlen(content)) AS BIGINT) AS bytes, CAST(floor(sum(strlen(content)) / 1048576.0 * 100 + 0.5) / 100 AS DOUBLE) AS megabytes FROM m_documents GROUP BY 1")
def _(t):
    return cortex.storage(t.documents)


@query("knowledge_base_state", """
SELECT u.user_id, coalesce(b.n, 0) AS memories, coalesce(d.n, 0) AS documents, coalesce(e.n, 0) AS edges, coalesce(b.n, 0) + coalesce(d.n, 0) > 0 AS has_knowledge
FROM (SELECT user_id FROM m_buckets UNION SELECT user_id FROM m_documents) u
LEFT JOIN (SELECT user_id, count(*) AS n FROM m_buckets GROUP BY 1) b ON u.user_id = b.user_id LEFT JOIN (SELECT user_id, count(*) AS n FROM m_documents GROUP BY 1) d ON u.user_id = d.user_id
LEFT JOIN (SELECT b.user_id, count(*) AS n FROM m_edges e JOIN m_buckets b ON e.source_bucket_id = b.bucket_id GROUP BY 1) e ON u.user_id = e.user_id""")
def _(t):
    return cortex.knowledge_state(t.buckets, t.documents, t.edges)


@query("documents_with_memory_count", "SELECT d.document_id, d.user_id, d.filename, count(b.bucket_id) AS memory_count FROM m_documents d LEFT JOIN m_buckets b ON b.document_id = d.document_id GROUP BY ALL")
def _(t):
    return cortex.documents_with_counts(t.documents, t.buckets)


@query("archive_inventory", """
WITH r AS (SELECT document_id, canonical, row_number() OVER (PARTITION BY document_id ORDER BY importance DESC, strength DESC, bucket_id) AS n FROM m_buckets WHERE document_id IS NOT NULL),
c AS (SELECT document_id, string_agg(canonical, '; ' ORDER BY n) AS top FROM r WHERE n <= 3 GROUP BY 1)
SELECT d.document_id, d.user_id, d.filename, (SELECT count(*) FROM m_buckets b WHERE b.document_id = d.document_id) AS memory_count, coalesce(c.top, '') AS top_concepts FROM m_documents d LEFT JOIN c ON c.document_id = d.document_id""")
def _(t):
    return cortex.archive(t.documents, t.buckets)


@query("high_importance_per_document", "SELECT bucket_id, document_id, importance, strength, CAST(n AS INT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(CAST(document_id AS VARCHAR), 'none') ORDER BY importance DESC, strength DESC, last_accessed DESC, bucket_id) AS n FROM m_buckets) WHERE n <= 4")
def _(t):
    return cortex.high_importance(t.buckets)


KEY = r"""array_to_string(list_sort(list_filter(string_split(regexp_replace(CASE WHEN ends_with(lower(canonical), ' system') THEN left(lower(canonical), -7) WHEN ends_with(lower(canonical), ' module') THEN left(lower(canonical), -7) ELSE lower(canonical) END, '[^a-z0-9 ]', '', 'g'), ' '), lambda x: x <> '')), '_')"""


@query("normalize_key", f"SELECT bucket_id, {KEY} AS normalized FROM m_buckets")
def _(t):
    return t.buckets.select("bucket_id", normalize_key(F.col("canonical")).alias("normalized"))


@query("bucket_dedupe_merge", f"SELECT user_id, {KEY} AS normalized, min(bucket_id) AS bucket_id, arg_min(canonical, bucket_id) AS canonical, max(importance) AS importance, max(strength) AS strength, CAST(sum(access_count) AS BIGINT) AS access_count, count(*) AS merged FROM m_buckets GROUP BY 1, 2")
def _(t):
    return merge.merged_buckets(t.buckets).drop("last_accessed")


@query("bulk_upsert", f"""
WITH k AS (SELECT *, {KEY} AS normalized FROM m_buckets),
old AS (SELECT user_id, normalized, arg_min(canonical, bucket_id) AS canonical, max(importance) AS importance, max(strength) AS strength, CAST(sum(access_count) AS BIGINT) AS access_count FROM k WHERE bucket_id % 2 = 0 GROUP BY 1, 2),
fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, normalized ORDER BY importance DESC, length(canonical) DESC, bucket_id) AS n FROM k WHERE bucket_id % 2 = 1) WHERE n = 1)
SELECT coalesce(o.user_id, f.user_id) AS user_id, coalesce(o.normalized, f.normalized) AS normalized, coalesce(o.canonical, f.canonical) AS canonical, CAST(greatest(coalesce(o.importance, 0), coalesce(f.importance, 0)) AS INT) AS importance,
 CAST({sql_r4('CASE WHEN o.normalized IS NULL THEN 0.5 WHEN f.normalized IS NULL THEN o.strength ELSE least(1.0, 0.7 * o.strength + 0.3) END')} AS DOUBLE) AS strength,
 CASE WHEN o.normalized IS NULL THEN 0 WHEN f.normalized IS NULL THEN o.access_count ELSE o.access_count + 1 END AS access_count, CASE WHEN o.normalized IS NULL THEN 'created' WHEN f.normalized IS NULL THEN 'kept' ELSE 'merged' END AS action
FROM old o FULL JOIN fresh f ON o.user_id = f.user_id AND o.normalized = f.normalized""")
def _(t):
    old = merge.merged_buckets(t.buckets.filter("bucket_id % 2 = 0"))
    fresh = t.buckets.filter("bucket_id % 2 = 1").select("user_id", "canonical", "importance", F.col("canonical").alias("definition"), F.col("bucket_id").alias("ordinal"))
    return merge.upsert_buckets(old, fresh, AS_OF).select("user_id", "normalized", "canonical", "importance", r4(F.col("strength")).alias("strength"), "access_count", "action")


@query("bulk_upsert_stats", f"WITH k AS (SELECT *, {KEY} AS normalized FROM m_buckets), o AS (SELECT DISTINCT user_id, normalized FROM k WHERE bucket_id % 2 = 0), f AS (SELECT DISTINCT user_id, normalized FROM k WHERE bucket_id % 2 = 1) SELECT CASE WHEN o.normalized IS NULL THEN 'created' WHEN f.normalized IS NULL THEN 'kept' ELSE 'merged' END AS action, count(*) AS n FROM o FULL JOIN f ON o.user_id = f.user_id AND o.normalized = f.normalized GROUP BY 1")
def _(t):
    old = merge.merged_buckets(t.buckets.filter("bucket_id % 2 = 0"))
    fresh = t.buckets.filter("bucket_id % 2 = 1").select("user_id", "canonical", "importance", F.col("canonical").alias("definition"), F.col("bucket_id").alias("ordinal"))
    return cortex.counts_by(merge.upsert_buckets(old, fresh, AS_OF), "action")


@query("embedding_upsert", f"SELECT bucket_id, CAST({sql_r4('CASE WHEN bucket_id % 3 = 0 THEN 2 * embedding[1] ELSE embedding[1] END')} AS DOUBLE) AS first_component FROM m_embeddings")
def _(t):
    new = t.embeddings.filter("bucket_id % 3 = 0").select("bucket_id", F.transform("embedding", lambda x: 2 * x).alias("embedding"), F.lit(2).alias("ordinal"))
    old = t.embeddings.filter("bucket_id % 3 = 0").select("bucket_id", "embedding", F.lit(1).alias("ordinal"))
    return merge.upsert_embeddings(t.embeddings, new.unionByName(old)).select("bucket_id", r4(F.col("embedding")[0]).alias("first_component"))


@query("relationship_upsert", """
WITH old AS (SELECT * FROM m_edges WHERE source_bucket_id % 2 = 0), fresh AS (SELECT source_bucket_id, target_bucket_id, relation_type, confidence / 2 AS confidence, 'ai' AS method FROM m_edges)
SELECT f.source_bucket_id, f.target_bucket_id, f.relation_type, CAST(coalesce(greatest(o.confidence, f.confidence), f.confidence) AS DOUBLE) AS confidence, coalesce(o.method, f.method) AS method, 'again' AS source_text, CASE WHEN o.method IS NULL THEN 'new' ELSE 'old' END AS first_seen, 'new' AS last_seen
FROM fresh f LEFT JOIN old o ON f.source_bucket_id = o.source_bucket_id AND f.target_bucket_id = o.target_bucket_id AND f.relation_type = o.relation_type""")
def _(t):
    meta = lambda **x: F.create_map(*(F.lit(v) for p in x.items() for v in p))
    old = t.edges.filter("source_bucket_id % 2 = 0").withColumn("source_text", F.lit("first")).withColumn("metadata", meta(first_seen="old", last_seen="old"))
    fresh = t.edges.select("source_bucket_id", "target_bucket_id", "relation_type", (F.col("confidence") / 2).alias("confidence"), F.lit("ai").alias("method"), F.lit("again").alias("source_text"), meta(last_seen="new").alias("metadata"))
    merged = merge.upsert_edges(old, fresh)
    return merged.select("source_bucket_id", "target_bucket_id", "relation_type", "confidence", "method", "source_text", F.coalesce(F.col("metadata")["first_seen"], F.lit("new")).alias("first_seen"), F.col("metadata")["last_seen"].alias("last_seen"))


@query("content_hash_dedupe", "WITH n AS (SELECT user_id, sha256(content) AS content_hash, min(document_id) AS document_id FROM m_documents WHERE document_id % 2 = 1 GROUP BY 1, 2) SELECT n.* FROM n WHERE NOT EXISTS (SELECT 1 FROM m_documents d WHERE d.document_id % 2 = 0 AND d.user_id = n.user_id AND sha256(d.content) = n.content_hash)")
def _(t):
    return merge.new_by_content(t.documents.filter("document_id % 2 = 0"), t.documents.filter("document_id % 2 = 1")).select("user_id", "content_hash", "document_id")


@query("partial_update", "SELECT bucket_id, CASE WHEN bucket_id % 10 = 0 THEN canonical || ' renamed' ELSE canonical END AS canonical, importance FROM m_buckets")
def _(t):
    changes = t.buckets.filter("bucket_id % 10 = 0").select("bucket_id", F.concat("canonical", F.lit(" renamed")).alias("canonical"), F.lit(None).cast("int").alias("importance"))
    return merge.updated(t.buckets, "bucket_id", changes).select("bucket_id", "canonical", "importance")


@query("document_delete_cascade", "WITH k AS (SELECT bucket_id FROM m_buckets WHERE document_id IS NULL OR document_id <> 7) SELECT (SELECT count(*) FROM k) AS buckets, (SELECT count(*) FROM m_items WHERE bucket_id IN (FROM k)) AS items, (SELECT count(*) FROM m_edges WHERE source_bucket_id IN (FROM k) AND target_bucket_id IN (FROM k)) AS edges, (SELECT count(*) FROM m_embeddings WHERE bucket_id IN (FROM k)) AS embeddings")
def _(t):
    left = merge.without_document(7, t.buckets, t.items, t.edges, t.embeddings, t.documents)
    n = lambda name: left[name].agg(F.count(F.lit(1)).alias(name))
    return n("buckets").crossJoin(n("items")).crossJoin(n("edges")).crossJoin(n("embeddings"))  # single rows


@query("owned_delete", "SELECT bucket_id FROM m_buckets WHERE NOT (bucket_id % 4 = 0 AND user_id = 2)")
def _(t):
    return merge.deleted(t.buckets, t.buckets.filter("bucket_id % 4 = 0"), "bucket_id", owner=2).select("bucket_id")


@query("user_registration", "SELECT user_id, lower(email) AS email FROM m_users UNION ALL SELECT 99, 'new@example.org'")
def _(t):
    fresh = t.users.select((F.col("user_id") + 50).alias("user_id"), F.upper("email").alias("email")).unionByName(t.users.limit(1).select(F.lit(99).cast("long").alias("user_id"), F.lit(" New@example.org").alias("email"))).withColumns({"sandbox": F.lit(False), "expires_at": F.lit(None).cast("timestamp")})
    return merge.registered(t.users, fresh).select("user_id", "email")


@query("upload_quota", "SELECT user_id, document_id AS upload_id, row_number() OVER (PARTITION BY user_id ORDER BY document_id) + 3 <= 10 AS accepted FROM m_documents")
def _(t):
    return merge.within_quota(t.documents.select("user_id", F.col("document_id").alias("upload_id")), t.users.select("user_id", F.lit(3).alias("used")), 10).select("user_id", "upload_id", "accepted")


@query("json_metadata_extract", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events")
def _(t):
    return t.raw("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.nullif(F.get_json_object("props", "$.missing"), F.lit("")), F.lit("none")).alias("missing"))


@query("message_previews", "SELECT message_id, CASE WHEN length(content) <= 80 THEN content ELSE substr(content, 1, 80) || '...' END AS preview FROM m_messages")
def _(t):
    return t.messages.select("message_id", preview(F.col("content")).alias("preview"))


@query("fuzzy_label_search", """
WITH l AS (SELECT bucket_id, trim(regexp_replace(lower(canonical), '[^a-z0-9]+', ' ', 'g')) AS label FROM m_buckets),
p AS (SELECT bucket_id, CASE WHEN label = 'ring' THEN 6 WHEN starts_with(label, 'ring') THEN 4 WHEN contains(label, 'ring') THEN 2 ELSE 0 END AS a, CASE WHEN label = 'system' THEN 6 WHEN starts_with(label, 'system') THEN 4 WHEN contains(label, 'system') THEN 2 ELSE 0 END AS b FROM l)
SELECT bucket_id, CAST(a + b AS INT) AS points FROM p WHERE a > 0 AND b > 0""")
def _(t):
    return search.fuzzy(t.buckets, "canonical", "Ring system").select("bucket_id", "points")
