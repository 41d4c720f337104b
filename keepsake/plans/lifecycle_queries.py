"""Registered queries: decay, tiers, reminders, expiry, jobs, streams in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import decay
from ..functions.numbers import r4
from ..operators import lifecycle, merge
from ..schema import AS_OF
from ..streaming import jobs, reinforce, reminders, sessions
from .catalog import AS_OF_SQL, CURRENT, DAYS, query, tier, unit
from .catalog import r4 as sql_r4


@query("current_strength", f"SELECT bucket_id, CAST({CURRENT} AS DOUBLE) AS strength, {tier(CURRENT)} AS tier FROM m_buckets")
def _(t):
    return lifecycle.with_current(t.buckets, AS_OF).select("bucket_id", F.col("current").alias("strength"), "tier")


@query("average_strength", f"SELECT count(*) AS total, CAST(coalesce({sql_r4(f'avg({CURRENT})')}, 0) AS DOUBLE) AS average_strength FROM m_buckets")
def _(t):
    return lifecycle.buckets_mean(t.buckets, AS_OF)


@query("count_by_tier_filter", "SELECT count(*) FILTER (strength >= 0.7) AS strong, count(*) FILTER (strength >= 0.4 AND strength < 0.7) AS fading, count(*) FILTER (strength >= 0.1 AND strength < 0.4) AS critical, count(*) FILTER (strength < 0.1) AS forgotten FROM m_buckets WHERE strength > 0")
def _(t):
    return lifecycle.tier_counts(t.buckets)


@query("count_by_category_overlapping", "SELECT count(*) FILTER (strength >= 0.7) AS strong, count(*) FILTER (strength >= 0.1 AND strength < 0.7) AS fading, count(*) FILTER (strength >= 0.01 AND strength < 0.4) AS critical, count(*) FILTER (strength < 0.1) AS forgotten FROM m_buckets")
def _(t):
    return lifecycle.overlapping_counts(t.buckets)


@query("status_summary", f"WITH c AS (SELECT {CURRENT} AS s FROM m_buckets) SELECT count(*) FILTER (s >= 0.7) AS strong, count(*) FILTER (s >= 0.4 AND s < 0.7) AS fading, count(*) FILTER (s >= 0.1 AND s < 0.4) AS critical, count(*) FILTER (s < 0.1 AND s > 0) AS forgotten, count(*) AS total, CAST(coalesce({sql_r4('avg(s)')}, 0) AS DOUBLE) AS average_strength FROM c")
def _(t):
    return lifecycle.status(t.buckets, AS_OF)


@query("strength_histogram", f"WITH b AS (SELECT unnest(range(5)) AS bin), c AS (SELECT CAST(least(floor({CURRENT} * 5), 4) AS INT) AS bin, count(*) AS n FROM m_buckets GROUP BY 1) SELECT CAST(b.bin AS INT) AS bin, b.bin / 5.0 AS low, coalesce(c.n, 0) AS n FROM b LEFT JOIN c ON b.bin = c.bin")
def _(t):
    return lifecycle.histogram(t.buckets, AS_OF)


@query("strongest_by_tier", f"SELECT * FROM (SELECT tier, CAST(row_number() OVER (PARTITION BY tier ORDER BY strength DESC, bucket_id) AS INT) AS n, bucket_id, strength FROM (SELECT bucket_id, CAST({CURRENT} AS DOUBLE) AS strength, {tier(CURRENT)} AS tier FROM m_buckets)) WHERE n <= 10")
def _(t):
    return lifecycle.by_tier(t.buckets, AS_OF)


@query("decay_curve", f"SELECT bucket_id, CAST(day AS INT) AS day, CAST(CASE WHEN day <= 0 THEN strength ELSE {unit(sql_r4('strength * pow(1 - decay_rate, day)'))} END AS DOUBLE) AS strength FROM (SELECT *, unnest(range(31)) AS day FROM m_buckets)")
def _(t):
    return lifecycle.curves(t.buckets, 30)


SCAN = f"SELECT bucket_id, user_id, strength AS old_strength, CAST({CURRENT} AS DOUBLE) AS new_strength FROM m_buckets"


@query("decay_scan", f"SELECT *, {tier('old_strength')} AS old_tier, {tier('new_strength')} AS new_tier, {tier('old_strength')} <> {tier('new_strength')} AS crossed, CASE WHEN new_strength < old_strength THEN 'down' ELSE 'up' END AS direction FROM ({SCAN}) WHERE abs(new_strength - old_strength) >= 0.001")
def _(t):
    return lifecycle.decay_scan(t.buckets, AS_OF)


@query("threshold_crossings", f"SELECT bucket_id, {tier('old_strength')} AS old_tier, {tier('new_strength')} AS new_tier FROM ({SCAN}) WHERE abs(new_strength - old_strength) >= 0.001 AND {tier('old_strength')} <> {tier('new_strength')}")
def _(t):
    return lifecycle.decay_scan(t.buckets, AS_OF).filter("crossed").select("bucket_id", "old_tier", "new_tier")


@query("decay_scan_statistics", f"WITH s AS (SELECT *, abs(new_strength - old_strength) >= 0.001 AS moved FROM ({SCAN})) SELECT count(*) AS scanned, count(*) FILTER (moved) AS updated, count(*) FILTER (moved AND {tier('old_strength')} <> {tier('new_strength')}) AS crossings, CAST({sql_r4('avg(new_strength)')} AS DOUBLE) AS average_strength FROM s")
def _(t):
    rows = lifecycle.with_current(t.buckets, AS_OF)
    moved = F.abs(F.col("current") - F.col("strength")) >= 0.001
    return rows.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(moved).alias("updated"), F.count_if(moved & (decay.category(F.col("strength")) != F.col("tier"))).alias("crossings"), r4(F.avg("current")).alias("average_strength"))


@query("decay_scan_sql_variant", f"WITH a AS (SELECT *, (epoch_us({AS_OF_SQL}) - epoch_us(last_accessed)) / 1000000.0 AS seconds FROM m_buckets) SELECT bucket_id, seconds > 86400 AND strength > 0.001 AS updated, CAST({sql_r4('CASE WHEN seconds > 86400 AND strength > 0.001 THEN ' + unit('strength * pow(1 - CASE WHEN importance >= 8 THEN 0.10 WHEN importance <= 3 THEN 0.20 ELSE 0.15 END, seconds / 86400.0)') + ' ELSE strength END')} AS DOUBLE) AS new_strength FROM a")
def _(t):
    return lifecycle.decay_by_age(t.buckets, AS_OF).select("bucket_id", "updated", r4(F.col("new_strength")).alias("new_strength"))


@query("days_until_forgotten", f"SELECT bucket_id, CAST({sql_r4('CASE WHEN strength <= 0.1 THEN 0.0 ELSE ln(0.1 / strength) / ln(1 - decay_rate) END')} AS DOUBLE) AS days FROM m_buckets")
def _(t):
    return t.buckets.select("bucket_id", r4(decay.days_until(F.col("strength"), F.col("decay_rate"), 0.1)).alias("days"))


@query("tier_rates", "SELECT DISTINCT importance, CAST(CASE WHEN importance >= 8 THEN 0.10 WHEN importance >= 5 THEN 0.15 ELSE 0.20 END AS DOUBLE) AS by_importance, CAST(CASE WHEN importance >= 8 THEN 0.10 WHEN importance <= 3 THEN 0.20 ELSE 0.15 END AS DOUBLE) AS by_scan FROM m_buckets")
def _(t):
    return t.buckets.select("importance", decay.tier_by_importance(F.col("importance")).alias("by_importance"), decay.tier_scan(F.col("importance")).alias("by_scan")).distinct()


CRITICAL = f"SELECT * FROM (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY importance DESC, strength, bucket_id) AS INT) AS n, bucket_id, canonical, importance, strength FROM (SELECT * REPLACE (CAST({CURRENT} AS DOUBLE) AS strength) FROM m_buckets) WHERE importance >= 7 AND strength < 0.4) WHERE n <= 5"


@query("critical_memories_topk", CRITICAL)
def _(t):
    return lifecycle.critical(t.buckets, AS_OF)


@query("reminders_due", f"WITH c AS ({CRITICAL}), g AS (SELECT user_id, list(canonical ORDER BY n) AS names, string_agg(CAST(bucket_id AS VARCHAR), ',' ORDER BY n) AS memories FROM c GROUP BY 1) SELECT user_id, memories, 'You haven''t discussed ' || CASE WHEN len(names) > 1 THEN array_to_string(names[1:-2], ', ') || ' and ' || names[-1] ELSE names[1] END || ' recently. ' || len(names) || CASE WHEN len(names) = 1 THEN ' key memory is' ELSE ' key memories are' END || ' fading. Should I keep them active?' AS message FROM g WHERE user_id <> 0")
def _(t):
    sent = t.users.filter("user_id = 0").select("user_id", (F.lit(AS_OF) - F.expr("INTERVAL 3 HOURS")).alias("created_at"))
    return lifecycle.reminders(t.buckets, sent, AS_OF).select("user_id", F.array_join(F.transform("memories", lambda x: x.cast("string")), ",").alias("memories"), "message")


@query("expired_sandbox", f"SELECT user_id FROM m_users WHERE sandbox AND expires_at < {AS_OF_SQL}")
def _(t):
    return lifecycle.expired_sandboxes(t.users, AS_OF).select("user_id")


@query("tenant_purge", """
WITH kept AS (SELECT * FROM m_buckets WHERE user_id <> 4)
SELECT 'buckets' AS "table", count(*) AS n FROM kept UNION ALL SELECT 'users', count(*) FROM m_users WHERE user_id <> 4
UNION ALL SELECT 'items', count(*) FROM m_items WHERE bucket_id IN (SELECT bucket_id FROM kept)
UNION ALL SELECT 'embeddings', count(*) FROM m_embeddings WHERE bucket_id IN (SELECT bucket_id FROM kept)
UNION ALL SELECT 'edges', count(*) FROM m_edges WHERE source_bucket_id IN (SELECT bucket_id FROM kept) AND target_bucket_id IN (SELECT bucket_id FROM kept)
UNION ALL SELECT 'documents', count(*) FROM m_documents WHERE user_id <> 4 UNION ALL SELECT 'messages', count(*) FROM m_messages WHERE user_id <> 4""")
def _(t):
    left = lifecycle.purged(t.users, lifecycle.expired_sandboxes(t.users, AS_OF), buckets=t.buckets, items=t.items, embeddings=t.embeddings, edges=t.edges, documents=t.documents, messages=t.messages)
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n") for name, df in left.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("job_queue_claim", "SELECT job_id, user_id, 'processing' AS status, 'picked' AS stage, CAST(0 AS INT) AS progress FROM m_jobs WHERE status = 'queued' ORDER BY started_at, job_id LIMIT 1")
def _(t):
    return lifecycle.claim_job(t.jobs, AS_OF).select("job_id", "user_id", "status", "stage", "progress")


@query("job_latest_state", "WITH s AS (SELECT job_id, 'queued' AS stage, 0 AS moment FROM m_jobs UNION ALL SELECT job_id, 'parsing', 1 FROM m_jobs WHERE status <> 'queued' UNION ALL SELECT job_id, 'complete', 2 FROM m_jobs WHERE status = 'complete'), l AS (SELECT job_id, arg_max(stage, moment) AS stage FROM s GROUP BY 1) SELECT job_id, stage, CASE stage WHEN 'parsing' THEN 'processing' ELSE stage END AS status, CAST(CASE stage WHEN 'queued' THEN 0 WHEN 'parsing' THEN 10 ELSE 100 END AS INT) AS progress FROM l")
def _(t):
    j = t.jobs
    changes = j.select("job_id", F.lit("queued").alias("stage"), F.lit(0).alias("at")).unionByName(j.filter("status <> 'queued'").select("job_id", F.lit("parsing").alias("stage"), F.lit(1).alias("at"))).unionByName(j.filter("status = 'complete'").select("job_id", F.lit("complete").alias("stage"), F.lit(2).alias("at")))
    return lifecycle.latest_state(changes).drop("at")


@query("contradiction_pairs", r"""
WITH d AS (SELECT b.user_id, lower(b.canonical) AS name, i.definition, min(b.bucket_id) AS id FROM m_items i JOIN m_buckets b ON i.bucket_id = b.bucket_id WHERE i.item_id % 2 = 0 GROUP BY 1, 2, 3),
n AS (SELECT b.user_id, lower(b.canonical) AS name, i.definition, min(b.bucket_id) AS id FROM m_items i JOIN m_buckets b ON i.bucket_id = b.bucket_id WHERE i.item_id % 2 = 1 GROUP BY 1, 2, 3),
p AS (SELECT * FROM (VALUES ('is', 'is not'), ('can', 'cannot'), ('does', 'does not'), ('will', 'will not'), ('should', 'should not'), ('always', 'never'), ('increases', 'decreases'), ('enables', 'disables'), ('true', 'false'), ('correct', 'incorrect'), ('valid', 'invalid')) v(pos, neg))
SELECT d.user_id, d.name, d.id AS existing_id, n.id AS incoming_id, 'Existing: "' || substr(d.definition, 1, 100) || '" / new: "' || substr(n.definition, 1, 100) || '"' AS description
FROM d JOIN n ON d.user_id = n.user_id AND d.name = n.name
WHERE lower(d.definition) <> lower(n.definition) AND EXISTS (SELECT 1 FROM p WHERE (contains(lower(d.definition), pos) AND contains(lower(n.definition), neg)) OR (contains(lower(d.definition), neg) AND contains(lower(n.definition), pos)))""")
def _(t):
    rows = t.items.join(t.buckets.select("bucket_id", "user_id", "canonical"), "bucket_id")
    return lifecycle.contradictions(rows.filter("item_id % 2 = 0"), rows.filter("item_id % 2 = 1"))


@query("reinforcement_batch")
def _(t):
    return reinforce.reinforced_batch(t.access, t.buckets).select("bucket_id", "strength", "access_count", F.unix_timestamp("last_accessed").alias("last_accessed"))


@query("reinforcement_closed_form", f"WITH a AS (SELECT bucket_id, count(*) AS n FROM m_access GROUP BY 1) SELECT a.bucket_id, n, CAST({sql_r4('1.0 - (1 - b.strength) * pow(0.7, n)')} AS DOUBLE) AS strength FROM a JOIN m_buckets b ON a.bucket_id = b.bucket_id")
def _(t):
    counted = t.access.groupBy("bucket_id").agg(F.count(F.lit(1)).alias("n")).join(t.buckets.select("bucket_id", "strength"), "bucket_id")
    return counted.select("bucket_id", "n", r4(decay.reinforced_closed_form(F.col("strength"), F.col("n"))).alias("strength"))


@query("boosted_memories", f"WITH c AS ({CRITICAL}) SELECT b.bucket_id, CAST(CASE WHEN c.bucket_id IS NULL THEN b.strength ELSE 1.0 END AS DOUBLE) AS strength FROM m_buckets b LEFT JOIN c ON b.bucket_id = c.bucket_id")
def _(t):
    return merge.boosted(t.buckets, lifecycle.critical(t.buckets, AS_OF)).select("bucket_id", "strength")


@query("reminder_suppression", """
WITH RECURSIVE moment AS MATERIALIZED (SELECT user_id, ts, min(bucket_id) AS bucket_id FROM m_access GROUP BY user_id, ts),
sent(user_id, ts) AS (SELECT user_id, min(ts) FROM moment GROUP BY user_id
  UNION ALL SELECT s.user_id, (SELECT min(m.ts) FROM moment m WHERE m.user_id = s.user_id AND m.ts > s.ts + INTERVAL '24' HOUR) FROM sent s WHERE s.ts IS NOT NULL)
SELECT m.user_id, m.bucket_id, epoch_us(m.ts) // 1000000 AS ts FROM sent s JOIN moment m ON s.user_id = m.user_id AND s.ts = m.ts""")
def _(t):
    return reminders.reminded_batch(t.access, 24).select("user_id", "bucket_id", F.unix_timestamp("ts").alias("ts"))


@query("conversation_sessionize", """
WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY session_id ORDER BY ts, message_id)) <= 900000000 THEN 0 ELSE 1 END AS fresh FROM m_messages),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts, message_id ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT session_id, CAST(island AS INT) AS session_no, CAST(epoch(min(ts)) AS BIGINT) AS start, CAST(epoch(max(ts)) AS BIGINT) AS "end", count(*) AS messages FROM i GROUP BY session_id, island""")
def _(t):
    return sessions.split_sessions(t.messages).select("session_id", "session_no", F.unix_timestamp("start").alias("start"), F.unix_timestamp("end").alias("end"), "messages")


@query("session_windows", """
WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY session_id ORDER BY ts, message_id)) < 900000000 THEN 0 ELSE 1 END AS fresh FROM m_messages),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts, message_id ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT session_id, CAST(epoch(min(ts)) AS BIGINT) AS start, CAST(epoch(max(ts)) + 900 AS BIGINT) AS "end", count(*) AS messages FROM i GROUP BY session_id, island""")
def _(t):
    return sessions.sessions(t.messages).select("session_id", F.unix_timestamp("start").alias("start"), F.unix_timestamp("end").alias("end"), "messages")


EVENTS = "SELECT *, CAST(ts AS TIMESTAMP) AS stamp FROM events"


@query("event_tumbling", f"SELECT CAST(floor(epoch(stamp) / 3600) * 3600 AS BIGINT) AS start, event_type, count(*) AS events, CAST({sql_r4('sum(value)')} AS DOUBLE) AS value FROM ({EVENTS}) GROUP BY 1, 2")
def _(t):
    return sessions.windowed_counts(t.raw("events").withColumn("ts", F.col("ts").cast("timestamp")), "1 hour").select(F.unix_timestamp("start").alias("start"), "event_type", "events", r4(F.col("value")).alias("value"))


@query("event_sliding", f"SELECT CAST(floor(epoch(stamp) / 1800) * 1800 - k * 1800 AS BIGINT) AS start, event_type, count(*) AS events, CAST({sql_r4('sum(value)')} AS DOUBLE) AS value FROM ({EVENTS}), (VALUES (0), (1)) v(k) GROUP BY 1, 2")
def _(t):
    return sessions.windowed_counts(t.raw("events").withColumn("ts", F.col("ts").cast("timestamp")), "1 hour", "30 minutes").select(F.unix_timestamp("start").alias("start"), "event_type", "events", r4(F.col("value")).alias("value"))


@query("event_deduplicated", "SELECT count(DISTINCT event_id) AS events FROM events")
def _(t):
    raw = t.raw("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return sessions.deduplicated(raw.unionByName(raw)).agg(F.count(F.lit(1)).alias("events"))


@query("relative_times", f"WITH s AS (SELECT bucket_id, (epoch_us({AS_OF_SQL}) - epoch_us(last_accessed)) / 1000000.0 AS s, last_accessed AS ts FROM m_buckets) SELECT bucket_id, CASE WHEN s < 45 THEN 'just now' WHEN s < 604800 THEN CAST(floor(s / 86400 + 0.5) AS BIGINT) || 'd ago' WHEN s < 3024000 THEN CAST(floor(s / 604800 + 0.5) AS BIGINT) || 'w ago' ELSE strftime(ts, '%b %-d') END AS seen FROM s")
def _(t):
    from ..functions.times import relative

    return t.buckets.select("bucket_id", relative(F.col("last_accessed"), AS_OF).alias("seen"))


@query("job_payloads", "SELECT bucket_id, CASE WHEN bucket_id % 2 = 0 THEN 3 ELSE 0 END::BIGINT AS exact, CASE WHEN bucket_id % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS score, CASE WHEN bucket_id % 2 = 0 THEN 1 ELSE 0 END::INT AS warnings FROM m_buckets")
def _(t):
    raw = F.when(F.col("bucket_id") % 2 == 0, '{"connections": {"exactMerges": 3.7, "semanticConnections": -2, "connectionScore": 7}, "warnings": ["slow", null]}').otherwise("{}")
    return t.buckets.select("bucket_id", lifecycle.job_payload(raw).alias("p")).select("bucket_id", F.col("p.exactMerges").alias("exact"), F.col("p.connectionScore").alias("score"), F.size("p.warnings").alias("warnings"))


@query("active_reminders", "SELECT bucket_id AS reminder_id FROM m_buckets WHERE user_id = 1 AND bucket_id % 3 = 0 ORDER BY created_at DESC, bucket_id DESC")
def _(t):
    rows = t.buckets.select(F.col("bucket_id").alias("reminder_id"), "user_id", (F.col("bucket_id") % 3 == 0).alias("active"), "created_at")
    return lifecycle.active_reminders(rows, 1).select("reminder_id")


#: Jobs whose events a task replays.
JOBS_A_TASK = 50_000

#: Events of each job, by rule: a claim, signs of its worker, an end at some time, and claims of other workers later on.
JOB_EVENTS = (
    ("queued", 0, None, "true"), ("claim", 10, "first", "true"), ("parsing", 30, "first", "true"), ("extracting", 60, "first", "job_id % 5 <> 0"), ("complete", None, "first", "job_id % 11 <> 0"), ("failed", None, "first", "job_id % 11 = 0"),
    ("claim", 500, "w8", "true"), ("complete", 560, "w8", "job_id % 3 = 0"), ("claim", 900, "w9", "true"), ("parsing", 950, "w8", "true"), ("claim", 1300, "w7", "true"),
)


def job_events_sql(table: str) -> str:
    """The events as SQL for both engines; an end comes 100 to 460 seconds after the start, so that some leases of 300 run out before it."""
    one = lambda kind, seconds, worker, holds: f"SELECT job_id, '{kind}' AS kind, {'concat(' + repr('w') + ', CAST(job_id % 4 AS STRING))' if worker == 'first' else 'CAST(NULL AS STRING)' if worker is None else repr(worker)} AS worker, started_at + {'(100 + job_id % 7 * 60)' if seconds is None else seconds} * INTERVAL '1' SECOND AS moment FROM {table} WHERE {holds}"
    return " UNION ALL ".join(one(*e) for e in JOB_EVENTS)


JOB_REPLAY = f"""
WITH RECURSIVE jobs AS (SELECT * FROM m_jobs), event AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY moment, list_position(['queued', 'claim', 'parsing', 'extracting', 'complete', 'failed'], kind), worker) AS n FROM ({job_events_sql('jobs')})),
fold(job_id, n, stage, attempt, worker, deadline, moves) AS (SELECT DISTINCT job_id, CAST(0 AS BIGINT), 'none', 0, CAST(NULL AS VARCHAR), CAST(NULL AS TIMESTAMP), 0 FROM event
  UNION ALL SELECT job_id, n, CASE WHEN NOT hit THEN stage WHEN kind = 'claim' THEN 'picked' ELSE kind END, CASE WHEN hit AND kind = 'claim' THEN attempt + 1 ELSE attempt END, CASE WHEN hit AND kind = 'claim' THEN sender ELSE worker END,
    CASE WHEN NOT hit THEN deadline WHEN kind IN ('claim', 'parsing', 'extracting') THEN moment + INTERVAL '300' SECOND END, moves + CAST(hit AS INT)
  FROM (SELECT *, (kind = 'queued' AND stage = 'none') OR (kind = 'claim' AND stage = 'queued') OR (kind NOT IN ('queued', 'claim') AND stage IN ('picked', 'parsing', 'extracting') AND worker = sender) AS hit
    FROM (SELECT f.job_id, e.n, e.kind, e.worker AS sender, e.moment, f.attempt, CASE WHEN NOT lost THEN f.stage WHEN f.attempt >= 3 THEN 'failed' ELSE 'queued' END AS stage, CASE WHEN NOT lost THEN f.worker END AS worker, CASE WHEN NOT lost THEN f.deadline END AS deadline, f.moves + CAST(lost AS INT) AS moves
      FROM (SELECT f.*, coalesce(f.deadline < e.moment, false) AS lost FROM fold f JOIN event e ON f.job_id = e.job_id AND e.n = f.n + 1) f JOIN event e ON f.job_id = e.job_id AND e.n = f.n + 1))),
last AS (SELECT *, deadline IS NOT NULL AS lost FROM fold QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY n DESC) = 1),
done AS (SELECT job_id, CASE WHEN NOT lost THEN stage WHEN attempt >= 3 THEN 'failed' ELSE 'queued' END AS stage, attempt, moves + CAST(lost AS INT) AS moves FROM last)
SELECT job_id, stage AS status, stage, CASE stage WHEN 'queued' THEN 0 ELSE 100 END AS progress, attempt, CAST(moves AS BIGINT) AS moves FROM done"""


@query("job_replay", JOB_REPLAY)
def _(t):
    events = t.spark.sql(job_events_sql("{given}"), given=t.jobs).withColumnRenamed("moment", "at").withColumn("message", F.lit(None).cast("string"))
    return jobs.current(jobs.replayed(events, AS_OF, parts=t.parts_of("orders", JOBS_A_TASK))).select("job_id", "status", "stage", "progress", "attempt", "moves")
