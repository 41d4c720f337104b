"""Lifecycle: decay scans, status, crossings, reminders, contradictions, expiry, job states."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decay
from ..functions.numbers import r4
from ..functions.text import contradicts


def with_current(buckets: DataFrame, as_of: datetime) -> DataFrame:
    """days since the last access, current strength by the stored rate, and its tier."""
    days = decay.days_between(F.col("last_accessed"), F.lit(as_of))
    out = buckets.withColumn("days", days).withColumn("current", decay.strength_after(F.col("strength"), F.col("decay_rate"), F.col("days")))
    return out.withColumn("tier", decay.category(F.col("current")))


def decay_scan(buckets: DataFrame, as_of: datetime, least_change: float = 0.001) -> DataFrame:
    """Memories whose strength changes: old and new strength, both tiers, whether they differ and in which direction.

    One scan is one pure step; the time of the last access stays, so scans must not be chained."""
    rows = with_current(buckets, as_of).withColumn("old_tier", decay.category(F.col("strength")))
    changed = rows.filter(F.abs(F.col("current") - F.col("strength")) >= least_change)
    return changed.select("bucket_id", "user_id", F.col("strength").alias("old_strength"), F.col("current").alias("new_strength"), "old_tier", F.col("tier").alias("new_tier"), (F.col("old_tier") != F.col("tier")).alias("crossed"), F.when(F.col("current") < F.col("strength"), "down").otherwise("up").alias("direction"))


def decayed(buckets: DataFrame, as_of: datetime) -> DataFrame:
    """The table after a scan."""
    return with_current(buckets, as_of).withColumn("strength", F.when(F.abs(F.col("current") - F.col("strength")) >= 0.001, F.col("current")).otherwise(F.col("strength"))).select(buckets.columns)


def decay_by_age(buckets: DataFrame, as_of: datetime) -> DataFrame:
    """The one-statement scan: rows over a day old with some strength left decay by the scan rate, unrounded."""
    seconds = (F.unix_micros(F.lit(as_of)) - F.unix_micros("last_accessed")) / 1_000_000.0
    due = (seconds > 86_400) & (F.col("strength") > 0.001)
    later = decay.unrounded_strength(F.col("strength"), decay.tier_scan(F.col("importance")), seconds / 86_400.0)
    return buckets.withColumn("new_strength", F.when(due, later).otherwise(F.col("strength"))).withColumn("updated", due)


def tier_counts(buckets: DataFrame, column: str = "strength") -> DataFrame:
    """The four tiers of rows with some strength: a partition."""
    s = F.col(column)
    rows = buckets.filter(s > 0)
    return rows.agg(F.count_if(s >= 0.7).alias("strong"), F.count_if((s >= 0.4) & (s < 0.7)).alias("fading"), F.count_if((s >= 0.1) & (s < 0.4)).alias("critical"), F.count_if(s < 0.1).alias("forgotten"))


def overlapping_counts(buckets: DataFrame) -> DataFrame:
    """The listing's counts, which overlap."""
    s = F.col("strength")
    return buckets.agg(F.count_if(s >= 0.7).alias("strong"), F.count_if((s >= 0.1) & (s < 0.7)).alias("fading"), F.count_if((s >= 0.01) & (s < 0.4)).alias("critical"), F.count_if(s < 0.1).alias("forgotten"))


def status(buckets: DataFrame, as_of: datetime) -> DataFrame:
    """Tiers by current strength, total and mean."""
    return tier_counts(with_current(buckets, as_of), "current").crossJoin(buckets_mean(buckets, as_of))  # one row by one row


def buckets_mean(buckets: DataFrame, as_of: datetime) -> DataFrame:
    return with_current(buckets, as_of).agg(F.count(F.lit(1)).alias("total"), F.coalesce(r4(F.avg("current")), F.lit(0.0)).alias("average_strength"))


def histogram(buckets: DataFrame, as_of: datetime, bins: int = 5) -> DataFrame:
    """Rows in equal bins of current strength; the last includes 1, and empty bins are there too."""
    bin_ = F.least(F.floor(F.col("current") * bins), F.lit(bins - 1)).cast("int")
    found = with_current(buckets, as_of).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return buckets.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(found, "bin", "left").select("bin", (F.col("bin") / float(bins)).alias("low"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def by_tier(buckets: DataFrame, as_of: datetime, most: int = 10) -> DataFrame:
    """The strongest memories of each tier."""
    rank = F.row_number().over(Window.partitionBy("tier").orderBy(F.desc("current"), "bucket_id"))
    return with_current(buckets, as_of).withColumn("n", rank).filter(F.col("n") <= most).select("tier", "n", "bucket_id", F.col("current").alias("strength"))


def curves(buckets: DataFrame, days: int) -> DataFrame:
    return buckets.select("bucket_id", F.explode(decay.curve(F.col("strength"), F.col("decay_rate"), days)).alias("p")).select("bucket_id", "p.day", "p.strength")


def critical(buckets: DataFrame, as_of: datetime, least_importance: int = 7, most: int = 5) -> DataFrame:
    """A tenant's memories that fade although they matter: importance first, then the weakest."""
    rows = with_current(buckets, as_of).filter((F.col("importance") >= least_importance) & (F.col("current") < 0.4))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("importance"), "current", "bucket_id"))
    return rows.withColumn("n", rank).filter(F.col("n") <= most).select("user_id", "n", "bucket_id", "canonical", "importance", F.col("current").alias("strength"))


def reminder_message(names: Column) -> Column:
    """Names the first five, the last of them after an and; one and many are told apart."""
    shown, n = F.slice(names, 1, 5), F.size(names)
    listed = F.when(F.size(shown) > 1, F.concat(F.array_join(F.slice(shown, F.lit(1), F.size(shown) - 1), ", "), F.lit(" and "), F.element_at(shown, -1))).otherwise(shown[0])
    return F.concat(F.lit("You haven't discussed "), listed, F.lit(" recently. "), n.cast("string"), F.when(n == 1, " key memory is").otherwise(" key memories are"), F.lit(" fading. Should I keep them active?"))


def reminders(buckets: DataFrame, sent: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """A reminder for each tenant with critical memories that had none in the last hours.

    ``sent`` has user_id and created_at."""
    due = critical(buckets, as_of).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "bucket_id", "canonical"))), lambda x: x["bucket_id"]).alias("memories"), reminder_message(F.transform(F.array_sort(F.collect_list(F.struct("n", "bucket_id", "canonical"))), lambda x: x["canonical"])).alias("message"))
    recent = sent.filter(F.col("created_at") > F.lit(as_of) - F.expr(f"INTERVAL {hours} HOURS")).select("user_id")
    return due.join(recent, "user_id", "left_anti")


def contradictions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Pairs of one name, without regard to case, whose definitions contradict; both sides have user_id, bucket_id, canonical and definition.

    A tenant's definitions of one name are made distinct first, so a name with many equal definitions gives one pair."""
    side = lambda df, name: df.groupBy("user_id", F.lower("canonical").alias("name"), F.col("definition").alias(f"{name}_definition")).agg(F.min("bucket_id").alias(f"{name}_id"))
    pairs = side(existing, "existing").join(side(incoming, "incoming"), ["user_id", "name"])
    text = F.concat(F.lit('Existing: "'), F.substring("existing_definition", 1, 100), F.lit('" / new: "'), F.substring("incoming_definition", 1, 100), F.lit('"'))
    return pairs.filter(contradicts(F.col("existing_definition"), F.col("incoming_definition"))).select("user_id", "name", "existing_id", "incoming_id", text.alias("description"))


def expired_sandboxes(users: DataFrame, as_of: datetime, inclusive: bool = False) -> DataFrame:
    late = F.col("expires_at") <= F.lit(as_of) if inclusive else F.col("expires_at") < F.lit(as_of)
    return users.filter(F.col("sandbox") & late)


def purged(users: DataFrame, gone: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """The tables without what belongs to the tenants in ``gone``: rows with their user_id, and edges, evidence and vectors of their memories."""
    ids = gone.select("user_id").distinct()
    out = {"users": users.join(ids, "user_id", "left_anti")}
    kept = tables["buckets"].join(ids, "user_id", "left_anti")
    for name, df in tables.items():
        if name == "edges":
            held = kept.select("bucket_id")
            df = df.join(held.withColumnRenamed("bucket_id", "source_bucket_id"), "source_bucket_id", "left_semi").join(held.withColumnRenamed("bucket_id", "target_bucket_id"), "target_bucket_id", "left_semi")
        elif "user_id" in df.columns:
            df = df.join(ids, "user_id", "left_anti")
        else:
            df = df.join(kept.select("bucket_id"), "bucket_id", "left_semi")
        out[name] = df
    return out


def claim_job(jobs: DataFrame, as_of: datetime) -> DataFrame:
    """The oldest queued job as it is once claimed."""
    first = jobs.filter("status = 'queued'").orderBy("started_at", "job_id").limit(1)
    return first.withColumns({"status": F.lit("processing"), "stage": F.lit("picked"), "progress": F.lit(0), "claimed_at": F.lit(as_of)})


#: Progress of a job at each stage.
PROGRESS = {"queued": 0, "picked": 0, "parsing": 10, "extracting": 40, "complete": 100, "failed": 100}


def latest_state(changes: DataFrame) -> DataFrame:
    """Of rows job_id, at, stage: the newest stage of each job and its progress."""
    newest = changes.groupBy("job_id").agg(F.max_by("stage", "at").alias("stage"), F.max("at").alias("at"))
    progress = F.create_map(*(F.lit(x) for pair in PROGRESS.items() for x in pair))
    status = F.when(F.col("stage").isin("queued", "complete", "failed"), F.col("stage")).otherwise("processing")
    return newest.select("job_id", "stage", status.alias("status"), progress[F.col("stage")].alias("progress"), "at")


def active_reminders(reminders_: DataFrame, user_id: int, every: bool = False) -> DataFrame:
    """A tenant's reminders, newest first; only active ones unless every one is asked for."""
    own = reminders_.filter(F.col("user_id") == user_id)
    return (own if every else own.filter("active")).orderBy(F.desc("created_at"), F.desc("reminder_id"))


def open_contradictions(found: DataFrame, user_id: int) -> DataFrame:
    return found.filter((F.col("user_id") == user_id) & ~F.coalesce(F.col("resolved"), F.lit(False)))


PAYLOAD = "connections struct<exactMerges:double,semanticConnections:double,crossDocumentConnections:double,strongConnections:double,connectionScore:double>, warnings array<string>"


def job_payload(result: Column) -> Column:
    """A job's result (JSON text) with counts of 0 or more, a score in [0, 1] and no null warnings."""
    from ..functions.numbers import non_negative, unit

    c = F.from_json(result, PAYLOAD)
    counts = [non_negative(c["connections"][name]).alias(name) for name in ("exactMerges", "semanticConnections", "crossDocumentConnections", "strongConnections")]
    return F.struct(*counts, unit(c["connections"]["connectionScore"]).alias("connectionScore"), F.filter(F.coalesce(c["warnings"], F.array().cast("array<string>")), lambda w: w.isNotNull()).alias("warnings"))
