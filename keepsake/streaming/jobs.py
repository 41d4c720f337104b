"""The ingestion queue: jobs as state machines over their events, with leases that run out; as a stream and over a table.

A job is queued, then picked by a worker, parsed and extracted, and ends complete or failed. Each sign of its worker renews
the lease; a job whose lease runs out is queued again, and fails when it has been picked ``MOST_ATTEMPTS`` times. Signs of
a worker that doesn't hold the job, and claims of a job that isn't queued, change nothing, so events may come twice."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.lifecycle import PROGRESS
from ..operators.merge import replaced_by

JOB_SCHEMA = "job_id long, user_id long, status string, started_at timestamp"
EVENTS = "job_id long, kind string, worker string, at timestamp, message string"
TRANSITIONS = "job_id long, status string, stage string, progress int, attempt int, worker string, at timestamp, message string"
STATE = "stage string, attempt int, worker string, deadline long"
PENDING = "at long, kind string, worker string, message string"
LEASE_SECONDS, MOST_ATTEMPTS = 300, 3
#: The kinds of events, in the order in which those of one moment count.
KINDS = ("queued", "claim", "parsing", "extracting", "complete", "failed")
#: The state store that keyed processors need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

State = tuple  # stage, attempt, worker, deadline in microseconds
Event = tuple  # at in microseconds, kind, worker, message
NEW: State = (None, 0, None, None)


def running(state: State) -> bool:
    return state[0] in ("picked", "parsing", "extracting")


def moved(state: State, event: Event, lease: int) -> State | None:
    """The state after an event; None if the event changes nothing."""
    (stage, attempt, holder, _), (at, kind, worker, _) = state, event
    if kind == "queued":
        return ("queued", 0, None, None) if stage is None else None
    if kind == "claim":
        return ("picked", attempt + 1, worker, at + lease) if stage == "queued" else None
    if not running(state) or worker != holder or kind not in KINDS:
        return None
    return (kind, attempt, holder, None if kind in ("complete", "failed") else at + lease)


def expired(state: State, most: int) -> State:
    return ("failed" if state[1] >= most else "queued", state[1], None, None)


def settled(state: State, events: list[Event], until: int, lease: int, most: int) -> Iterator[tuple[State, int, str | None]]:
    """States with their moment and message, as events and leases up to ``until`` bring them about; events are in order."""
    for event in [*events, None]:
        while running(state) and state[3] < (event[0] if event else until + 1):
            at, state = state[3], expired(state, most)
            yield state, at, "the lease ran out"
        if event and (following := moved(state, event, lease)):
            state = following
            yield state, event[0], event[3]


def in_order(events) -> list[Event]:
    return sorted(set(events), key=lambda e: (e[0], KINDS.index(e[1]) if e[1] in KINDS else len(KINDS), e[2] or "", e[3] or ""))


def status_of(stage: str) -> str:
    return stage if stage in ("queued", "complete", "failed") else "processing"


def micros(at: datetime) -> int:
    """Of a time as Spark gives it to Python, without a zone."""
    moment = at.astimezone(timezone.utc) if at.tzinfo is None else at
    return round(moment.timestamp() * 1_000_000)


class JobMachine(StatefulProcessor):
    """Keeps a job's events until the watermark has passed them, so that they count in their order however they arrive; timers end leases."""

    def __init__(self, lease: int, most: int):
        self.lease, self.most = lease, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state, self.pending = handle.getValueState("state", STATE), handle.getListState("pending", PENDING)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        for r in rows:
            at = micros(r["at"])
            self.pending.appendValue((at, r["kind"], r["worker"], r["message"]))
            self.handle.registerTimer(-(-at // 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        until = timerValues.getCurrentWatermarkInMs() * 1000  # a timer that is set from here fires with a later batch
        waiting = [tuple(e) for e in self.pending.get()]
        state = tuple(self.state.get()) if self.state.exists() else NEW
        for state, at, message in settled(state, in_order(e for e in waiting if e[0] <= until), until, self.lease, self.most):
            yield Row(job_id=key[0], status=status_of(state[0]), stage=state[0], progress=PROGRESS[state[0]], attempt=state[1], worker=state[2], at=datetime.fromtimestamp(at / 1_000_000, tz=timezone.utc), message=message)
        later = [e for e in waiting if e[0] > until]
        if later:
            self.pending.put(later)
        else:
            self.pending.clear()
        if state[0]:
            self.state.update(state)
        if running(state):
            self.handle.registerTimer(-(-state[3] // 1000))

    def close(self) -> None:
        pass


def transitions(events: DataFrame, late: str = "1 minute", lease_seconds: int = LEASE_SECONDS, most: int = MOST_ATTEMPTS) -> DataFrame:
    """Of a stream of EVENTS: TRANSITIONS, once the watermark has passed them; events later than ``late`` are left out. The session's state store must be PROVIDER."""
    rows = events.select(*(c.split()[0] for c in EVENTS.split(", "))).withWatermark("at", late)
    return rows.groupBy("job_id").transformWithState(JobMachine(lease_seconds * 1_000_000, most), TRANSITIONS, "Append", "EventTime")


def whole_jobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of rows in order by job_id, cut anew where a job ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        jobs = batch.column(0)
        last = jobs[batch.num_rows - 1].as_py()
        same = jobs.is_null() if last is None else pc.fill_null(pc.equal(jobs, last), False)
        first = pc.index(same, True).as_py()
        if held and (first > 0 or held[-1].column(0)[held[-1].num_rows - 1].as_py() != last):
            yield pa.Table.from_batches([*held, batch.slice(0, first)])
            held = []
        elif first > 0:
            yield pa.Table.from_batches([batch.slice(0, first)])
        held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held)


def moves_of(rows: pa.Table, until: int, lease: int, most: int) -> pa.RecordBatch:
    """What ``settled`` gives for each of many jobs: their first events together, then their second ones, and so on.

    ``rows``: job_id, at, kind (a place in KINDS), worker, message, in order by job and as events count. A stage has the
    place of the kind that leads to it; the messages of leases that ran out stand behind those of the rows."""
    rows = rows.combine_chunks()
    n = rows.num_rows
    ids = rows["job_id"].combine_chunks()
    coded = [c.combine_chunks().dictionary_encode() for c in (rows["worker"], rows["message"])]
    worker, message = (pc.fill_null(c.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) for c in coded)
    at, kind = rows["at"].to_numpy(), rows["kind"].to_numpy()
    job, none = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
    new = np.concatenate([[True], (job[1:] != job[:-1]) | (none[1:] != none[:-1])])
    repeated = np.concatenate([[False], (at[1:] == at[:-1]) & (kind[1:] == kind[:-1]) & (worker[1:] == worker[:-1]) & (message[1:] == message[:-1])]) & ~new
    kept = np.flatnonzero(~repeated)
    start = np.flatnonzero(new[kept])
    size = np.diff(np.append(start, len(kept)))
    by = np.argsort(-size, kind="stable")
    start, size = start[by], size[by]
    stage, attempt, holder, deadline = np.full(len(start), -1), np.zeros(len(start), dtype=np.int64), np.full(len(start), -1), np.zeros(len(start), dtype=np.int64)
    queued, picked, complete, failed = 0, 1, KINDS.index("complete"), KINDS.index("failed")
    out: list[tuple[np.ndarray, ...]] = []

    def told(which: np.ndarray, when: np.ndarray, said: np.ndarray) -> None:
        out.append((kept[start[which]], stage[which], attempt[which], holder[which], when, said))

    def run_out(most_jobs: int, moment: np.ndarray | int) -> None:
        own = stage[:most_jobs]
        lost = np.flatnonzero((own >= picked) & (own < complete) & (deadline[:most_jobs] < moment))
        if len(lost):
            stage[lost], holder[lost] = np.where(attempt[lost] >= most, failed, queued), -1
            told(lost, deadline[lost], np.full(len(lost), n))

    for step in range(int(size[0])):
        m = int(np.searchsorted(-size, -step))  # jobs that have so many events
        row = kept[start[:m] + step]
        when, what, sender = at[row], kind[row], worker[row]
        run_out(m, when)
        own = stage[:m]
        enters, claims_it = (what == queued) & (own < queued), (what == picked) & (own == queued)
        signs = (what > picked) & (own >= picked) & (own < complete) & (sender == holder[:m])
        hit = np.flatnonzero(enters | claims_it | signs)
        if not len(hit):
            continue
        claimed = np.flatnonzero(claims_it)
        attempt[claimed] += 1
        holder[claimed] = sender[claimed]
        stage[hit], deadline[hit] = what[hit], when[hit] + lease
        told(hit, when[hit], row[hit])
    run_out(len(start), until + 1)
    first, stages, attempts, holders, when, said = (np.concatenate(c) for c in zip(*out, strict=True)) if out else [np.zeros(0, dtype=np.int64)] * 6
    by_code = lambda values, codes: values.take(pa.array(codes, mask=codes < 0))
    names = pa.array(["queued", "picked", *KINDS[2:]], pa.string())
    messages = pa.concat_arrays([rows["message"].combine_chunks().cast(pa.string()), pa.array(["the lease ran out"], pa.string())])
    return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), names.take(pa.array(stages)), pa.array(attempts, pa.int32()), by_code(coded[0].dictionary.cast(pa.string()), holders), pa.array(when), messages.take(pa.array(said))], names=["job_id", "stage", "attempt", "worker", "at", "message"])


def replayed(events: DataFrame, until: datetime, lease_seconds: int = LEASE_SECONDS, most: int = MOST_ATTEMPTS, parts: int | None = None) -> DataFrame:
    """The same over a table: TRANSITIONS up to a moment. A job's events meet in one task (of ``parts``, or as many as the session has); there are few of them, whatever the number of jobs."""
    end, lease = micros(until), lease_seconds * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (moves_of(rows, end, lease, most) for rows in whole_jobs(batches))

    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) - 1  # other kinds change nothing
    known = events.select("job_id", F.unix_micros("at").alias("at"), place.alias("kind"), "worker", "message").filter((F.col("at") <= end) & (F.col("kind") >= 0))
    order = ["job_id", "at", "kind", *(x for c in ("worker", "message") for x in (F.coalesce(c, F.lit("")), F.col(c).isNull()))]
    found = known.repartition(*([parts] if parts else []), "job_id").sortWithinPartitions(*order).mapInArrow(run, "job_id long, stage string, attempt int, worker string, at long, message string")
    stage = F.col("stage")
    status = F.when(stage.isin("queued", "complete", "failed"), stage).otherwise("processing")
    progress = F.create_map(*(F.lit(x) for pair in PROGRESS.items() for x in pair))[stage]
    return found.select("job_id", status.alias("status"), "stage", progress.alias("progress"), "attempt", "worker", F.timestamp_micros("at").alias("at"), "message")


def current(changes: DataFrame) -> DataFrame:
    """The last of TRANSITIONS of each job, and the number of its moves."""
    order = F.struct("at", "attempt", progress_of(F.col("stage")), "stage")
    last = F.max_by(F.struct("status", "stage", "progress", "attempt", "worker", "at"), order)
    return changes.groupBy("job_id").agg(last.alias("last"), F.count(F.lit(1)).alias("moves")).select("job_id", "last.*", "moves")


def progress_of(stage: Column) -> Column:
    """Where a stage stands among those of one moment: a lease that ran out comes before a new claim."""
    return F.array_position(F.array(*map(F.lit, ("queued", "picked", "parsing", "extracting", "complete", "failed"))), stage)


def claims(states: DataFrame, workers: list[str], as_of: datetime) -> DataFrame:
    """Claim events for the oldest queued jobs, one a worker, in the workers' order."""
    oldest = states.filter("status = 'queued'").orderBy("at", "job_id").limit(len(workers))
    place = F.row_number().over(Window.orderBy("at", "job_id"))  # no more rows than workers
    return oldest.select("job_id", F.lit("claim").alias("kind"), F.element_at(F.array(*map(F.lit, workers)), place).alias("worker"), F.lit(as_of).alias("at"), F.lit(None).cast("string").alias("message"))


def queue(spark: SparkSession, path: str, files_a_batch: int = 10) -> DataFrame:
    """Queued jobs as they arrive."""
    return spark.readStream.schema(JOB_SCHEMA).option("maxFilesPerTrigger", files_a_batch).parquet(path).filter("status = 'queued'")


def worked(jobs: DataFrame, work: Callable[[DataFrame], DataFrame], store, name: str = "job_states"):
    """For each micro-batch: does the work and records each job's last state, writing only the parts of the table that hold its jobs. A batch that is run again is recorded once.

    ``work`` gives job_id and succeeded."""

    def run(batch: DataFrame, epoch: int) -> None:
        done = work(batch).select("job_id", F.when(F.col("succeeded"), "complete").otherwise("failed").alias("stage"), F.lit(epoch).alias("epoch"))
        store.change(name, done, ["job_id"], lambda old, new: replaced_by(old, new, ["job_id"]))

    return jobs.writeStream.foreachBatch(run)
