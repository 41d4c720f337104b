"""A cache of embeddings as keyed state: a text that was embedded lately isn't embedded again.

An entry lives so long from when it was made, whether it is used or not; when a shard's entries are full, the oldest gives
way. Texts are dealt to shards by their hash, each with a cache of its own, as processes of a service have; with one shard
the cache is that of a single process. Within a micro-batch lookups count in the order of their time and id."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .jobs import micros

LOOKUPS = "lookup_id long, text string, at timestamp"
FOUND = "lookup_id long, text string, at timestamp, hit boolean, evicted string, embedding array<double>"
TTL_SECONDS, ENTRIES = 30 * 60, 500

Model = Callable[[list[str]], list[list[float]]]


def stub_model(texts: list[str], dimensions: int = 8) -> list[list[float]]:
    """A deterministic stand-in for an embedding model."""
    return [[b / 127.5 - 1 for b in hashlib.sha256(t.encode()).digest()[:dimensions]] for t in texts]


def looked_up(entries: dict[str, int], rows: list[tuple[int, str, int]], ttl: int, most: int) -> Iterator[tuple[int, str, int, bool, str | None]]:
    """lookup_id, text, at, hit and the text that gave way, for rows (lookup_id, text, at) in order. ``entries``: when each text was put in, the oldest first; it is changed."""
    for number, text, at in rows:
        made, evicted = entries.get(text), None
        hit = made is not None and at - made < ttl
        if not hit:
            entries.pop(text, None)
            if len(entries) >= most:
                evicted = next(iter(entries))
                del entries[evicted]
            entries[text] = at
        yield number, text, at, hit, evicted


def in_order(rows) -> list[tuple[int, str, int]]:
    return sorted(rows, key=lambda r: (r[2], r[0]))


class EmbeddingCache(StatefulProcessor):
    """State of a shard: the entries in order, and their vectors by text. Texts that a micro-batch misses are embedded in one call."""

    def __init__(self, model: Model, ttl: int, most: int):
        self.model, self.ttl, self.most = model, ttl, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getValueState("entries", "entries array<struct<text:string,made:long>>")
        self.vectors = handle.getMapState("vectors", "text string", "embedding array<double>")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        rows = list(rows)
        given = {r["lookup_id"]: r["at"] for r in rows}
        order = in_order((r["lookup_id"], r["text"], micros(r["at"])) for r in rows)
        entries = {e[0]: e[1] for e in self.entries.get()[0]} if self.entries.exists() else {}
        before = set(entries)
        found = list(looked_up(entries, order, self.ttl, self.most))
        missed = list(dict.fromkeys(text for _, text, _, hit, _ in found if not hit))
        fresh = dict(zip(missed, self.model(missed), strict=True)) if missed else {}
        vectors = {text: fresh[text] if text in fresh else list(self.vectors.getValue((text,))[0]) for _, text, _, _, _ in found}
        for text in before - set(entries):
            self.vectors.removeKey((text,))
        for text in fresh.keys() & entries.keys():
            self.vectors.updateValue((text,), (fresh[text],))
        self.entries.update(([(t, made) for t, made in entries.items()],))
        for number, text, _, hit, evicted in found:
            yield Row(lookup_id=number, text=text, at=given[number], hit=hit, evicted=evicted, embedding=[float(x) for x in vectors[text]])

    def close(self) -> None:
        pass


def sharded(lookups: DataFrame, shards: int) -> DataFrame:
    return lookups.filter("text IS NOT NULL AND at IS NOT NULL").select(F.pmod(F.xxhash64("text"), F.lit(shards)).alias("shard"), "lookup_id", "text", "at")


def embedded(lookups: DataFrame, model: Model = stub_model, shards: int = 16, ttl_seconds: int = TTL_SECONDS, most: int = ENTRIES) -> DataFrame:
    """Of a stream of LOOKUPS (lookup_id unique): FOUND. The session's state store must be ``jobs.PROVIDER``."""
    return sharded(lookups, shards).groupBy("shard").transformWithState(EmbeddingCache(model, ttl_seconds * 1_000_000, most), FOUND, "Append", "None")


def replayed(lookups: DataFrame, model: Model = stub_model, shards: int = 16, ttl_seconds: int = TTL_SECONDS, most: int = ENTRIES) -> DataFrame:
    """The same over a table. A shard's lookups are one sequence, read in order and in batches; shards are what spreads."""
    rows = sharded(lookups, shards).withColumn("at", F.unix_micros(F.col("at"))).repartition("shard").sortWithinPartitions("shard", "at", "lookup_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, entries, vectors = None, {}, {}
        for batch in batches:
            out = []
            for s, part in batch.groupby("shard", sort=False):
                if s != shard:
                    shard, entries, vectors = s, {}, {}
                found = list(looked_up(entries, list(zip(part["lookup_id"], part["text"], part["at"], strict=True)), ttl_seconds * 1_000_000, most))
                missed = list(dict.fromkeys(text for _, text, _, hit, _ in found if not hit))
                vectors |= dict(zip(missed, model(missed), strict=True)) if missed else {}
                out += [(*f, vectors[f[1]]) for f in found]
                vectors = {text: vectors[text] for text in entries}
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")])

    return rows.mapInPandas(run, FOUND.replace("at timestamp", "at long")).withColumn("at", F.timestamp_micros("at"))
