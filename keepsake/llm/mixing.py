"""Mixing sources to target weights by Sainte-Lague apportionment.

Every source's documents are dealt into shards by a seeded hash of id and text; of more than ``docs_per_shard`` equal
rows, each so many are dealt by themselves. A shard lays its documents end to end in seeded order
and cuts the row of words into blocks of equal length. Sainte-Lague (highest quotients v / (2 s + 1)) first gives each
source a whole number of blocks, then divides a source's blocks among groups of shards and a group's among its shards by their words. A shard takes all its
blocks as often as its quota allows and picks the rest by a seeded hash, so that no block, and thus no document, is
taken more than ``most`` times.

Sources stay a table: they are ranked by sorted parts, and targets are a share of weight found by rounds of sums. A task
apportions at most ``shards_per_group`` shards, or a source's groups of them, one for each four million documents. Ids and
texts are only passed on; what a shard's rows take is joined to the texts by a number that rows get when they are written.

Defined results: null or blank texts have size 0 and are taken 0 times; a null source is a source of its own and sorts
last; a null id is passed on; repeated rows are rows of their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import DOCUMENT_COLUMNS, WORD, in_slices, numbered, text_of, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEATS = 2
BLOCK_WORDS = 16
DOCS_PER_SHARD = 1024
SHARDS_PER_GROUP = 4096
SEED = 42


def size_of(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text_of(column), F.lit(WORD)), F.lit(0)).cast("long")


def sainte_lague(votes, seats: int, caps) -> np.ndarray:
    """Seats by highest quotients v / (2 s + 1), at most caps[i] for i; ties to the smaller index."""
    votes, caps = np.asarray(votes, dtype=float), np.asarray(caps, dtype=np.int64)
    caps = np.where(votes > 0, caps, 0)
    seats = int(min(seats, caps.sum()))
    if seats <= 0 or seats == caps.sum():
        return caps if seats > 0 else np.zeros(len(votes), dtype=np.int64)

    def won(divisor: float) -> np.ndarray:
        return np.minimum(caps, np.floor(votes / divisor + 0.5)).astype(np.int64)

    low, high = 0.0, 2 * votes.max() + 1  # won(high) is nothing
    for _ in range(200):  # the smallest divisor that gives out no more than the seats
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (low, middle) if won(middle).sum() <= seats else (middle, high)
    taken = won(high)
    heap = [(-votes[i] / (2 * taken[i] + 1), i) for i in range(len(votes)) if taken[i] < caps[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(taken.sum())):
        _, i = heapq.heappop(heap)
        taken[i] += 1
        if taken[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * taken[i] + 1), i))
    return taken


def targeted(sources: DataFrame, share: float = SHARE, most: int = MAX_REPEATS) -> DataFrame:
    """``sources`` (weight, size) with __target: a share of the words by weight; one above ``most`` times its source's size stops there and the excess is shared again, until none is."""
    total = F.col("weight") * F.lit(0.0)
    words, capped_before = None, -1
    level = 0.0
    while True:
        capped = total > most * F.col("size")
        found = sources.agg(F.sum("size").alias("size"), F.sum(F.when(capped, most * F.col("size"))).alias("given"), F.sum(F.when(~capped, F.col("weight"))).alias("open"), F.count(F.when(capped, 1)).alias("capped")).first()
        words = share * (found["size"] or 0)
        if found["capped"] == capped_before or not found["open"]:
            break
        capped_before, level = found["capped"], (words - (found["given"] or 0)) / found["open"]
        total = F.col("weight") * F.lit(level)
    return sources.withColumn("__target", F.least(total, most * F.col("size").cast("double")))


def mixed_hash(values: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over integers."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def chosen_words(sizes: np.ndarray, quota: int, blocks: int, seed: int):
    """Of documents laid end to end: full copies of all, words taken once more of each, the further ranges as (start, end) in the row of words."""
    ends = np.cumsum(sizes)
    words = int(ends[-1]) if len(ends) else 0
    if not words or not blocks:
        return 0, np.zeros(len(sizes), dtype=np.int64), np.zeros((0, 2), dtype=np.int64), ends
    copies, extra = divmod(int(quota), blocks)
    bounds = (np.arange(blocks + 1, dtype=object) * words // blocks).astype(np.int64) if words > 2**40 else np.arange(blocks + 1, dtype=np.int64) * words // blocks
    picked = np.zeros(blocks, dtype=bool)
    picked[np.argsort(mixed_hash(np.arange(blocks), seed), kind="stable")[:extra]] = True
    before = np.concatenate([[0], np.cumsum(np.where(picked, np.diff(bounds), 0))])

    def up_to(x: np.ndarray) -> np.ndarray:
        block = np.minimum(np.searchsorted(bounds, x, "right") - 1, blocks - 1)
        return before[block] + np.where(picked[block], x - bounds[block], 0)

    edges = np.flatnonzero(np.diff(np.concatenate([[0], picked.astype(np.int8), [0]])))
    return copies, up_to(ends) - up_to(ends - sizes), bounds[edges].reshape(-1, 2), ends


def sources_of(rows: DataFrame, weights, share: float, most: int) -> DataFrame:
    """__key (the source), __source_size, __docs, __target and __nth, its rank by code point, null last."""
    found = rows.groupBy("source").agg(F.sum("__size").alias("size"), F.count(F.lit(1)).alias("docs")).orderBy(F.col("source").isNull(), "source")
    placed = written(found.withColumn("at", F.monotonically_increasing_id()), "sources")  # the part in the upper bits, the place in the lower 33
    placed = placed.select("source", "size", "docs", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"), F.lit(0).alias("all"))
    ranked = numbered(placed, ["all"], "part", "place", "nth").withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("nth") % len(weights) + 1).cast("int")))
    ranked = written(ranked.select("source", "size", "docs", "nth", "weight"), "ranked")
    return targeted(ranked, share, most).select(F.col("source").alias("__key"), F.col("size").alias("__source_size"), "__target", F.col("docs").alias("__docs"), F.col("nth").alias("__nth"))


def salted(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` with __salt: 0, but of more than ``most`` equal rows each so many have a number of their own."""
    same = ["source", "doc_id", "__text"]
    hot = written(rows.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(*(F.col(c).alias(f"hot_{c}") for c in same)), "hot")
    if hot.isEmpty():
        return rows.withColumn("__salt", F.lit(0).cast("long"))
    part = rows.select("__at", *same, F.shiftright("__at", 33).alias("part")).join(hot, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"hot_{c}")) for c in same)), "left_semi")
    place = F.row_number().over(Window.partitionBy(*same, "part").orderBy("__at")) - 1
    copies = numbered(part.withColumn("place", place), same, "part", "place", "copy").select(F.col("__at").alias("of"), F.floor(F.col("copy") / most).alias("salt"))
    return rows.join(copies, F.col("__at") == F.col("of"), "left").withColumn("__salt", F.coalesce("salt", F.lit(0).cast("long"))).drop("of", "salt")


def mixture(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MAX_REPEATS, block_words: int = BLOCK_WORDS, docs_per_shard: int = DOCS_PER_SHARD, shards_per_group: int = SHARDS_PER_GROUP, seed: int = SEED, rows: DataFrame | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies and ranges (word ranges taken beyond whole copies, in the document's own words), and __at, the row's number.

    rows: ``numbered_rows`` of the documents, if they are wanted elsewhere too."""
    rows = written(numbered_rows(docs), "mix") if rows is None else rows
    rows = salted(rows.select("doc_id", "source", "__size", "__text", "__at"), docs_per_shard)
    sources = sources_of(rows, weights, share, most)
    shard = F.pmod(F.xxhash64("doc_id", "__text", "__salt", F.lit(seed)), F.greatest(F.lit(1), F.ceil(F.col("__docs") / docs_per_shard))).cast("int")
    every = rows.join(sources, rows["source"].eqNullSafe(sources["__key"])).withColumn("__shard", shard).drop("__key", "__docs")

    shards = every.groupBy("__nth", "__shard", "__source_size", "__target").agg(F.sum("__size").alias("__words"))
    blocks = F.when(F.col("__words") > 0, F.greatest(F.lit(1.0), F.rint(F.col("__words") / block_words))).otherwise(0.0).cast("long")
    shards = shards.withColumn("__blocks", blocks).withColumn("__group", F.floor(F.col("__shard") / shards_per_group))
    groups = shards.groupBy("__nth", "__group", "__source_size", "__target").agg(F.sum("__words").alias("__words"), F.sum("__blocks").alias("__blocks"))

    def among_groups(of_source: pd.DataFrame) -> pd.DataFrame:
        of_source = of_source.sort_values("__group", ignore_index=True)
        blocks = int(of_source["__blocks"].sum())
        seats = round(of_source["__target"][0] / (of_source["__source_size"][0] / blocks)) if blocks else 0
        return pd.DataFrame({"__n": of_source["__nth"], "__g": of_source["__group"], "__seats": sainte_lague(of_source["__words"], seats, most * of_source["__blocks"])})

    def among_shards(of_group: pd.DataFrame) -> pd.DataFrame:
        of_group = of_group.sort_values("__shard", ignore_index=True)
        return pd.DataFrame({"__n": of_group["__nth"], "__s": of_group["__shard"], "__blocks": of_group["__blocks"], "__quota": sainte_lague(of_group["__words"], of_group["__seats"][0], most * of_group["__blocks"])})

    seats = groups.groupBy("__nth").applyInPandas(among_groups, "__n long, __g long, __seats long")
    seated = shards.join(seats, (F.col("__nth") == F.col("__n")) & (F.col("__group") == F.col("__g")))
    quotas = seated.groupBy("__nth", "__group").applyInPandas(among_shards, "__n long, __s int, __blocks long, __quota long")
    every = every.join(quotas, (F.col("__nth") == F.col("__n")) & (F.col("__shard") == F.col("__s"))).withColumn("__order", F.xxhash64("__text", "doc_id", "__salt", F.lit(seed + 1)))
    every = every.select("doc_id", "source", "__size", "__source_size", "__target", "__at", "__order", "__nth", "__shard", "__blocks", "__quota")
    given = ("doc_id", "source", "size", "source_size", "target")
    out = T.StructType([docs.schema["doc_id"], docs.schema["source"], *(T.StructField(n, t) for n, t in (("size", T.LongType()), ("source_size", T.LongType()), ("target", T.DoubleType()), ("taken", T.LongType()), ("copies", T.LongType()), ("ranges", T.ArrayType(T.ArrayType(T.LongType()))), ("__at", T.LongType())))])

    def take(of_shard: pa.Table) -> pa.Table:
        column = lambda name: of_shard[name].to_numpy()
        order = np.lexsort((column("__at"), column("__size"), column("__order")))
        of_shard = of_shard.take(order)
        sizes = column("__size")
        own = int(of_shard["__nth"][0].as_py()) * 1_000_003 + of_shard["__shard"][0].as_py()
        copies, extra, ranges, ends = chosen_words(sizes, of_shard["__quota"][0].as_py(), of_shard["__blocks"][0].as_py(), (seed + own) % 2**63)
        starts = ends - sizes
        first, last = np.searchsorted(ranges[:, 1], starts, "right"), np.searchsorted(ranges[:, 0], ends, "left")
        cut = [[[int(max(a, s) - s), int(min(b, e) - s)] for a, b in ranges[i:j] if max(a, s) < min(b, e)] for s, e, i, j in zip(starts.tolist(), ends.tolist(), first, last, strict=True)]
        arrays = [*of_shard.columns[:5], pa.array(copies * sizes + extra), pa.array(np.full(len(sizes), copies, dtype=np.int64)), pa.array(cut, pa.list_(pa.list_(pa.int64()))), of_shard["__at"]]
        return pa.table(arrays, names=[*given, "taken", "copies", "ranges", "__at"])

    return every.groupBy("__nth", "__shard").applyInArrow(take, out)


def numbered_rows(docs: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source and ``columns``, each document's size, a hash of its text and a number; to be written, as the number is not the same when it is computed again."""
    kept = ["doc_id", "source", *(c for c in columns if c not in ("doc_id", "source"))]
    return docs.select(*kept, size_of().alias("__size"), F.xxhash64(text_of()).alias("__text"), F.monotonically_increasing_id().alias("__at"))


def op9_mix_sources(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mixture(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixed_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's whole copies, then one document of the words of its further ranges, white space between words kept."""
    columns = [c for c in DOCUMENT_COLUMNS if c in docs.columns]
    docs = docs.select(*columns)
    rows = written(numbered_rows(docs, tuple(columns)), "mix")
    taken = mixture(docs, rows=rows).filter("copies > 0 OR size(ranges) > 0").select(F.col("__at").alias("of"), "copies", "ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index: list[int] = []
            texts: list[str | None] = []
            for i, (text, copies, ranges) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "copies", "ranges")), strict=True)):
                made = [text] * copies
                if ranges:
                    spans = [m.span() for m in re.finditer(WORD, text)]
                    made.append("\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in ranges))
                index += [i] * len(made)
                texts += made
            lengths = pa.array([len(t or "") for t in texts], pa.int64())
            own = {"text": lambda old: pa.array(texts, old.type), "n_chars": lambda old: lengths.cast(old.type)}
            yield pa.RecordBatch.from_arrays([own[c](batch.column(c)) if c in own else batch.column(c).take(pa.array(index, pa.int64())) for c in columns], names=columns)

    joined = rows.select(*columns, "__at").join(taken, F.col("__at") == F.col("of")).select(*columns, "copies", "ranges")
    return joined.mapInArrow(in_slices(cut), docs.schema)
