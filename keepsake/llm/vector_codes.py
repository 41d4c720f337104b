"""Vector code compression: a codebook of few entries for each part of the vectors, all arithmetic in integers.

Components become floor(4096 x); a vector is cut into equal consecutive parts and each part is named by its nearest
entry. Entries are refined by rounds of assigning and averaging. The search for the nearest entry is Exponion's: start at
the entry of the round before, whose squared distance is u; by the triangle inequality an entry farther than twice the
root of u from it can't be nearer, so only entries of its list by rising distance are tried, up to 4 u between squares.
Distances are whole numbers; equal ones go to the lower index.

A round is one pass over the table of vectors: tasks assign, and end with one row of their sums by part, entry and
component, which Spark adds up. Only codebooks (parts x entries x components) reach the driver.

Defined results: vectors that are null or hold null or non-finite components (also after scaling) take no part; shorter
vectors than the longest, and lengths that the number of parts doesn't divide, are filled up with zeros; of equal vec_ids
(null last) the smaller vector comes first; with fewer vectors than entries there are as many entries as vectors; numbers
over 2^27 are computed without limit of size, and an error beyond 63 bits is given as 2^63 - 1; repeated rows give
repeated rows; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discarded, give_back, read, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Below this size, squares and their sums over a part fit 64 bits.
SMALL = 2**27
#: Sums travel as two whole numbers, so that no component of a 32-bit float is too large for them.
LIMB = 2**64
MOST = 2**63 - 1
#: A label that has one in so many rows or more is hot: there are no more of them than this.
HOT_LABELS = 1024
STATE = "vec_id long, label long, v array<double>, code binary, error decimal(38,0), sums array<struct<key:int,count:bigint,high:decimal(38,0),low:decimal(38,0)>>"


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, label and v of the vectors that take part."""
    scaled = F.transform(F.col("embedding"), lambda x: F.lit(float(SCALE)) * x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    floors = F.transform("v", lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x))
    return vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), scaled.alias("v")).filter(F.col("v").isNotNull() & finite).select("vec_id", "label", floors.alias("v"))


def whole(values: np.ndarray) -> np.ndarray:
    """The same whole numbers as Python integers."""
    return np.array([int(x) for x in values.ravel()], dtype=object).reshape(values.shape)


def squared(points: np.ndarray, entry: np.ndarray) -> np.ndarray:
    moved = points - entry
    return np.einsum("ij,ij->i", moved, moved) if moved.dtype != object else (moved * moved).sum(axis=1)


def nearest(points: np.ndarray, book: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the entry nearest to each point, ties to the lower index; ``before`` is where each search starts."""
    index, best = before.copy(), np.zeros(len(points), dtype=points.dtype)
    for a in np.unique(before):
        rows = np.flatnonzero(before == a)
        start = squared(points[rows], book[a])
        order = np.argsort(-start, kind="stable")
        rows, start = rows[order], start[order]
        apart = squared(book, book[a])
        near, at = start.copy(), np.full(len(rows), a)
        for j in np.argsort(apart, kind="stable"):
            if j == a:
                continue
            # rows are in falling order of their distance, so those whose radius reaches the entry come first
            reach = int(np.searchsorted(-4 * start, -apart[j], side="right"))
            if not reach:
                break
            d = squared(points[rows[:reach]], book[j])
            better = (d < near[:reach]) | ((d == near[:reach]) & (j < at[:reach]))
            near[:reach][better], at[:reach][better] = d[better], j
        index[rows], best[rows] = at, near
    return index, best


def coded(v: np.ndarray, books: list[list[list[int]]], before: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and summed squared distances of the vectors: in 64-bit integers where all is small, else in Python's."""
    largest = max((abs(x) for book in books for entry in book for x in entry), default=0)
    small = (np.abs(v).max(axis=1, initial=0) < SMALL) & (largest < SMALL)
    codes, errors = np.zeros((len(v), parts), dtype=np.uint8), np.zeros(len(v), dtype=object)
    for rows, kind in ((np.flatnonzero(small), np.int64), (np.flatnonzero(~small), object)):
        if not len(rows):
            continue
        points = v[rows].astype(np.int64) if kind is np.int64 else whole(v[rows])
        width = points.shape[1] // parts
        for p in range(parts):
            index, best = nearest(points[:, p * width : (p + 1) * width], np.array(books[p], dtype=kind).reshape(len(books[p]), width), before[rows, p].astype(np.int64))
            codes[rows, p] = index
            errors[rows] += best.astype(object)
    return codes, errors


def added(total: dict[int, list[int]], v: np.ndarray, codes: np.ndarray, entries: int) -> None:
    """Adds the batch to the sums: key (part, entry, component) to count and sum."""
    parts = codes.shape[1]
    width = v.shape[1] // parts
    exact = v.astype(np.int64) if np.abs(v).max(initial=0) < SMALL else whole(v)
    for p in range(parts):
        for e in np.unique(codes[:, p]):
            rows = codes[:, p] == e
            sums = exact[rows, p * width : (p + 1) * width].sum(axis=0)
            for i, x in enumerate(sums.tolist()):
                one = total.setdefault((p * entries + int(e)) * width + i, [0, 0])
                one[0] += int(rows.sum())
                one[1] += x


def assigned(state: DataFrame, books: list[list[list[int]]], dims: int, parts: int, entries: int) -> DataFrame:
    """The state after one pass: rows with new codes and errors, and a row of sums for each task."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("v", pa.list_(pa.float64())), ("code", pa.binary()), ("error", pa.decimal128(38, 0)), ("sums", pa.list_(pa.struct([("key", pa.int32()), ("count", pa.int64()), ("high", pa.decimal128(38, 0)), ("low", pa.decimal128(38, 0))])))])
        total: dict[int, list[int]] = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            lists = batch.column("v")
            v = np.zeros((n, dims))
            lengths = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            v[np.repeat(np.arange(n), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
            given = batch.column("code").to_pylist()
            before = np.zeros((n, parts), dtype=np.uint8) if given[0] is None else np.frombuffer(b"".join(given), dtype=np.uint8).reshape(n, parts)
            codes, errors = coded(v, books, before, parts)
            added(total, v, codes, entries)
            error = pa.array([Decimal(min(x, MOST)) for x in errors], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), lists, pa.array([c.tobytes() for c in codes], pa.binary()), error, pa.nulls(n, schema.field("sums").type)], schema=schema)
        sums = [{"key": k, "count": n, "high": Decimal(x // LIMB), "low": Decimal(x % LIMB)} for k, (n, x) in total.items()]
        if sums:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(schema)[:5]), pa.array([sums], schema.field("sums").type)], schema=schema)
        give_back()

    return state.filter(F.col("v").isNotNull()).select("vec_id", "label", "v", "code").mapInArrow(run, STATE)


def averaged(state: DataFrame, books: list[list[list[int]]], width: int, entries: int) -> list[list[list[int]]]:
    """Entries replaced by the floors of their parts' means; those nobody took stay."""
    out = [[list(entry) for entry in book] for book in books]
    sums = state.filter(F.col("sums").isNotNull()).select(F.explode("sums").alias("s")).groupBy("s.key").agg(F.sum("s.count").alias("count"), F.sum("s.high").alias("high"), F.sum("s.low").alias("low"))
    for key, count, high, low in sums.collect():  # as many rows as the codebooks have numbers
        at, i = divmod(key, width)
        out[at // entries][at % entries][i] = (int(high) * LIMB + int(low)) // int(count)
    return out


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[list[list[int]]]]:
    """vec_id, label, code (bytes) and error of each vector that takes part, and the codebooks: entry lists by part."""
    kept = written(integers(vectors), "vectors")
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    dims = -(-longest // parts) * parts
    width = dims // parts
    first = [[int(x) for x in r["v"]] + [0] * (dims - len(r["v"])) for r in kept.orderBy(F.col("vec_id").isNull(), "vec_id", "v").limit(entries).collect()]
    books = [[v[p * width : (p + 1) * width] for v in first] for p in range(parts)]
    state = kept.withColumn("code", F.lit(None).cast("binary"))
    for r in range(rounds + 1):
        following = written(assigned(state, books, dims, parts, entries), "codes")
        discarded(kept)
        state = kept = following
        if r < rounds and width:
            books = averaged(state, books, width, entries)
    return state.filter(F.col("code").isNotNull()).select("vec_id", "label", "code", F.col("error").cast("long")), books


def with_label_errors(rows: DataFrame) -> DataFrame:
    """``rows`` with label_error, the sum of ``error`` over equal labels, nulls together; hot labels' rows stay where they are."""
    labels = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"))
    sums = written(labels.select("label", "n", F.least("sum", F.lit(MOST)).cast("long").alias("label_error")), "label-errors")
    hot = sums.filter(F.col("n") * HOT_LABELS >= rows.count())
    by = lambda part, name: part.select(F.col("label").alias("__label"), F.col("label_error").alias(name))
    same = F.col("label").eqNullSafe(F.col("__label"))
    marked = rows.join(F.broadcast(by(hot, "__hot")), same, "left").drop("__label")
    rest = marked.filter(F.col("__hot").isNull()).join(by(sums, "label_error"), same).drop("__label", "__hot")
    return marked.filter(F.col("__hot").isNotNull()).withColumnRenamed("__hot", "label_error").unionByName(rest)


def digest(books: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def decoded(code: Column, books: list[list[list[int]]]) -> Column:
    """The vector that a code stands for: its entries one after another, over the scale."""
    tables = F.array(*(F.array(*(F.array(*(F.lit(x / SCALE) for x in entry)).cast("array<double>") for entry in book)) for book in books))
    index = lambda p: F.conv(F.hex(F.substring(code, p + 1, 1)), 16, 10).cast("int")
    return F.concat(*(F.get(F.get(tables, F.lit(p)), index(p)) for p in range(len(books))))


def op12_vector_codes(spark, sf_dir):
    rows, books = compressed(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return with_label_errors(rows).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def sql() -> str:
    """The same for DuckDB, by comparing all entries; vectors of one length that the number of parts divides."""
    whole_floor = "(s - ((s % n) + n) % n) // n"
    distance = "list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        f"""
kept AS (SELECT *, row_number() OVER () AS place FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
part AS MATERIALIZED (SELECT place, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS v FROM kept, (SELECT unnest(range({PARTS})) AS part)),
book0 AS MATERIALIZED (SELECT part, entry, v FROM part JOIN (SELECT place, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS entry FROM kept) USING (place) WHERE entry < {ENTRIES})"""
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"near{r} AS MATERIALIZED (SELECT place, part, min_by(entry, d * {ENTRIES} + entry) AS entry, min(d) AS d FROM (SELECT p.place, p.part, b.entry, {distance} AS d FROM part p JOIN book{r} b ON p.part = b.part) GROUP BY ALL)")
        if r < ROUNDS:
            steps.append(
                f"""sum{r} AS (SELECT part, entry, i, sum(x) AS s, count(*) AS n FROM (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS i FROM part JOIN near{r} USING (place, part)) GROUP BY ALL),
mean{r} AS (SELECT part, entry, list(CAST({whole_floor} AS BIGINT) ORDER BY i) AS v FROM sum{r} GROUP BY ALL),
book{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN mean{r} m USING (part, entry))"""
            )
    steps.append(
        f"""coded AS (SELECT place, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY ALL),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{ROUNDS})"""
    )
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (place), digest"
