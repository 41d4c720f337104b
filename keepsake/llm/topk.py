"""Exact top-k inner products over integer vectors, with block-at-a-time pruning.

Every vector goes to the nearest of at most ``CENTRES`` centres, which are fitted on a bounded sample (``SAMPLE`` rows);
rows of a centre lie in ranges of about ``RANGE``, and a range is cut into blocks of ``BLOCK`` like vectors. A centre and a
block know the least and the greatest value of every component, the mean and the largest distance from it. No score of
theirs exceeds the smaller of two bounds: the sum over components of the larger product of the query's value with the
extremes, and the product with the mean plus the query's length times that distance.

A query is first scored with the centre of its largest bound, whose k-th best score it then carries on: only centres
whose bound reaches it are visited, and in their ranges blocks go in falling order of their bounds, each scored through
its own matrix, until the next bound falls below the k-th best so far (at equality a block is skipped only if all its
ids are larger too). Queries and ranges of a centre meet in cells of bounded size; a cell returns at most k rows a query,
which a ranking over all cells of the query reduces to k. The search is exact: where vectors have no groups, bounds
discard little and nearly all blocks are scored.

Defined results: vectors that are null or hold null, NaN or infinite components take no part, nor do rows with a null
id; where lengths differ, missing components count as zero; ties go to the smaller id, repeated rows are candidates of
their own, of several rows of a query's id the smallest vector is the query; fewer than k candidates give as many rows
as there are; vectors so large that a score might not fit 64 bits raise an error; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_slices, written

K, SCALE, EVERY = 10, 1024, 100
BLOCK, RANGE, QUERY_CHUNK = 256, 8192, 8192
#: Rows that centres are fitted on, centres, rows a centre stands for at least, and rounds of fitting.
SAMPLE, CENTRES, ROWS_A_CENTRE, ROUNDS = 8192, 1024, 512, 8
SEED = 42


def integer_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component; an error where that does not fit 64 bits."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    whole = lambda x: F.when(F.abs(x * scale) < 2.0**62, F.floor(x * scale).cast("long")).otherwise(F.raise_error(F.lit("a component does not fit 64 bits")).cast("long"))
    vector = F.col("embedding").cast("array<double>")
    return embeddings.select(F.col("vec_id").cast("long"), vector.alias("x")).filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", finite)).select("vec_id", F.transform("x", whole).alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int, dtype) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width), dtype=dtype)
    out[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy()
    return out


class Extent:
    """Of groups of vectors, for bounds on their products with a query: extremes, means and the largest distances from them."""

    def __init__(self, low: np.ndarray, high: np.ndarray, mean: np.ndarray, radius: np.ndarray):
        self.low, self.high, self.mean, self.radius = low, high, mean, radius

    @classmethod
    def of_blocks(cls, vectors: np.ndarray, starts: np.ndarray) -> Extent:
        low, high = np.minimum.reduceat(vectors, starts, axis=0), np.maximum.reduceat(vectors, starts, axis=0)
        sizes = np.diff(np.append(starts, len(vectors)))
        mean = np.add.reduceat(vectors.astype(np.float64), starts, axis=0) / sizes[:, None]
        away = np.sqrt(((vectors - np.repeat(mean, sizes, axis=0)) ** 2).sum(axis=1))
        return cls(low.astype(np.float64), high.astype(np.float64), mean, np.maximum.reduceat(away, starts))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """queries x groups; a little more than exact, as the products are rounded."""
        q = queries.astype(np.float64)
        length = np.sqrt((q * q).sum(axis=1))[:, None]
        by_extremes = np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T
        by_distance = q @ self.mean.T + length * self.radius[None, :]
        found = np.minimum(by_extremes, by_distance)
        return found + 1e-9 * (np.abs(found) + length * (self.radius + np.sqrt((self.mean**2).sum(axis=1)))[None, :]) + 1e-6


def best_in_range(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, least: list[tuple[int, int] | None], block: int = BLOCK) -> tuple[list[tuple[int, int, int]], int, int]:
    """(query_id, vec_id, score) of at most the k best of the range for each query, without rows of the query's own id; then blocks scored and blocks there were.

    least: by query, score and id of the k-th best that is known from elsewhere; what is worse is left out."""
    order = np.argsort(vectors @ np.sign(vectors.sum(axis=0)), kind="stable")  # like vectors share a block
    vectors, ids = vectors[order], ids[order]
    starts = np.arange(0, len(ids), block)
    bounds, smallest = Extent.of_blocks(vectors, starts).bounds(queries), np.minimum.reduceat(ids, starts)
    out: list[tuple[int, int, int]] = []
    scored = 0
    for q, query, bound, known in zip(query_ids.tolist(), queries, bounds, least, strict=True):
        best_scores, best_ids = np.zeros(0, dtype=vectors.dtype), np.zeros(0, dtype=np.int64)
        kth = known
        for b in np.argsort(-bound, kind="stable").tolist():
            if kth is not None and bound[b] < kth[0]:
                break
            if kth is not None and bound[b] < kth[0] + 1 and smallest[b] > kth[1]:  # at best equal, and then later
                continue
            scored += 1
            part = slice(starts[b], starts[b] + block)
            scores, own = vectors[part] @ query, ids[part]
            keep = own != q
            if kth is not None:
                keep &= (scores > kth[0]) | ((scores == kth[0]) & (own <= kth[1]))
            if not keep.any():
                continue
            scores, own = np.concatenate([best_scores, scores[keep]]), np.concatenate([best_ids, own[keep]])
            first = np.lexsort((own, -scores))[:k]
            best_scores, best_ids = scores[first], own[first]
            if len(best_ids) == k:
                here = (int(best_scores[-1]), int(best_ids[-1]))
                kth = here if kth is None or (-here[0], here[1]) < (-kth[0], kth[1]) else kth
        out += [(q, i, int(s)) for i, s in zip(best_ids.tolist(), best_scores.tolist(), strict=True)]
    return out, scored, len(query_ids) * len(starts)


def fitted_centres(vectors: DataFrame, rows: int, width: int, sample: int = SAMPLE) -> np.ndarray:
    """Centres by Lloyd's rounds on the sample, the rows of the smallest hashes."""
    found = vectors.orderBy(F.xxhash64("vec_id", "v", F.lit(SEED))).limit(sample).select("v").toArrow()
    x = matrix(found["v"], width, np.float64)
    count = max(1, min(CENTRES, rows // ROWS_A_CENTRE, len(x) // 8))
    centres = x[np.unique(np.linspace(0, len(x) - 1, count).astype(int))]
    for _ in range(ROUNDS if len(centres) > 1 else 0):
        own = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        sizes = np.bincount(own, minlength=len(centres))
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, step: int = 1024) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + step] @ centres.T - half, axis=1) for i in range(0, max(1, len(x)), step)]) if len(x) else np.zeros(0, dtype=np.int64)


def indexed(vectors: DataFrame, centres: np.ndarray, width: int) -> DataFrame:
    """vec_id, v, centre and a number of the row."""

    def assign(batches):
        for batch in batches:
            own = nearest(matrix(batch.column(1), width, np.float64), centres)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], names=["vec_id", "v", "row", "centre"])

    return vectors.select("vec_id", "v", F.monotonically_increasing_id().alias("row")).mapInArrow(in_slices(assign, 4096), "vec_id long, v array<long>, row long, centre int")


def extents(index: DataFrame, centres: np.ndarray, width: int) -> tuple[Extent, np.ndarray]:
    """Of each centre's rows, and how many there are: a row a centre from each task, merged by centre."""
    schema = "centre int, low array<double>, high array<double>, radius double, n long"

    def parts(batches):
        found: dict[int, list] = {}
        for batch in batches:
            x, own = matrix(batch.column(0), width, np.float64), batch.column(1).to_numpy()
            away = np.sqrt(((x - centres[own]) ** 2).sum(axis=1))
            for c in np.unique(own).tolist():
                here = own == c
                new = [x[here].min(axis=0), x[here].max(axis=0), away[here].max(), int(here.sum())]
                old = found.get(c, new)
                found[c] = [np.minimum(old[0], new[0]), np.maximum(old[1], new[1]), max(old[2], new[2]), new[3] + (old[3] if c in found else 0)]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([f[0].tolist() for f in found.values()], pa.list_(pa.float64())), pa.array([f[1].tolist() for f in found.values()], pa.list_(pa.float64())), pa.array([f[2] for f in found.values()], pa.float64()), pa.array([f[3] for f in found.values()], pa.int64())], names=["centre", "low", "high", "radius", "n"])

    def merged(rows: pa.Table) -> pa.Table:
        low, high = np.array(rows["low"].to_pylist()).min(axis=0), np.array(rows["high"].to_pylist()).max(axis=0)
        return pa.table({"centre": rows["centre"].slice(0, 1), "low": [low.tolist()], "high": [high.tolist()], "radius": [max(rows["radius"].to_pylist())], "n": [sum(rows["n"].to_pylist())]}).cast(rows.schema)

    found = index.select("v", "centre").mapInArrow(in_slices(parts, 4096), schema).groupBy("centre").applyInArrow(merged, schema).collect()
    low, high, radius, n = np.zeros_like(centres), np.zeros_like(centres), np.zeros(len(centres)), np.zeros(len(centres), dtype=np.int64)
    for r in found:
        low[r["centre"]], high[r["centre"]], radius[r["centre"]], n[r["centre"]] = r["low"], r["high"], r["radius"], r["n"]
    return Extent(low, high, centres, radius), n


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score over ``vectors`` (vec_id, v); queries are its rows for which ``is_query`` holds."""
    vectors = written(vectors.select("vec_id", "v"), "vectors")
    size = lambda x: F.aggregate("v", F.lit(0.0), lambda a, b: x(a, F.abs(b.cast("double"))))
    facts = vectors.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("v")).alias("width"), F.max(size(lambda a, b: a + b)).alias("sum"), F.max(size(F.greatest)).alias("largest")).first()
    rows, width, most = facts["rows"], facts["width"] or 0, (facts["sum"] or 0.0) * (facts["largest"] or 0.0)
    if not rows:
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    if most >= 2.0**63:
        raise OverflowError("scores of vectors so large may not fit 64 bits")
    dtype = np.float64 if most < 2.0**52 else np.int64  # sums of doubles below 2**53 are exact
    centres = fitted_centres(vectors, rows, width)
    index = written(indexed(vectors, centres, width), "index")
    extent, sizes = extents(index, centres, width)
    queries = written(index.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v"), "queries")
    parts_of = np.maximum(1, -(-sizes // RANGE))

    def routed(known: bool):
        """The centre of the largest bound, or the others that the k-th best known score leaves."""

        def run(batches):
            for batch in batches:
                bound = extent.bounds(matrix(batch.column(1), width, np.float64))
                bound[:, sizes == 0] = -np.inf
                first = bound.argmax(axis=1)
                if known:
                    score = batch.column("kth_score").to_numpy(zero_copy_only=False)
                    ask = (bound >= np.where(np.isnan(score), -np.inf, score)[:, None]) & (bound > -np.inf)
                    ask[np.arange(len(first)), first] = False
                    query, centre = np.nonzero(ask)
                else:
                    query, centre = np.arange(len(first)), first
                taken = batch.take(pa.array(query))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(centre, pa.int32()), pa.array(parts_of[centre], pa.int32())], names=[*batch.schema.names, "centre", "parts"])

        return in_slices(run, 512)

    def score(asking: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if asking.num_rows and held.num_rows:
            least = [None if s is None else (int(s), i) for s, i in zip(asking["kth_score"].to_pylist(), asking["kth_id"].to_pylist(), strict=True)]
            out, _, _ = best_in_range(matrix(asking["v"], width, dtype), asking["vec_id"].to_numpy(), matrix(held["v"], width, dtype), held["vec_id"].to_numpy(), k, least)
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    def cells(asked: DataFrame, label: str) -> DataFrame:
        """k rows at most for each query and range; asked: queries and the centres they visit. Ranges are copied to a centre's chunks of queries, queries to its ranges."""
        asked = written(asked, label)
        chunks = asked.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / QUERY_CHUNK).cast("int").alias("chunks"))  # a row a centre
        chunk = F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int")
        asking = asked.join(chunks, "centre").select("vec_id", "v", "kth_score", "kth_id", "centre", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        parts = F.element_at(F.array(*map(F.lit, parts_of.tolist())), F.col("centre") + 1)
        held = index.join(chunks, "centre").select("vec_id", "v", "centre", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(F.xxhash64("row"), parts).cast("int").alias("part"))
        keys = ["centre", "chunk", "part"]
        return asking.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(score, "query_id long, vec_id long, score long")

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    route = "vec_id long, v array<long>, kth_score double, kth_id long, centre int, parts int"
    blank = queries.select("vec_id", "v", F.lit(None).cast("double").alias("kth_score"), F.lit(None).cast("long").alias("kth_id"))
    first = written(cells(blank.mapInArrow(routed(False), route), "first").withColumn("rank", rank).filter(F.col("rank") <= k), "best")
    kth = first.filter(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("kth_score"), F.col("vec_id").alias("kth_id"))
    carried = queries.join(kth, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", "kth_score", "kth_id")
    rest = cells(carried.mapInArrow(routed(True), route), "rest")
    every = first.select("query_id", "vec_id", "score").union(rest)
    return every.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_exact_top_k(spark, sf_dir):
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return top_k(vectors, F.col("vec_id") % EVERY == 0)


OP6_SQL = """
WITH kept AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
  FROM (SELECT vec_id, min(v) AS v FROM kept WHERE vec_id % 100 = 0 GROUP BY vec_id) q JOIN kept c ON c.vec_id <> q.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
