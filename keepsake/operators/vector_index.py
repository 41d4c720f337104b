"""A stored index of vectors: lists around centres, residuals in a byte a component, only probed lists read.

Centres come from a bounded sample; every vector is in the index. A search scores the codes of the lists nearest to each
question and, given the vectors themselves, ranks the best few again by their true similarity. ``search.by_vector`` and
``knn.neighbours`` are the exact ways; recall grows with ``probes``, and with all lists probed only the codes' rounding
can lose a neighbour."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import cosine, valid
from ..sources.store import Store

#: Vectors that centres are fitted on, at most; questions of one search, at most.
SAMPLE, QUESTIONS = 65_536, 1000
ROWS = "bucket_id long, scale float, code binary, list int"


def unit_matrix(vectors: pa.Array) -> np.ndarray:
    """One row a vector, at unit length."""
    rows = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(vectors), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def centres_of(sample: np.ndarray, lists: int, rounds: int = 10, seed: int = 42) -> np.ndarray:
    """Spherical means; one that loses all its vectors stays where it is."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[: min(lists, len(sample))]]
    for _ in range(rounds):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-12), centres)
    return centres


class VectorIndex:
    """bucket_id and embedding under a name in a store; vectors that aren't valid, or of another size than the centres, are left out."""

    def __init__(self, store: Store, name: str):
        self.store, self.name = store, name

    def fit(self, embeddings: DataFrame, lists: int = 256, most: int = SAMPLE, seed: int = 42) -> None:
        """Fits the centres on the first ``most`` vectors by a seeded hash of their ids, and begins an empty index."""
        rows = embeddings.filter(valid(F.col("embedding"))).orderBy(F.xxhash64("bucket_id", F.lit(seed)), "bucket_id").limit(most).select("embedding").toArrow()
        if not rows.num_rows:
            raise ValueError("there are no vectors to fit centres on")
        centres = centres_of(unit_matrix(rows["embedding"].combine_chunks()), lists, seed=seed)
        table = self.store.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>")
        self.store.replace(f"{self.name}-centres", table.coalesce(1))
        if self.store.exists(self.name):
            self.store.delete(self.name)

    def centres(self) -> np.ndarray:
        return np.array([r["centre"] for r in self.store.read(f"{self.name}-centres").orderBy("list").collect()])

    def add(self, embeddings: DataFrame) -> None:
        """Adds vectors; those of ids that are there already are to be removed first."""
        centres = self.centres()

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                rows = unit_matrix(batch.column("embedding"))
                nearest = (rows @ centres.T).argmax(axis=1)
                rest = rows - centres[nearest]
                scale = np.maximum(np.abs(rest).max(axis=1), 1e-12)
                codes = np.round(rest / scale[:, None] * 127).astype(np.int8)
                yield pa.RecordBatch.from_arrays([batch.column("bucket_id"), pa.array(scale, pa.float32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(nearest, pa.int32())], names=["bucket_id", "scale", "code", "list"])

        usable = embeddings.filter(valid(F.col("embedding"), centres.shape[1])).select(F.col("bucket_id").cast("long"), F.col("embedding").cast("array<double>"))
        usable.mapInArrow(coded, ROWS).repartition("list").write.mode("append").partitionBy("list").parquet(f"{self.store.folder}/{self.name}")

    def rows(self) -> DataFrame:
        return self.store.spark.read.schema(ROWS).parquet(f"{self.store.folder}/{self.name}")

    def remove(self, ids: DataFrame) -> None:
        """Takes ids out, writing only the lists that hold them; again, it changes nothing."""
        gone = ids.select("bucket_id").distinct()
        touched = [r[0] for r in self.rows().join(gone, "bucket_id", "left_semi").select("list").distinct().collect()]  # lists at most
        if not touched:
            return
        left = self.rows().filter(F.col("list").isin(touched)).join(gone, "bucket_id", "left_anti")
        kept = {r[0] for r in left.select("list").distinct().collect()}
        left.repartition("list").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("list").parquet(f"{self.store.folder}/{self.name}")
        for number in set(touched) - kept:
            self.store.delete(f"{self.name}/list={number}")

    def reconcile(self, buckets: DataFrame, embeddings: DataFrame) -> None:
        """Vectors without a memory go, and memories' vectors that aren't here yet come."""
        self.remove(self.rows().join(buckets.select("bucket_id"), "bucket_id", "left_anti"))
        self.add(embeddings.join(buckets.select("bucket_id"), "bucket_id", "left_semi").join(self.rows().select("bucket_id"), "bucket_id", "left_anti"))

    def search(self, questions: DataFrame, k: int, probes: int, embeddings: DataFrame | None = None, refine: int = 4) -> DataFrame:
        """question_id, bucket_id, similarity, n (1 to k). ``questions``: question_id and vector, few and checked, which travel to the lists; with ``embeddings`` the best ``refine`` times k are ranked by their vectors."""
        asked = questions.select("question_id", F.col("vector").cast("array<double>").alias("vector")).filter(valid(F.col("vector"))).limit(QUESTIONS + 1).toArrow()
        if asked.num_rows > QUESTIONS:
            raise ValueError(f"more than {QUESTIONS} questions in one search")
        most = k * refine if embeddings is not None else k
        centres = self.centres()
        numbers = asked["question_id"].to_numpy()
        vectors = unit_matrix(asked["vector"].combine_chunks()) if asked.num_rows else np.zeros((0, centres.shape[1]))
        near = vectors @ centres.T
        probed = np.zeros(near.shape, dtype=bool)
        np.put_along_axis(probed, np.argsort(-near, axis=1, kind="stable")[:, :probes], True, axis=1)
        lists = [int(x) for x in np.flatnonzero(probed.any(axis=0))]

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The best of each question in each list of each batch."""
            for batch in batches:
                of = batch.column("list").to_numpy()
                ids, scale = batch.column("bucket_id").to_numpy(), batch.column("scale").to_numpy()
                codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.int8).reshape(batch.num_rows, -1)
                for number in np.unique(of):
                    at, who = np.flatnonzero(of == number), np.flatnonzero(probed[:, number])
                    close = vectors[who] @ (centres[number] + codes[at] * (scale[at, None] / 127.0)).T
                    order = np.lexsort((np.broadcast_to(ids[at], close.shape), -close), axis=1)[:, :most]
                    found = np.take_along_axis(close, order, axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(numbers[who], order.shape[1])), pa.array(ids[at][order].ravel()), pa.array(found.ravel())], names=["question_id", "bucket_id", "similarity"])

        hits = self.rows().filter(F.col("list").isin(lists)).mapInArrow(scored, "question_id long, bucket_id long, similarity double")
        rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("similarity"), "bucket_id"))
        best = hits.withColumn("n", rank).filter(F.col("n") <= most)
        if embeddings is not None:
            own = self.store.spark.createDataFrame(pa.table({"question_id": numbers, "vector": asked["vector"]}))
            best = best.drop("similarity", "n").join(embeddings.select("bucket_id", "embedding"), "bucket_id").join(own, "question_id").withColumn("similarity", cosine(F.col("embedding"), F.col("vector")))
            best = best.withColumn("n", rank).filter(F.col("n") <= k)
        return best.select("question_id", "bucket_id", "similarity", "n")
