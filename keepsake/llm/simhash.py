"""SimHash near-duplicates with pivot distance tables.

A fingerprint's bits are the majorities of its shingle hashes' bits. Distinct fingerprints are routed by keys, since
pivots alone would compare every pair: by pairs of equal bit blocks, as at most three differing bits leave at least two
of five blocks equal, so every link meets under one of ten keys. Under a key, each fingerprint gets a table of Hamming
distances to reference fingerprints (pivots); a pair whose distances to any pivot differ by more than the allowed number
of bits can't link (triangle inequality) and is discarded by the largest coordinate difference, and the survivors are
verified by their own distance. A key with more than ``chunk`` fingerprints is split by the same tables: a cell for each
distance to the first pivot (of very many, to the second too), to which go the fingerprints of that distance and those up
to ``bits`` nearer, so a fingerprint is copied ``bits`` times, however many there are. A task returns a spanning forest of
the links it finds, which keeps components whole with fewer rows than fingerprints. Components are joined over the whole
table by rounds of minimum labels.

The pipeline's stage looks for texts whose sets of five-word shingles are alike by ``SIMILARITY`` or more (Jaccard). Their
fingerprints may differ by ``STAGE_BITS`` of 64 bits, too many for equal blocks, so they are routed by ``BANDS`` bands of
``BAND_ROWS`` minima of the same shingle hashes: two texts alike by 0.8 share a band in 99.8 of 100 cases, more like ones
nearly always. Under a band, pivots and distances select as above (keys of many are cut into chunks, each pair of which is
a cell); what they link makes coarse groups, in which each text's shingle set meets the others once: pairs within the
distance are verified by their sets, nearest first, and only while they aren't joined already.

Defined results: null and blank texts have fingerprint zero and no shingles and are linked like any other; repeated rows share a
fingerprint and so a component; rows with a null doc_id are returned and count for a component's smallest id only if it
has no other; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, DOCUMENT_COLUMNS, in_slices, text_of, written
from .graph import components

WORDS, SEED, BITS = 3, 42, 3
BLOCKS, EQUAL = (13, 13, 13, 13, 12), 2
PIVOTS, CHUNK = 16, 1024
#: The stage's: words of a shingle, share of common shingles, bits that may differ, bands and minima of each, texts of a cell.
STAGE_WORDS, SIMILARITY, STAGE_BITS = 5, 0.8, 18
BANDS, BAND_ROWS, CELL = 20, 6, 4096
LOWER = bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode())


def shingle_hashes(text: str, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    parts = text.encode().translate(LOWER).split()  # bytes split at exactly the six ASCII white space characters
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)], dtype=np.uint64, count=n)


def majority(hashes: np.ndarray, step: int = 1 << 16) -> int:
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), step):
        part = hashes[at : at + step]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            values = np.array([majority(shingle_hashes(t, words, seed)) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(in_slices(run), "doc_id long, fp long")


def pivots(count: int = PIVOTS) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}".encode(), SEED) for i in range(count)], dtype=np.uint64)


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def table_of(fps: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Hamming distances to each reference."""
    return np.bitwise_count(fps[:, None] ^ references[None, :]).astype(np.int8)


def linked_pairs(left: np.ndarray, right: np.ndarray, bits: int, references: np.ndarray, block: int = 1 << 22):
    """Positions of pairs within ``bits`` and their distances, some at a time: pairs are discarded by pivot after pivot, survivors verified."""
    dl, dr = table_of(left, references), table_of(right, references)
    order = np.argsort(dr[:, 0], kind="stable")
    dr, right = dr[order], right[order]
    step = max(1, min(256, block // max(1, len(right))))
    for at in range(0, len(left), step):
        own = dl[at : at + step]
        lo, hi = np.searchsorted(dr[:, 0], int(own[:, 0].min()) - bits), np.searchsorted(dr[:, 0], int(own[:, 0].max()) + bits, "right")
        i, j = np.nonzero(np.abs(own[:, None, 0] - dr[None, lo:hi, 0]) <= bits)
        for p in range(1, len(references)):
            keep = np.abs(own[i, p] - dr[lo:hi][j, p]) <= bits
            i, j = i[keep], j[keep]
        distance = np.bitwise_count(left[at : at + step][i] ^ right[lo:hi][j])
        keep = distance <= bits
        yield i[keep] + at, order[lo:hi][j[keep]], distance[keep]


def forest_links(left: np.ndarray, right: np.ndarray | None, bits: int, references: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``left``, or between it and ``right``."""
    every = left if right is None else np.concatenate([left, right])
    forest, out = Forest(len(every)), []
    for i, j, _ in linked_pairs(left, every if right is None else right, bits, references):
        if not len(i):
            continue
        j = j + (0 if right is None else len(left))
        root = np.fromiter(map(forest.root, range(len(every))), dtype=np.int64, count=len(every))
        apart = root[i] != root[j]
        for a, b in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
            if forest.join(a, b):
                out.append((a, b))
    signed = every.view(np.int64)
    return [(int(signed[i]), int(signed[j])) for i, j in out]


def block_keys(distinct: DataFrame, blocks=BLOCKS, equal: int = EQUAL) -> DataFrame:
    """fp and key: a row for each choice of ``equal`` blocks."""
    shifts = np.concatenate([[0], np.cumsum(blocks)])[:-1].tolist()
    block = lambda i: F.shiftrightunsigned("fp", shifts[i]).bitwiseAND(F.lit((1 << blocks[i]) - 1))
    keys = []
    for number, chosen in enumerate(combinations(range(len(blocks)), equal)):
        key = F.lit(number).cast("long")
        for i in chosen:
            key = key * (1 << blocks[i]) + block(i)
        keys.append(key)
    return distinct.select("fp", F.explode(F.array(*keys)).alias("key"))


def in_strips(meet: DataFrame, bits: int, chunk: int, references: np.ndarray) -> DataFrame:
    """key, x, y, guest, fp: small keys are one cell; others have a cell for each distance to the first pivot, very large ones also to the second. A pair within ``bits`` meets where the larger distances are; guest: nearer than x."""
    distance = lambda p: F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(references[p : p + 1].view(np.int64)[0])))).cast("int")
    strips = lambda p, least: F.when(F.col("n") > least, F.sequence(distance(p), distance(p) + bits)).otherwise(F.array(F.lit(-1)))
    by_first = meet.select("key", "fp", "n", F.explode(strips(0, chunk)).alias("x"))
    cells = by_first.select("key", "fp", "x", F.explode(strips(1, chunk * 256)).alias("y"))
    return cells.select("key", "x", "y", ((F.col("x") >= 0) & (F.col("x") != distance(0))).cast("int").alias("guest"), "fp")


def in_chunks(meet: DataFrame, chunk: int) -> DataFrame:
    """key, x, y, guest, fp: small keys are one cell; others are cut into chunks, and each pair of chunks is a cell (guest: of the second one)."""
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    cells = meet.select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other")).select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "fp")
    return cells.select("key", "x", "y", ((F.col("x") != F.col("y")) & (F.col("own") == F.col("y"))).cast("int").alias("guest"), "fp")


def links(keyed: DataFrame, bits: int = BITS, chunk: int = CHUNK) -> DataFrame:
    """a and b: a spanning forest, for each key, of the pairs of fingerprints within ``bits``; keyed: distinct rows of fp and key."""
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    references = pivots()
    meet = keyed.join(sizes, "key")
    cells = in_strips(meet, bits, chunk, references) if bits < 8 else in_chunks(meet, chunk)
    dealt = cells.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "guest")
    strips = bits < 8

    def forests(batches):
        def cut(rows: np.ndarray, last: bool):
            key, x, y, guest, fp = rows
            edges = np.flatnonzero((np.diff(key) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)) + 1
            starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(key)]])
            if not last:
                starts, ends = starts[:-1], ends[:-1]
            found: list[tuple[int, int]] = []
            sizes = ends - starts
            fps = fp.view(np.uint64)
            two = starts[(sizes == 2)]
            if len(two):  # many cells of one pair at once
                keep = np.abs(table_of(fps[two], references) - table_of(fps[two + 1], references)).max(axis=1) <= bits
                two = two[keep]
                two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= bits]
                found += zip(fp[two].tolist(), fp[two + 1].tolist(), strict=True)
            for a, b in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist(), strict=True):
                middle = a + int(np.searchsorted(guest[a:b], 1))
                if middle == b:
                    found += forest_links(fps[a:b], None, bits, references)
                elif middle > a:  # strips: guests meet those of the cell, which meet one another too; chunks: one meets the other
                    found += forest_links(fps[a:middle], fps[middle:b], bits, references)
                    found += forest_links(fps[a:middle], None, bits, references) if strips else []
            done = ends[-1] if len(ends) else 0
            a, b = list(zip(*found, strict=True)) or [[], []]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]), rows[:, done:]

        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)]))
            if len(held) > 1 and (held[-1][:3, -1:] == held[0][:3, :1]).all():
                continue  # a cell larger than a batch is put together once, at its end
            rows = np.concatenate(held, axis=1)
            held = [rows]
            if rows.shape[1]:
                out, rest = cut(rows, False)
                held = [rest] if rest.shape[1] else []
                yield out
        if held:
            yield cut(np.concatenate(held, axis=1), True)[0]

    return dealt.select("key", "x", "y", "guest", "fp").mapInArrow(in_slices(forests, 1 << 20), "a long, b long")


def near_duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, fp, component_id and kept (the first row of its component)."""
    rows = written(fingerprints(docs), "fingerprints")
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    reached = components(links(block_keys(first.select("fp")), bits))
    labelled = first.join(reached, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = labelled.join(smallest, "component").select(F.col("fp").alias("of"), "component_id")
    return rows.join(of_fp, F.col("fp") == F.col("of")).select("doc_id", "fp", "component_id")


def op2_simhash_near_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def band_keys(hashes: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS, step: int = 1 << 12) -> np.ndarray:
    """A key for each band: its number and the minima of its permutations of the hashes."""
    by = np.random.default_rng(SEED).integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(bands * rows, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(hashes), step):
        part = hashes[at : at + step, None] * by
        part ^= part >> np.uint64(29)
        least = np.minimum(least, (part * by[::-1]).min(axis=0))
    mixed = (least.reshape(bands, rows) >> np.uint64(7)) * by[:rows]
    keys = mixed.sum(axis=1, dtype=np.uint64) ^ (np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    keys ^= keys >> np.uint64(31)
    return keys * np.uint64(0xBF58476D1CE4E5B9)


def profiles(docs: DataFrame, words: int = STAGE_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, __row, text_digest, fp, keys and shingles (distinct hashes of 32 bits in rising order, packed)."""

    def run(batches):
        for batch in batches:
            fps, keys, sets = [], [], []
            for text in batch.column(1).to_pylist():
                every = shingle_hashes(text, words, seed)
                distinct = np.unique(every)
                fps.append(majority(every))
                keys.append(band_keys(distinct).view(np.int64))
                sets.append(np.unique((distinct >> np.uint64(32)).astype("<u4")).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(sets, pa.binary())], names=["doc_id", "__row", "text_digest", "fp", "keys", "shingles"])

    source = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"), "__row", F.md5(text_of().cast("binary")).alias("text_digest"))
    return source.mapInArrow(in_slices(run, 256), "doc_id long, __row string, text_digest string, fp long, keys array<long>, shingles binary")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two rising arrays; two empty ones are alike."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 1.0


def verified_links(groups: DataFrame, bits: int = STAGE_BITS, least: float = SIMILARITY, cell: int = CELL) -> DataFrame:
    """a and b: links of texts of one group whose shingle sets are alike by ``least``, as many as keep components whole. groups: group, text_digest, fp, shingles. Groups of more than a cell are cut into chunks, each pair of which is a cell."""
    sizes = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    chunks = F.ceil(F.col("n") / cell).cast("int")
    own = F.pmod(F.xxhash64("text_digest"), chunks).cast("int")
    cells = groups.join(sizes, "group").select("group", "text_digest", "fp", "shingles", own.alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
    cells = cells.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("other")
    references = pivots()

    def verify(rows: pa.Table) -> pa.Table:
        fps = rows["fp"].to_numpy().view(np.uint64)
        sets = [np.frombuffer(s, dtype="<u4") for s in rows["shingles"].to_pylist()]
        first = np.flatnonzero(rows["own"].to_numpy() == rows["x"][0].as_py())
        second = first if rows["x"][0].as_py() == rows["y"][0].as_py() else np.flatnonzero(rows["own"].to_numpy() == rows["y"][0].as_py())
        pairs = list(linked_pairs(fps[first], fps[second], bits, references))
        i, j, distance = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, dtype=np.int64) for k in range(3))
        i, j = first[i], second[j]
        sizes = np.array([len(s) for s in sets])
        possible = (i < j if second is first else np.ones(len(i), dtype=bool)) & (np.minimum(sizes[i], sizes[j]) >= least * np.maximum(sizes[i], sizes[j]))
        by = np.flatnonzero(possible)[np.argsort(distance[possible], kind="stable")]
        forest, found = Forest(len(fps)), []
        for at in range(0, len(by), 4096):
            a, b = i[by[at : at + 4096]], j[by[at : at + 4096]]
            root = np.fromiter(map(forest.root, range(len(fps))), dtype=np.int64, count=len(fps))
            apart = root[a] != root[b]
            for p, q in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
                if forest.root(p) != forest.root(q) and similarity(sets[p], sets[q]) >= least:
                    forest.join(p, q)
                    found.append((p, q))
        digest = rows["text_digest"].to_pylist()
        return pa.table({"a": pa.array([digest[p] for p, _ in found], pa.string()), "b": pa.array([digest[q] for _, q in found], pa.string())})

    return cells.groupBy("group", "x", "y").applyInArrow(verify, "a string, b string")


def alike_texts(found: DataFrame) -> DataFrame:
    """node and component of texts that have a like one; found: ``profiles``, written."""
    texts = found.groupBy("text_digest").agg(F.first("fp").alias("fp"))
    keyed = found.select("fp", F.explode("keys").alias("key")).distinct()
    coarse = written(components(links(keyed, STAGE_BITS)), "coarse")
    grouped = texts.join(coarse, F.col("fp") == F.col("node"), "left").select(F.col("text_digest").alias("of"), F.coalesce("component", "fp").alias("group"))
    shared = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("group").alias("g"))
    members = grouped.join(shared, F.col("group") == F.col("g"), "left_semi")
    held = found.join(members, F.col("text_digest") == F.col("of")).dropDuplicates(["text_digest"]).select("group", "text_digest", "fp", "shingles")
    return components(verified_links(held))


def simhash_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts alike by ``SIMILARITY`` stays, that of the smallest doc_id (null last), then of the smallest digest of all its columns.

    Ids need not tell rows apart: a row is known by its digest, which only rows equal in every column share."""
    columns = [c for c in DOCUMENT_COLUMNS if c in docs.columns]
    keyed = docs.select(*columns, F.md5(F.to_json(F.struct(*columns))).alias("__row"))
    found = written(profiles(keyed), "profiles")
    alike = alike_texts(found)
    labelled = found.select("doc_id", "__row", "text_digest").join(alike, F.col("text_digest") == F.col("node"), "left").select("doc_id", "__row", F.coalesce("component", "text_digest").alias("component"))
    first = labelled.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "__row")).alias("first"))
    kept = first.select(F.col("first.__row").alias("__kept"))
    return keyed.join(kept, F.col("__row") == F.col("__kept"), "left_semi").dropDuplicates(["__row"]).select(*columns)
