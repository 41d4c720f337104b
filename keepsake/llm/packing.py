"""Best-fit decreasing packing of tokenised documents into sequences.

A document is its token ids and one separator. One longer than a sequence is cut into full sequences, the first piece
being the shorter one. All pieces of the table are packed together: pieces in falling order of length, each put into the
tightest open sequence, which a segment tree over remaining capacities finds in logarithmic time. Pieces of one length are
alike, so what goes where follows from how many there are of each length, at most ``sequence`` numbers, and is found on
the driver from these alone: the tree holds how many sequences have each capacity, and a step puts as many equal pieces
as fit into as many equal sequences as there are. The result is a list of slots, bounded by the sequence's length and
not by the table: the n-th piece of a length is looked up in it. Pieces are numbered within their length by the counts
of the tasks that made them, so no length is gathered in one task.

Defined results: a null text is an empty one and becomes the separator alone; repeated rows are packed as often as they
occur; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, numbered, text_of, written

SEQUENCE = 2048
SEPARATOR = 0
TOKENIZER = "byte_bpe_50k.json"
#: The same vocabulary as ranks, for a library that merges faster; None: everything by the tokenizer.
RANKS = "byte_bpe_50k.tiktoken"
#: Texts with anything but these characters, or with marks of special tokens, are encoded by the tokenizer: the two
#: libraries' character classes are the same for these ranges and may differ elsewhere.
ODD = re.compile("[^\\n\\t\\r\\x20-\\x7e\u00a1-\u024f\u0370-\u03ff\u0400-\u04ff\u2010-\u2027\u2030-\u205e]|<\\|")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of texts as packed unsigned 32-bit little-endian bytes."""

    def __init__(self, path: str, ranks: str | None):
        self.path, self.merger = path, None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.merger = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    @functools.cached_property
    def tokenizer(self):
        """Loaded when a text first asks for it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        if self.merger is None or ODD.search(text):
            return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()
        return np.asarray(self.merger.encode_to_numpy(text, disallowed_special=()), dtype="<u4").tobytes()


@functools.cache
def encoder_of(path: str, ranks: str | None) -> Encoder:
    """One for each Python worker, which goes on from task to task."""
    return Encoder(path, ranks)


class TightestFit:
    """How many open sequences have each remaining capacity: a segment tree over the capacities 0..top."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, sequences: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += sequences
            i >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of ``least`` or more that a sequence has."""
        count, i = self.count, least + self.leaves
        if not count[i]:
            while True:  # up until a right sibling holds something
                if i == 1:
                    return None
                if not i & 1 and count[i + 1]:
                    i += 1
                    break
                i >>= 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        return i - self.leaves


#: A slot: pieces of one length from the ``first``-th on go ``each`` at a time into sequences from ``sequence`` on, at ``offset``.
SLOTS = ("length", "first", "each", "sequence", "offset")


def best_fit_decreasing(counts: dict[int, int], top: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Slots of so many pieces of each length.

    A sequence that just took a piece of length n is, if it can take another, the tightest for the next of length n, as
    it was the tightest before; so sequences of one capacity are filled one after the other with as many as fit."""
    fit, opened, slots = TightestFit(top), 0, []
    ranges: dict[int, list[tuple[int, int]]] = {}  # by capacity: runs of sequences as (first, how many)
    for n in sorted(counts, reverse=True):
        done, left = 0, counts[n]
        while left:
            capacity = fit.tightest(n)
            if capacity is None:
                capacity, each = top, top // n
                first, sequences = opened, -(-left // each)
                opened += sequences
            else:
                each = capacity // n
                first, sequences = ranges[capacity].pop()
                taken = min(sequences, -(-left // each))
                fit.add(capacity, -taken)
                if taken < sequences:
                    ranges[capacity].append((first + taken, sequences - taken))
                sequences = taken
            full, rest = divmod(min(left, sequences * each), each)
            for at, many, pieces_ in ((first, full, each), (first + full, 1, rest)):
                if many and pieces_:
                    slots.append((n, done, pieces_, at, top - capacity))
                    done += many * pieces_
                    left -= many * pieces_
                    room = capacity - pieces_ * n
                    if room:
                        ranges.setdefault(room, []).append((at, many))
                        fit.add(room, many)
    return slots


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, path: str, ranks: str | None, sequence: int = SEQUENCE, separator: int = SEPARATOR, texts_a_call: int = 256) -> DataFrame:
    """A row per piece; part: the task that made it, nth: its number among the task's pieces of its length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(path, ranks), np.array([separator], dtype="<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), [0] * (sequence + 1)
        for batch in batches:
            out: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), map(encoder.encode, batch.column(1).to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                first = n % sequence or sequence
                for k, start in enumerate([0, *range(first, n, sequence)]):
                    length = sequence if k else first
                    out.append((doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, seen[length]))
                    seen[length] += 1
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()), strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(in_slices(cut, texts_a_call), PIECES)


def packed(docs: DataFrame, path: str | None = None, ranks: str | None = None, sequence: int = SEQUENCE, separator: int = SEPARATOR) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset. path: a tokenizer; ranks: the same vocabulary as ranks, if there is one."""
    if path is None:
        path, ranks = tokenizer_path(), tokenizer_path(RANKS) if RANKS else None
    every = written(pieces(docs, path, ranks, sequence, separator), "pieces")
    counts = {r["length"]: r["n"] for r in every.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a length at most
    slots = {name: np.array(column, dtype=np.int64) for name, column in zip(SLOTS, zip(*best_fit_decreasing(counts, sequence), strict=True), strict=False)}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not slots:
            return
        starts = np.searchsorted(slots["length"] * -1, -np.arange(sequence + 2))  # slots lie in falling order of length
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            low, high = starts[length], starts[length - 1]
            while (low + 1 < high).any():  # the last slot of the length that doesn't begin after the piece
                middle = (low + high) // 2
                before = (slots["first"][np.minimum(middle, len(slots["first"]) - 1)] <= number) & (middle < high)
                low, high = np.where(before, middle, low), np.where(before, high, middle)
            later = number - slots["first"][low]
            sequence_id, offset = slots["sequence"][low] + later // slots["each"][low], slots["offset"][low] + later % slots["each"][low] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence_id), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    number = numbered(every, ["length"], "part", "nth", "number").select("doc_id", "piece", "start", "length", "ids_crc32", "number")
    return number.mapInArrow(in_slices(placed, 1 << 16), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_best_fit_packing(spark, sf_dir):
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def packed_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)
