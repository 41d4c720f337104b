"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that also starts in a document of smaller id.

Texts are laid end to end in shards of about ``SHARD_BYTES``. Every string of LENGTH bytes names the smallest hash of
its own GRAM-byte pieces, so equal strings have equal names and neighbours mostly share one (about one name for 16
bytes). The names alone, 5 bytes each, are shuffled by bucket to find those seen in two documents; no other part of a
text can hold a repeat. What they cover goes on:

* each shard sorts its suffixes (Larsson-Sadakane: first by 8 bytes, then only groups still equal, by the rank of what
  follows, doubling each time), and takes common prefixes with the suffix before by Kasai's walk, many stretches of the
  text at a time. Neighbours of LENGTH common bytes form a group of equal strings, which knows its smallest document;
* one string of each group goes to the bucket of its name, neighbours of one name as one stretch of text. In a bucket,
  stretches that several shards have are told by their bytes and taken once, with the smallest document. Each shard's
  strings of the rest are sorted by a digest, the lists are merged, and each is sought in the merged one by binary
  search, strings being compared byte by byte; those that start in a smaller document are sent back to their shard.

A shard sends each distinct string once, so however many copies a text or passage has, a bucket gets one for each shard.
A name that more than ``HOT_SHARDS`` shards have, such as that of a line that stands between different texts, would send
all strings around it to one bucket; its strings go by a second name, the smallest hash of their own LONG_GRAM-byte
pieces, which a line shorter than that can't decide. Of a line of LONG_GRAM to LENGTH - 1 bytes, ten strings an occurrence
at most still share a bucket.
Text is shuffled twice, to meet the answers of its shard; tables of the shared folder cut the lineage between the steps.
In a bucket, lists are merged in the order of digests, not of bytes: comparing bytes at each step of a search took
several times the CPU.

Defined results: strings are judged on the input, as UTF-8 bytes; a null text is empty; rows of one doc_id are one
document and don't remove from each other; a null doc_id comes after all others and removes from none; an empty table
gives an empty result; further columns are ignored, or carried by name.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import DOCUMENT_COLUMNS, in_slices, shuffle_partitions, text_of, written

LENGTH, GRAM, LONG_GRAM = 50, 20, 45
SHARD_BYTES = 1 << 20
#: Text bytes for each bucket of names and of strings.
NAME_BUCKET, STRING_BUCKET = 16 << 20, 4 << 20
HOT_SHARDS = 256
LAST = 2**63 - 1
SEED = 42

# ---------------------------------------------------------------- one shard


def byte_codes(seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as any text so far needed."""

    def __init__(self, seed: int = SEED):
        self.base = (0x9E3779B97F4A7C15 + 2 * seed) | 1
        self.up = self.down = np.ones(0, dtype=np.uint64)
        self.codes = byte_codes(seed)

    def reach(self, n: int) -> None:
        if len(self.up) < n:

            def powers(base: int) -> np.ndarray:
                out = np.full(n, base, dtype=np.uint64)
                out[0] = 1
                return np.cumprod(out)

            self.up, self.down = powers(self.base), powers(pow(self.base, -1, 2**64))

    def rolling(self, data: np.ndarray, size: int) -> np.ndarray:
        """A 64-bit hash of the ``size`` bytes from each place."""
        n = len(data)
        if n < size:
            return np.zeros(0, dtype=np.uint64)
        self.reach(n + 1)
        sums = self.codes[data]
        sums *= self.up[:n]
        np.cumsum(sums, out=sums)
        out = sums[size - 1 :].copy()
        out[1:] -= sums[:-size]
        del sums
        out *= self.down[: n - size + 1]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
        return out


def smallest_hashes(data: np.ndarray, powers: Powers, length: int, gram: int) -> np.ndarray:
    """Of the ``length`` bytes from each place, the smallest hash of their ``gram``-byte pieces."""
    names, span, width = powers.rolling(data, gram), 1, length - gram + 1
    while 2 * span <= width:
        names = np.minimum(names[:-span], names[span:])
        span *= 2
    if span < width:
        names = np.minimum(names[: span - width], names[width - span :])
    return names


def spread(minima: np.ndarray) -> np.ndarray:
    """Minima are small numbers; these are spread over all again."""
    out = minima * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def runs_of_names(data: np.ndarray, ends: np.ndarray, powers: Powers, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of places of a document whose strings have one name: first place, place after the last, name."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none.astype(np.uint64)
    names = smallest_hashes(data, powers, length, gram)
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(len(data) + 1, dtype=np.int8)  # +1 where a document's strings begin, -1 after the last
    long = ends - starts >= length
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - length + 1, -1)
    inside = np.cumsum(inside[: len(names)], dtype=np.int8).astype(bool)
    new = inside.copy()
    new[1:] &= (names[1:] != names[:-1]) | ~inside[:-1]
    over = inside.copy()
    over[:-1] &= new[1:] | ~inside[1:]
    first = np.flatnonzero(new)
    return first, np.flatnonzero(over) + 1, spread(names[first])


def words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one big-endian number, zeros after the end."""
    padded = np.zeros(len(data) + 8, dtype=np.uint64)
    padded[: len(data)] = data
    for shift in (1, 2, 4):
        padded[:-shift] = (padded[:-shift] << np.uint64(8 * shift)) | padded[shift:]
    return padded[: len(data)]


def suffix_array(data: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """Starts of the suffixes in order, an end before any byte."""
    n = len(data)
    if n < 2:
        return np.arange(n)
    words = words8(data) if words is None else words
    order = np.argsort(words, kind="quicksort")
    sorted_words = words[order]
    edge = np.concatenate([[True], sorted_words[1:] != sorted_words[:-1]])
    # zeros that stand for the end are not yet told from zero bytes: such places are ranked by length first
    tail = order >= n - 7
    if tail.any():
        groups = np.cumsum(edge)
        for g in np.unique(groups[tail]):
            at = np.flatnonzero(groups == g)
            if len(at) > 1:
                own = order[at]
                short = np.sort(own[own >= n - 7])[::-1]
                order[at] = np.concatenate([short, own[own < n - 7]])
                edge[at[1 : len(short) + 1]] = True
    step = 8
    rank = np.empty(n, dtype=np.int64)
    slots = np.flatnonzero(edge)
    rank[order] = np.repeat(slots, np.diff(np.append(slots, n)))
    single = edge & np.append(edge[1:], True)
    open_ = np.flatnonzero(~single)
    while len(open_):
        members = order[open_]
        after = members + step
        following = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        group = rank[members]
        key = (group.astype(np.uint64) << np.uint64(32)) | following.astype(np.uint64)
        by = np.argsort(key, kind="quicksort")
        key, members = key[by], members[by]
        order[open_] = members
        new = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.flatnonzero(new)
        rank[members] = np.repeat(open_[at], np.diff(np.append(at, len(key))))
        single = new & np.append(new[1:], True)
        open_ = open_[~single]
        step *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int = LENGTH, words: np.ndarray | None = None, stretches: int = 8192) -> np.ndarray:
    """Kasai: bytes that each suffix of the order shares with the one before it, counted up to 8 more than ``most``.

    Along the text the count falls by one at most from place to place; ``stretches`` walks go on side by side."""
    n = len(data)
    out = np.zeros(n, dtype=np.int32)
    if n < 2:
        return out
    words = words8(data) if words is None else words
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    size = -(-n // min(stretches, max(1, n // 64)))
    place = np.arange(0, n, size)
    last = np.minimum(place + size, n)
    have = np.zeros(len(place), dtype=np.int64)
    by_place = np.zeros(n, dtype=np.int32)
    words = np.append(words, np.zeros(most + 16, dtype=np.uint64))
    while len(place):
        other = before[place]
        room = n - np.maximum(place, other)
        differ = words[place + have] ^ words[np.maximum(other, 0) + have]
        equal = (differ == 0) & (other >= 0) & (have < np.minimum(most, room))
        # of two words that differ, the bytes before the highest one that differs are common
        high = differ >> np.uint64(32)
        top = np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 32, np.frexp((differ & np.uint64(0xFFFFFFFF)).astype(np.float64))[1])
        extra = np.where(differ == 0, 8, 7 - (top - 1) // 8)
        have = np.where(other < 0, 0, np.minimum(np.minimum(have + extra, most + 8), np.maximum(room, 0)))
        done = ~equal
        finished = place[done]
        by_place[finished] = have[done]
        place = place + done
        have = np.where(done, np.maximum(have - 1, 0), have)
        going = place < last
        if not going.all():
            place, last, have = place[going], last[going], have[going]
    out = by_place[order]
    return out


@functools.cache
def compressor(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level)


@functools.cache
def decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def packed(data: bytes, level: int = 3) -> bytes:
    """Compressed here, since it is shuffled."""
    return compressor(level).compress(data)


def unpacked(data: bytes) -> bytes:
    return decompressor().decompress(data)


class Shard:
    """Texts end to end; ``ids`` orders their documents."""

    def __init__(self, blob: bytes, ends: np.ndarray, ids: np.ndarray):
        self.data = np.frombuffer(blob, dtype=np.uint8)
        self.ends, self.ids = ends, ids

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, "right")

    def groups(self, places: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of strings at ``places`` (rising): those that start in a smaller document of this shard too; one place of each distinct string, of its smallest document; and pairs (that place, another of the same document)."""
        none = np.zeros(0, dtype=np.int64)
        if not len(places):
            return none, none, none, none
        cover = np.zeros(len(self.data) + 1, dtype=np.int32)
        edges = np.flatnonzero(np.diff(places) != 1)
        np.add.at(cover, places[np.concatenate([[0], edges + 1])], 1)
        np.add.at(cover, places[np.concatenate([edges, [len(places) - 1]])] + length, -1)
        kept = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        text = self.data[kept]
        words = words8(text)
        order = suffix_array(text, words)
        common = common_prefixes(text, order, length, words)
        asked = np.zeros(len(self.data), dtype=bool)
        asked[places] = True
        group = np.cumsum(common < length)
        place = kept[order]
        own = asked[place]
        group, place = group[own], place[own]
        new = np.concatenate([[True], group[1:] != group[:-1]])
        alone = new & np.append(new[1:], True)
        heads = np.zeros(len(self.data), dtype=bool)
        heads[place[alone]] = True
        place, new = place[~alone], new[~alone]
        if not len(place):
            return none, np.flatnonzero(heads), none, none
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(place)))
        ids = self.ids[self.document(place)]
        least = np.repeat(np.minimum.reduceat(ids, first), size)
        smallest = ids == least
        head = np.minimum.reduceat(np.where(smallest, place, LAST), first)
        heads[head] = True
        head = np.repeat(head, size)
        also = smallest & (place != head)
        return np.sort(place[~smallest]), np.flatnonzero(heads), head[also], place[also]


def places_of(first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """All places of runs, and by ``np.repeat`` of the same lengths what belongs to each."""
    size = after - first
    return np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(first) else np.zeros(0, dtype=np.int64)


def intervals(places: np.ndarray) -> np.ndarray:
    """Rising places as packed (first, count) pairs of unsigned 32-bit numbers."""
    if not len(places):
        return np.zeros((0, 2), dtype=np.uint32)
    edges = np.flatnonzero(np.diff(places) != 1)
    first = places[np.concatenate([[0], edges + 1])]
    last = places[np.concatenate([edges, [len(places) - 1]])]
    return np.stack([first, last - first + 1], axis=1).astype(np.uint32)


def from_intervals(packed: bytes) -> np.ndarray:
    pairs = np.frombuffer(packed, dtype=np.uint32).reshape(-1, 2).astype(np.int64)
    return places_of(pairs[:, 0], pairs[:, 0] + pairs[:, 1])


def pair_runs(of: np.ndarray, also: np.ndarray) -> bytes:
    """Pairs of places, packed: those that go on side by side as one (of, also, count) of unsigned 32-bit numbers."""
    if not len(also):
        return b""
    by = np.argsort(also)
    of, also = of[by], also[by]
    at = np.flatnonzero(np.concatenate([[True], (np.diff(of) != 1) | (np.diff(also) != 1)]))
    return packed(np.stack([of[at], also[at], np.diff(np.append(at, len(also)))], axis=1).astype(np.uint32).tobytes())


def from_pair_runs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    of, also, count = np.frombuffer(unpacked(data) if data else b"", dtype=np.uint32).reshape(-1, 3).astype(np.int64).T
    return places_of(of, of + count), places_of(also, also + count)


# ---------------------------------------------------------------- names seen in two documents


def bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    return ((names >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def short_names(names: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and the name's low 39 bits in one number, in order by bucket."""
    return (bucket_of(names, buckets) << np.uint64(39)) | (names & np.uint64((1 << 39) - 1))


def five_bytes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def from_five_bytes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 5)
    return out.view("<u8").reshape(-1)


def shard_of(row: dict) -> Shard:
    return Shard(unpacked(row["blob"]), np.asarray(row["ends"], dtype=np.int64), np.array([LAST if i is None else i for i in row["ids"]], dtype=np.int64))


def names_of(table: DataFrame, buckets: int) -> DataFrame:
    """bucket, shard, names: a shard's distinct short names, and whether each is in two of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for row in batch.to_pylist():
                shard = shard_of(row)
                first, _, names = runs_of_names(shard.data, shard.ends, powers)
                if not len(first):
                    continue
                short, ids = short_names(names, buckets), shard.ids[shard.document(first)]
                by = np.argsort(short, kind="stable")
                short, ids = short[by], ids[by]
                at = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]]))
                both = np.minimum.reduceat(ids, at) < np.maximum.reduceat(ids, at)
                short = short[at]
                value = ((short & np.uint64((1 << 39) - 1)) << np.uint64(1)) | both.astype(np.uint64)
                bucket = (short >> np.uint64(39)).astype(np.int64)
                edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                parts = [five_bytes(v) for v in np.split(value, edges[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edges], pa.int64()), pa.array([row["shard"]] * len(parts), pa.int64()), pa.array(parts, pa.binary())], names=["bucket", "shard", "names"])

    return table.select("shard", "ids", "ends", "blob").mapInArrow(in_slices(run, 4), "bucket long, shard long, names binary")


def shared_names(names: DataFrame, hot_shards: int = HOT_SHARDS) -> DataFrame:
    """shard and seen: for each bucket two bits for each of the shard's names, first all that tell whether another document has it, then all that tell whether more than ``hot_shards`` shards do."""

    def run(rows: pa.Table) -> pa.Table:
        parts = [from_five_bytes(x) for x in rows["names"].to_pylist()]
        every = np.concatenate(parts)
        name = every >> np.uint64(1)
        by = np.argsort(name, kind="quicksort")
        ordered = name[by]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        count = np.diff(np.append(first, len(ordered)))
        shards = np.empty(len(name), dtype=np.int64)
        shards[by] = np.repeat(count, count)
        flags = np.stack([(every & np.uint64(1)).astype(bool) | (shards > 1), shards > hot_shards])
        bits = [np.packbits(x, axis=1).tobytes() for x in np.split(flags, np.cumsum([len(p) for p in parts])[:-1], axis=1)]
        return pa.table({"bucket": rows["bucket"].cast(pa.int64()), "shard": rows["shard"], "bits": pa.array(bits, pa.binary())})

    return names.groupBy("bucket").applyInArrow(run, "bucket long, shard long, bits binary").groupBy("shard").agg(F.collect_list(F.struct("bucket", "bits")).alias("seen"))


# ---------------------------------------------------------------- strings of shards, merged


def strings_of(table: DataFrame, name_buckets: int, string_buckets: int) -> DataFrame:
    """Of each shard: a row of a negative bucket of its own with the places found inside it and pairs of places of one document; and a row for each bucket with the strings to be sought elsewhere (run, count and document of each stretch, and its bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for row in batch.to_pylist():
                shard = shard_of(row)
                first, after, names = runs_of_names(shard.data, shard.ends, powers)
                short = short_names(names, name_buckets)
                distinct, which = np.unique(short, return_inverse=True)
                size = np.bincount((distinct >> np.uint64(39)).astype(np.int64)) if len(distinct) else np.zeros(0, dtype=np.int64)
                seen = [np.unpackbits(np.frombuffer(s["bits"], dtype=np.uint8).reshape(2, -1), axis=1, count=int(size[s["bucket"]])) for s in sorted(row["seen"], key=lambda s: s["bucket"])]
                kept, hot = np.concatenate(seen, axis=1).astype(bool)[:, which] if seen else np.zeros((2, len(first)), dtype=bool)
                first, after, names, hot = first[kept], after[kept], names[kept], hot[kept]
                repeats, heads, of, also = shard.groups(places_of(first, after))
                out = [(-1 - row["shard"], row["shard"], intervals(repeats).tobytes(), pair_runs(of, also), None)]
                if len(heads):
                    owner = np.searchsorted(first, heads, "right") - 1
                    name = names[owner]
                    own = hot[owner]  # strings that go by their second names
                    if own.any():
                        name[own] = spread(smallest_hashes(shard.data, powers, LENGTH, LONG_GRAM)[heads[own]])
                    edge = np.flatnonzero(np.concatenate([[True], (np.diff(heads) != 1) | (name[1:] != name[:-1])]))
                    count = np.diff(np.append(edge, len(heads)))
                    start, by_name = heads[edge], name[edge]
                    bucket = bucket_of(by_name, string_buckets).astype(np.int64)
                    by = np.argsort(bucket, kind="stable")
                    start, count, bucket = start[by], count[by], bucket[by]
                    ids = shard.ids[shard.document(start)]
                    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist() + [len(bucket)]
                    for a, b in zip(cuts, cuts[1:], strict=False):
                        text = shard.data[places_of(start[a:b], start[a:b] + count[a:b] + LENGTH - 1)]
                        runs = np.stack([np.diff(start[a:b], prepend=0), count[a:b]]).astype(np.uint32)
                        out.append((int(bucket[a]), row["shard"], packed(runs.tobytes()), packed(ids[a:b].tobytes()), packed(text.tobytes())))
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "shard", "runs", "ids", "bytes"])

    return table.select("shard", "ids", "ends", "blob", "seen").mapInArrow(in_slices(run, 4), "bucket long, shard long, runs binary, ids binary, bytes binary")


def equal_strings(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int = LENGTH, most: int = 1 << 16) -> bool:
    """Whether each string at a is equal to the one at b, ``most`` of them at a time."""
    strings = np.lib.stride_tricks.sliding_window_view(data, length)
    return all(np.array_equal(strings[a[i : i + most]], strings[b[i : i + most]]) for i in range(0, len(a), most))


def smallest_documents(lists: list[tuple[np.ndarray, np.ndarray]], data: np.ndarray, seed: int = SEED, length: int = LENGTH) -> list[np.ndarray]:
    """lists: places in ``data`` of one shard's distinct strings, and their documents. The smallest document of each string over all lists.

    Each list is sorted by digest; the lists are merged into one of distinct digests, and each list is sought in it by
    binary search. Every string found is compared with the one it is taken for; if two strings share a digest, all is
    done again with another."""
    while lists:
        digest = Powers(seed).rolling(data, length)
        by = [np.argsort(digest[place]) for place, _ in lists]
        own = [digest[place[b]] for (place, _), b in zip(lists, by, strict=True)]
        place = np.concatenate([p[b] for (p, _), b in zip(lists, by, strict=True)])
        every = np.concatenate(own)
        order = np.argsort(every)
        first = np.flatnonzero(np.concatenate([[True], every[order[1:]] != every[order[:-1]]]))
        merged, standing = every[order[first]], place[order[first]]
        least = np.minimum.reduceat(np.concatenate([i[b] for (_, i), b in zip(lists, by, strict=True)])[order], first)
        at = np.concatenate([np.searchsorted(merged, d) for d in own])
        other = standing[at] != place
        if not equal_strings(data, standing[at[other]], place[other], length):
            seed += 1
            continue
        out, start = [], 0
        for b in by:
            found = np.empty(len(b), dtype=np.int64)
            found[b] = least[at[start : start + len(b)]]
            out.append(found)
            start += len(b)
        return out
    return []


def answers(strings: DataFrame) -> DataFrame:
    """shard and found: packed intervals of places whose string starts in a smaller document of another shard; a shard's own repeats and pairs are passed on."""
    schema = "shard long, found binary, repeats binary, pairs binary"

    def run(rows: pa.Table) -> pa.Table:
        if rows["bucket"][0].as_py() < 0:
            return pa.table({"shard": rows["shard"], "found": pa.nulls(rows.num_rows, pa.binary()), "repeats": rows["runs"], "pairs": rows["ids"]})
        number, parts, new = {}, [], [0]  # distinct stretches in the order in which they come, and how many there are after each shard
        for row in rows.select(["shard", "runs", "ids", "bytes"]).to_pylist():
            start, count = np.frombuffer(unpacked(row["runs"]), dtype=np.uint32).reshape(2, -1).astype(np.int64)
            text, last = unpacked(row["bytes"]), np.cumsum(count + LENGTH - 1)
            edges = [0, *last.tolist()]
            which = np.array([number.setdefault(text[a:b], len(number)) for a, b in zip(edges, edges[1:], strict=False)], dtype=np.int64)
            parts.append((row["shard"], np.cumsum(start), count, np.frombuffer(unpacked(row["ids"]), dtype=np.int64), which))
            new.append(len(number))
        smallest = np.full(len(number), LAST, dtype=np.int64)
        for _, _, _, ids, which in parts:
            np.minimum.at(smallest, which, ids)
        size = np.array([len(x) for x in number], dtype=np.int64)
        begin, many = np.cumsum(size) - size, size - LENGTH + 1
        data = np.frombuffer(b"".join(number), dtype=np.uint8)
        del number
        lists = [(places_of(begin[a:b], begin[a:b] + many[a:b]), np.repeat(smallest[a:b], many[a:b])) for a, b in zip(new, new[1:], strict=False) if a < b]
        least, at = np.concatenate(smallest_documents(lists, data)), np.cumsum(many) - many
        found = []
        for shard, start, count, ids, which in parts:
            smaller = least[places_of(at[which], at[which] + count)] < np.repeat(ids, count)
            if smaller.any():
                found.append((shard, intervals(np.sort(places_of(start, start + count)[smaller])).tobytes()))
        return pa.table({"shard": pa.array([x[0] for x in found], pa.int64()), "found": pa.array([x[1] for x in found], pa.binary()), "repeats": pa.nulls(len(found), pa.binary()), "pairs": pa.nulls(len(found), pa.binary())})

    return strings.groupBy("bucket").applyInArrow(run, schema)


# ---------------------------------------------------------------- the operator


def shards_of(docs: DataFrame, carried: list[str], shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """shard, ids, ends, blob, size and rows (the carried columns): documents in the order in which a task reads them."""
    kept = T.StructType([docs.schema[c] for c in carried])
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("blob", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("rows", T.ArrayType(kept))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, rows, size = TaskContext.get().partitionId() << 32, [], [], [], 0

        def whole() -> pa.RecordBatch:
            ends = np.cumsum([len(t) for t in texts])
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([packed(b"".join(texts), 6)], pa.binary()), pa.array([size], pa.int64()), pa.array([rows], pa.list_(row_type))], names=schema.names)

        row_type = None
        for batch in batches:
            row_type = batch.schema.field(2).type
            for i, text, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = text.encode()
                if texts and size + len(text) > shard_bytes:
                    yield whole()
                    number, ids, texts, rows, size = number + 1, [], [], [], 0
                ids.append(i)
                texts.append(text)
                rows.append(row)
                size += len(text)
        if texts:
            yield whole()

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text"), F.struct(*carried).alias("row")).mapInArrow(in_slices(run), schema)


def texts_and_spans(rows: pa.StructArray, texts: list[bytes], spans: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*rows.flatten(), pa.array(texts, pa.binary()), pa.array(spans, pa.list_(pa.list_(pa.int64())))], names=[*(f.name for f in rows.type), "bytes", "spans"])


def repeated_spans(docs: DataFrame, carried: list[str], schema: T.StructType | str | None = None, finish=texts_and_spans) -> DataFrame:
    """What ``finish`` makes of a shard's carried columns, whole texts as bytes, and removed runs as (start, end) bytes of each text; by itself these as columns, bytes and spans."""
    spark = docs.sparkSession
    schema = schema or T.StructType([*(docs.schema[c] for c in carried), T.StructField("bytes", T.BinaryType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))])
    table = written(shards_of(docs, carried), "shards")
    size = table.agg(F.sum("size")).first()[0] or 0
    buckets = lambda each, least: max(least * shuffle_partitions(spark), -(-size // each))
    name_buckets = buckets(NAME_BUCKET, 3)
    seen = shared_names(names_of(table, name_buckets))
    asked = table.drop("rows", "size").join(seen, "shard")
    told = written(answers(strings_of(asked, name_buckets, buckets(STRING_BUCKET, 5))), "answers")
    of_shard = told.groupBy("shard").agg(F.collect_list("found").alias("found"), F.max("repeats").alias("repeats"), F.max("pairs").alias("pairs"))
    joined = table.select("shard", "ends", "blob", "rows").join(of_shard, "shard", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in ("ends", "blob", "repeats", "pairs", "found")}
                blob, ends = unpacked(row["blob"].as_py()), np.asarray(row["ends"].as_py(), dtype=np.int64)
                marked = np.zeros(len(blob) + 1, dtype=bool)
                for packed in [row["repeats"].as_py() or b"", *(row["found"].as_py() or [])]:
                    marked[from_intervals(packed)] = True
                of, also = from_pair_runs(row["pairs"].as_py() or b"")
                marked[also[marked[of]]] = True
                places = intervals(np.flatnonzero(marked)).astype(np.int64)
                first, last = places[:, 0], places[:, 0] + places[:, 1] + LENGTH - 1
                # runs of places less than LENGTH apart, in one document, remove one span
                owner = np.searchsorted(ends, first, "right")
                apart = np.concatenate([[True], (first[1:] > last[:-1]) | (owner[1:] != owner[:-1])]) if len(first) else np.zeros(0, dtype=bool)
                at = np.flatnonzero(apart)
                first, last, owner = first[at], last[np.append(at[1:], len(last)) - 1] if len(at) else last, owner[at]
                starts = np.concatenate([[0], ends[:-1]])
                cuts = np.searchsorted(owner, np.arange(len(ends) + 1))
                spans = [np.stack([first[a:b] - s, last[a:b] - s], axis=1).tolist() for a, b, s in zip(cuts, cuts[1:], starts, strict=False)]
                texts = [blob[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield finish(batch.column("rows")[k].values, texts, spans)

    return joined.select("ends", "blob", "rows", "repeats", "pairs", "found").mapInArrow(in_slices(run, 4), schema)


def op1_suffix_array_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def digests(rows: pa.StructArray, texts: list[bytes], spans: list) -> pa.RecordBatch:
        out = []
        for data, cuts in zip(texts, spans, strict=True):
            edges = [0, *(x for cut in cuts for x in cut), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append((len(data), len(data) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest()))
        columns = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([rows.field("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return repeated_spans(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"], "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", digests)


def suffix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated spans, which shrink to whole characters here. A text that is removed whole goes; one that was empty before stays."""
    columns = [c for c in DOCUMENT_COLUMNS if c in docs.columns]
    carried = [c for c in columns if c != "text"]
    docs = docs.select(*columns)

    def cut(rows: pa.StructArray, texts: list[bytes], spans: list) -> pa.RecordBatch:
        out, stay = [], []
        for whole, runs, null in zip(texts, spans, rows.field("__null").to_pylist(), strict=True):
            parts, at = [], 0
            for a, b in runs:
                while a < b and whole[a] & 0xC0 == 0x80:  # the character before is not covered whole
                    a += 1
                while b > a and b < len(whole) and whole[b] & 0xC0 == 0x80:
                    b -= 1
                parts.append(whole[at:a])
                at = b
            text = b"".join([*parts, whole[at:]]).decode()
            stay.append(bool(text) or not whole)
            out.append(None if null else text)
        made = {"text": lambda: pa.array(out, pa.string()), "n_chars": lambda: pa.array([len(t or "") for t in out], pa.int64()).cast(rows.field("n_chars").type)}
        return pa.RecordBatch.from_arrays([made[c]() if c in made else rows.field(c) for c in columns], names=columns).filter(pa.array(stay, pa.bool_()))

    return repeated_spans(docs.withColumn("__null", F.col("text").isNull()), [*carried, "__null"], docs.schema, cut)
