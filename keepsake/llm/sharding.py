"""Sharding by a keyed permutation of row numbers, in DataFrame functions only.

Rows get global numbers in the order of given keys. A Feistel network over two mixed digits (of about the square root of
the number of rows each) permutes the numbers; values past the last row are walked along their cycle until they fall below
it, so the permutation is one of exactly the rows there are. Position p goes to shard p mod shards, slot p div shards:
counts of shards differ by one at most, slots have no gaps, and both ways are computable - ``position`` from a number,
``number_at`` from a shard and slot, without a table.

Defined results: a null key comes last; a null text has no bytes, its checksum is 0; rows equal in all order columns are
interchangeable and take one number each (equal texts are spread, not kept together: they may be a third of all rows, and
counts at most one apart leave no room for that); an empty table gives an empty result; ``sharded`` replaces columns
of the names it adds, the query ignores further columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read, text_of, written

SHARDS, SEED, ROUNDS = 24, 42, 6
#: Steps along a cycle. Up to 4,096 rows no walk is longer; beyond, all steps fail once in 64 ** 64 rows, and then raise.
WALK = 64


def digits(n: int) -> tuple[int, int]:
    """Sizes a and b of the two digits: a * b is at least n, and less than n + a."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def quotient(value: Column, by: int) -> Column:
    """Whole-number division of what isn't negative, by way of no double."""
    return F.call_function("div", value, F.lit(by).cast("long"))


def round_value(seed: int, round_number: Column, digit: Column) -> Column:
    """60 bits that depend on seed, round and digit."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), round_number.cast("string"), digit.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")


def network(value: Column, n: int, seed: int, back: bool = False) -> Column:
    """One pass of the rounds over 0 to a * b - 1: even rounds move the first digit, odd ones the second."""
    a, b = digits(n)
    rounds = F.array(*(F.lit(r) for r in (reversed(range(ROUNDS)) if back else range(ROUNDS))))
    moved = lambda x, i, other, size: F.pmod(x + (-1 if back else 1) * F.pmod(round_value(seed, i, other), F.lit(size)), F.lit(size))

    def one(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, moved(s["x"], i, s["y"], a)).otherwise(s["x"]).alias("x"), F.when(even, s["y"]).otherwise(moved(s["y"], i, s["x"], b)).alias("y"))

    start = F.struct(quotient(value, b).alias("x"), (value % F.lit(b)).cast("long").alias("y"))
    return F.aggregate(rounds, start, one, lambda s: s["x"] * F.lit(b) + s["y"])


def walked(value: Column, n: int, seed: int, back: bool) -> Column:
    """The first value below n along the cycle."""
    a, b = digits(n)
    steps = min(WALK, a * b - n)
    first = network(value.cast("long"), n, seed, back)
    if not steps:
        return first
    last = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, lambda v, _: F.when(v < n, v).otherwise(network(v, n, seed, back)))
    return last if steps < WALK else F.transform(F.array(last), lambda v: F.when(v < n, v).otherwise(F.raise_error(F.lit("a walk of the permutation is too long: take another seed")).cast("long")))[0]


def position(number: Column, n: int, seed: int = SEED) -> Column:
    """Where row ``number`` of n stands in the shuffled order."""
    return walked(number, n, seed, False)


def number_at(shard: Column, slot: Column, n: int, shards: int = SHARDS, seed: int = SEED) -> Column:
    """The row number that stands in a slot of a shard."""
    return walked(slot * F.lit(shards).cast("long") + shard, n, seed, True)


def numbered_rows(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``row_number`` from 0 in the order of ``order``, nulls last; rows equal in it in any order.

    Ranges of rows are sorted by themselves; the sum of the ranges before it is added to a row's place in its range. A
    row's place in the table breaks ties between equal rows, so that a range can end among them. Only a row for each
    range is ordered in one task."""
    kept = written(rows, "rows")
    names = [c for c in rows.columns if c != "row_number"]
    keyed = kept.select(*names, *(x for i, c in enumerate(order) for x in (F.col(c).isNull().alias(f"__null{i}"), F.col(c).alias(f"__key{i}"))), F.monotonically_increasing_id().alias("__tie"))
    keys = [c for i in range(len(order)) for c in (f"__null{i}", f"__key{i}")] + ["__tie"]
    ranges = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = written(ranges.select(*names, F.spark_partition_id().alias("__range"), F.monotonically_increasing_id().bitwiseAND(2**33 - 1).alias("__place")), "ranges")
    before = F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = placed.groupBy("__range").count().select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    return placed.join(offsets, "__range").withColumn("row_number", F.col("__before") + F.col("__place")).select(*names, "row_number")


def sharded(rows: DataFrame, order: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``rows`` with row_number, shard and slot."""
    numbers = numbered_rows(rows.drop("shard", "slot"), order)
    return numbers.withColumn("__at", position(F.col("row_number"), rows.count(), seed)).withColumns({"shard": (F.col("__at") % shards).cast("int"), "slot": quotient(F.col("__at"), shards)}).drop("__at")


def op11_feistel_sharding(spark, sf_dir):
    text = text_of().cast("binary")
    rows = read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharded(rows, ["doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sql() -> str:
    """The same for DuckDB: checksums byte by byte, the walk as a recursive query."""
    value = lambda r, digit: f"CAST('0x' || substr(md5('{SEED}:{r}:' || {digit}), 1, 15) AS BIGINT)"
    step = "SELECT number, v // b AS x, v % b AS y, a, b, n FROM walk WHERE first OR v >= n"
    for r in range(ROUNDS):
        step = f"SELECT number, {f'(x + {value(r, 'y')} % a) % a AS x, y' if r % 2 == 0 else f'x, (y + {value(r, 'x')} % b) % b AS y'}, a, b, n FROM ({step})"
    return f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
digest AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
    CASE WHEN coalesce(text, '') = '' THEN 0 ELSE xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT)), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]), 4294967295), 4294967295) END AS text_crc32
  FROM documents, crc),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST, size, text_crc32) - 1 AS number FROM digest),
domain AS (SELECT n, a, CAST(greatest(1, ceil(n / a)) AS BIGINT) AS b FROM (SELECT n, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 AS a FROM (SELECT count(*) AS n FROM documents) WHERE n > 0)),
walk(number, v, a, b, n, first) AS (SELECT number, number, a, b, n, true FROM numbered, domain
  UNION ALL SELECT number, x * b + y, a, b, n, false FROM ({step}))
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(v % {SHARDS} AS INTEGER) AS shard, v // {SHARDS} AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM numbered JOIN walk USING (number) WHERE NOT first AND v < n
"""
