"""Document fingerprints: bottom-k sketches of hashed word shingles, in DataFrame functions only.

A sketch is the ``k`` smallest distinct 64-bit hashes of a text's shingles of five words, in rising order. Sketches of
parts merge into the sketch of the whole (the k smallest of their union); from two sketches follow estimates of
resemblance and containment, from one the number of distinct shingles. A fingerprint is the sketch as 16 hex digits a hash.

Defined results: words are runs of anything but ASCII white space; a text of fewer words than a shingle is one shingle;
a text without words has an empty sketch, which is fully like another empty one and not like any other; null is empty.
Rows are ordered by doc_id, a null one last; equal ids by a hash of the text, so repeated rows follow one another; a table
of one row is followed by itself. An empty table gives an empty result; further columns are ignored. A fingerprint of a
text depends on that text alone.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written

SHINGLE_WORDS, K = 5, 128
#: Distinct rows a bucket of neighbours holds, buckets at most, keys sampled for each of their bounds, and equal rows that are kept as one.
ROWS_A_BUCKET, BUCKETS, SAMPLED, COPIES = 4096, 16384, 16, 1024
KEY = ("without", "id", "hash")


def sketch(text: Column, k: int = K, words: int = SHINGLE_WORDS) -> Column:
    """The k smallest distinct shingle hashes in rising order."""
    every = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(F.array(every), lambda ws: F.when(F.size(ws) == 0, F.array().cast("array<bigint>")).when(F.size(ws) <= words, F.array(F.xxhash64(ws))).otherwise(smallest(F.transform(F.sequence(F.lit(1), F.size(ws) - (words - 1)), lambda i: F.xxhash64(F.slice(ws, i, words))), k)))[0]


def smallest(hashes: Column, k: int = K) -> Column:
    return F.slice(F.array_distinct(F.sort_array(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together; only exact where a shingle doesn't run across them."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among those of either text."""
    union = merged(a, b, k)
    common = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(common / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below k, else (k - 1) over the k-th smallest hash as a share of the hash range."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    j = resemblance(a, b, k)
    both = j / (1 + j) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def as_string(a: Column) -> Column:
    """16 lowercase hex digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def in_order_with_next(docs: DataFrame, rows_a_bucket: int = ROWS_A_BUCKET, most: int = COPIES) -> DataFrame:
    """doc_id, text, copies, bucket, extra and place: by bucket, rows in the order of (extra, place) are followed by their next, after the last the first.

    The order is that of (null, id, hash of the text). Rows are dealt to ranges of it whose number grows with the table,
    up to ``BUCKETS``; their bounds come from a sample of keys, which balances them and changes no result, and are found by
    binary search. The first row of a range is also sent to the range before it, as what follows its last row. More than
    ``most`` equal rows go on as one with its number of copies."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).select("doc_id", "text", F.col("doc_id").isNull().cast("int").alias("without"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.xxhash64("text").alias("hash"))
    keys = written(rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies")), "keys")
    count = keys.count()
    hot = keys.filter(F.col("copies") > most)
    rows = rows.withColumn("copies", F.lit(1).cast("long"))
    if not hot.isEmpty():
        several = rows.drop("copies").join(hot, list(KEY)).groupBy(*KEY).agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("copies").alias("copies"))
        rows = rows.join(hot, list(KEY), "left_anti").unionByName(several)
    buckets = min(BUCKETS, -(-count // rows_a_bucket))
    sample = keys.sample(min(1.0, SAMPLED * buckets / count), 42).select(*KEY).collect() if buckets > 1 else []
    bounds = sorted(set(map(tuple, sample)))[SAMPLED::SAMPLED]
    held = F.from_json(F.lit(json.dumps([dict(zip(KEY, b, strict=True)) for b in bounds])), "array<struct<without:int,id:bigint,hash:bigint>>")  # one constant
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))))
    at_or_below = lambda key: F.aggregate(steps, F.lit(0), lambda found, step: F.when(F.get(held, found + step - 1) <= key, found + step).otherwise(found))
    bucket = F.transform(F.array(F.struct(*KEY)), at_or_below)[0] if bounds else F.lit(0)
    firsts = keys.withColumn("bucket", bucket).groupBy("bucket").agg(F.min(F.struct(*KEY)).alias("first"))
    by_bucket = Window.orderBy("bucket")  # of a row a bucket
    before = firsts.select("first.*", F.coalesce(F.lag("bucket").over(by_bucket), F.max("bucket").over(Window.partitionBy())).alias("before"))
    dealt = rows.withColumn("own", bucket).join(F.broadcast(before), list(KEY), "left")  # BUCKETS rows at most
    places = F.array_compact(F.array(F.struct(F.col("own").alias("bucket"), F.lit(0).alias("extra")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("extra")))))
    return dealt.select("doc_id", "text", "copies", F.struct(*KEY).alias("place"), F.explode(places).alias("of")).select("doc_id", "text", "copies", "place", "of.*")


def edited(text: Column, following: Column) -> Column:
    """The last quarter of the code points replaced by as many of the next text's first, or all it has."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - quarter), F.substring(following, F.lit(1), quarter))


def compared(docs: DataFrame, rows_a_bucket: int = ROWS_A_BUCKET, most: int = COPIES) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to that and to the next document."""
    text, own, changed = F.col("text"), F.col("own"), F.col("changed")
    window = Window.partitionBy("bucket").orderBy("extra", "place")
    rows = in_order_with_next(docs, rows_a_bucket, most).withColumn("next_text", F.lead("text").over(window))
    rows = rows.withColumn("edited", F.when(F.col("extra") == 0, edited(text, F.col("next_text")))).withColumn("self_edited", F.when((F.col("extra") == 0) & (F.col("copies") > 1), edited(text, text)))
    rows = rows.select(
        "doc_id", "bucket", "extra", "place", "copies", F.length("text").cast("long").alias("n_chars"), sketch(text).alias("own"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("sha"), F.when(F.col("edited").isNotNull(), sketch(F.col("edited"))).alias("changed"),
        F.sha2(F.col("self_edited").cast("binary"), 256).alias("self_sha"), F.when(F.col("self_edited").isNotNull(), sketch(F.col("self_edited"))).alias("self_changed"),
    )
    rows = rows.withColumn("next_own", F.lead("own").over(window)).filter(F.col("extra") == 0)
    each = rows.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("nth"))  # all but the last of equal rows are followed by one like them
    like = F.col("nth") < F.col("copies")
    each = each.select("doc_id", "n_chars", "own", F.when(like, F.col("self_sha")).otherwise(F.col("sha")).alias("edited_sha256"), F.when(like, F.col("self_changed")).otherwise(changed).alias("changed"), F.when(like, own).otherwise(F.col("next_own")).alias("next_own"))
    return each.select(
        "doc_id", "n_chars", "edited_sha256", as_string(own).alias("fingerprint"), as_string(changed).alias("edited_fingerprint"), resemblance(own, changed).alias("near_edited"), resemblance(own, F.col("next_own")).alias("near_next"),
        containment(own, changed).alias("contained_in_edited"), distinct_shingles(own).alias("shingles"),
    )


def op7_document_fingerprints(spark, sf_dir):
    return compared(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
