"""Spelling variants: words one edit apart, the rarer one named by the far more frequent one.

A word's letters have a bit each, set if the word has an odd number of them. One inserted, deleted or replaced letter
flips at most two bits, so of three bands of the bits at least one stays as it is: words meet under an equal band, lengths
of at most one apart, and an equal half (an edit leaves what is before or what is behind it alone), and are verified by
edit distance. A pair is taken under the first band and half it has in common, so no pair comes twice.

Defined results: a null text has no words; a null doc_id is read as empty; runs are of the letters given by ``LETTERS``, so
combining marks and other scripts end a word; a letter's share of the runs goes missing by a checksum of document and run,
the same one for repeated runs and rows; words of any length take part; of near words with equal counts the first by code
point is the form; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, discarded, read, text_of, written

LETTERS = r"A-Za-zÀ-ÿ"
#: Fewest letters and occurrences of a word, how many times as frequent a form is, and which share of runs loses a letter.
SHORTEST, LEAST, TIMES, DAMAGED = 7, 2, 10, 31
BANDS = 3
#: Letters up to which the edit distance is taken of the words themselves.
USUAL = 64
#: Bits of a mask; letters are dealt to them in the order of their code points, and bits to bands in turn.
BITS = 62


def words(docs: DataFrame, shortest: int = SHORTEST, damaged: int = DAMAGED) -> DataFrame:
    """word, a row for each run that has ``shortest`` letters at least; one in ``damaged`` runs has lost one."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_of(), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))).alias("run"))
    lower = runs.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", ASCII_UPPER, ASCII_LOWER)).otherwise(F.col("run")).alias("run"))
    hashed = lower.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    gone = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), gone), F.substring(F.col("run"), gone + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % damaged == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= shortest)


def mask(word: Column) -> Column:
    """The parities of a word's letters, a bit for a letter (some of the rarer ones share one)."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(F.when(c == "", F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), (F.ascii(c) - ord("a") + 256) % BITS))))


def band(of: Column, number: int) -> Column:
    return of.bitwiseAND(F.lit(sum(1 << i for i in range(number, BITS, BANDS))))


def half(word: Column, least: Column, front: bool) -> Column:
    """The first or last half of the shorter length."""
    n = F.call_function("div", least, F.lit(2)).cast("int")
    return F.substring(word, F.lit(1), n) if front else F.substring(word, F.length(word) - n + 1, n)


def one_edit(a: Column, b: Column) -> Column:
    """Whether b, no shorter than a and other than it, is one edit away: in time linear in the words' length.

    Spark's edit distance is quick for words of a usual length, but takes the square of it; for longer ones the common
    beginning is found by halving steps, and what is behind the edit compared."""
    rest = lambda x, k: F.substring(x, k, F.length(x))
    # steps from the highest power of two below the length: each is taken if the beginnings are still equal
    steps = F.transform(F.sequence(F.floor(F.log2(F.length(a))).cast("int"), F.lit(0), F.lit(-1)), lambda e: F.call_function("shiftleft", F.lit(1), e))
    same = F.aggregate(steps, F.lit(0), lambda k, step: F.when((k + step <= F.length(a)) & (F.substring(a, F.lit(1), k + step) == F.substring(b, F.lit(1), k + step)), k + step).otherwise(k))
    behind = F.transform(F.array(same), lambda k: F.when(F.length(a) == F.length(b), rest(a, k + 2) == rest(b, k + 2)).otherwise((F.length(b) == F.length(a) + 1) & (rest(a, k + 1) == rest(b, k + 2))))[0]
    return F.when(F.length(a) <= USUAL, F.levenshtein(a, b, 1) == 1).otherwise(behind)


def pairs(counts: DataFrame) -> DataFrame:
    """a, a_n, b, b_n of the words (with their counts n) that are exactly one edit apart, each pair once."""
    known = counts.select("word", "n", F.length("word").alias("size"), mask(F.col("word")).alias("mask"))

    def keyed(side: str, longer: bool) -> DataFrame:
        """A row for each band and half, and on the right for each length that the shorter word may have."""
        least = F.explode(F.array(*([F.col("size"), F.col("size") - 1] if longer else [F.col("size")])))
        rows = known.withColumn("least", least)
        keys = [F.struct(F.lit(k).alias("band"), F.lit(front).alias("front"), F.xxhash64(F.lit(k), band(F.col("mask"), k), "least", F.lit(front), half(F.col("word"), F.col("least"), front)).alias("key")) for k in range(BANDS) for front in (True, False)]
        rows = rows.select("word", "n", "size", "mask", "least", F.explode(F.array(*keys)).alias("k"))
        return rows.select(*(F.col(c).alias(f"{side}_{c}") for c in ("word", "n", "size", "mask", "least")), F.col("k.key").alias(f"{side}_key"), *([F.col("k.band").alias("band"), F.col("k.front").alias("front")] if side == "a" else []))

    a, b = keyed("a", False), keyed("b", True)
    word, other = F.col("a_word"), F.col("b_word")
    flips = F.col("a_mask").bitwiseXOR(F.col("b_mask"))
    equal = [band(flips, k) == 0 for k in range(BANDS)]
    first_band = F.when(equal[0], 0).when(equal[1], 1).otherwise(2) == F.col("band")
    first_half = F.col("front") | (half(word, F.col("a_least"), True) != half(other, F.col("a_least"), True))
    once = (F.col("b_size") > F.col("a_size")) | (word < other)
    joined = a.join(b, (F.col("a_key") == F.col("b_key")) & (F.col("a_least") == F.col("b_least")) & once & (F.bit_count(flips) <= 2) & first_band & first_half & one_edit(word, other))
    return joined.select(word.alias("a"), F.col("a_n"), other.alias("b"), F.col("b_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of each word that has a form: where its forms lead, the way doubled until no word moves.

    A form has ``TIMES`` the count of its word, so ways are short."""
    ways = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = ways.select(F.col("word").alias("__word"), F.col("root").alias("__root"))
        following = written(ways.join(onward, F.col("root") == F.col("__word"), "left").select("word", F.coalesce("__root", "root").alias("root"), F.col("__root").isNotNull().alias("moved")), "forms")
        discarded(ways)
        if following.filter("moved").isEmpty():
            return following.select("word", "root")
        ways = written(following.select("word", "root"), "forms")
        discarded(following)


def variants(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near and form_n of each distinct word with at least ``least`` occurrences."""
    counts = written(words(docs).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least), "words")
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))))
    near = pairs(counts).select(both.alias("p")).select("p.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    fits = -F.col("best.less") >= times * F.col("n")
    found = written(counts.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")), "near")
    led = roots(found.filter("form IS NOT NULL"))
    return found.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir):
    return variants(read(spark, sf_dir, "documents").select("doc_id", "text"))


def sql() -> str:
    """The same for DuckDB: all pairs of words that begin or end alike, letters mapped to one byte each, since its edit distance counts bytes."""
    accented = "".join(chr(c) for c in range(0xC0, 0x100))
    plain = "".join(chr(c) for c in range(33, 127) if not chr(c).islower() and c not in (39, 92))[:64]
    return f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
run AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{ASCII_UPPER}', '{ASCII_LOWER}') AS run FROM documents),
often AS (SELECT id, run, count(*) AS n FROM run WHERE length(run) >= {SHORTEST} GROUP BY ALL),
hashed AS (SELECT run, n, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(id || ':' || run)), '..'), lambda h: CAST('0x' || h AS BIGINT)), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]), 4294967295), 4294967295) AS h FROM often, crc),
word AS MATERIALIZED (SELECT * FROM (SELECT CASE WHEN h % {DAMAGED} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM hashed GROUP BY 1) WHERE n >= {LEAST} AND length(word) >= {SHORTEST}),
plain AS MATERIALIZED (SELECT word, n, translate(word, '{accented}', '{plain.replace("'", "''")}') AS plain FROM word),
end_pair AS (SELECT a.word, b.word AS other, b.n FROM plain a JOIN plain b ON left(a.plain, 3) = left(b.plain, 3) AND length(b.plain) BETWEEN length(a.plain) - 1 AND length(a.plain) + 1 AND levenshtein(a.plain, b.plain) = 1
  UNION SELECT a.word, b.word, b.n FROM plain a JOIN plain b ON right(a.plain, 3) = right(b.plain, 3) AND length(b.plain) BETWEEN length(a.plain) - 1 AND length(a.plain) + 1 AND levenshtein(a.plain, b.plain) = 1),
near AS (SELECT word, count(*) AS n_near, max(n) AS near_n, arg_min(other, struct_pack(less := -n, word := other)) AS near FROM end_pair GROUP BY word),
form AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {TIMES} * n THEN near END AS form, CASE WHEN near_n >= {TIMES} * n THEN near_n END AS form_n FROM word LEFT JOIN near USING (word)),
way(word, led) AS (SELECT word, word FROM form UNION ALL SELECT way.word, form.form FROM way JOIN form ON way.led = form.word WHERE form.form IS NOT NULL)
SELECT f.word, f.form, w.led AS root, f.n, f.n_near, f.form_n FROM form f JOIN way w USING (word) JOIN form l ON w.led = l.word WHERE l.form IS NULL
"""
