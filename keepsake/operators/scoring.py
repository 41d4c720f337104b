"""Relevance of candidates, and which of them go into a context."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decay
from ..functions.numbers import r4, unit
from ..functions.query import MAIN_ASKED, PROBLEM_ASKED, RESULTS_ASKED
from ..operators.search import term_hits
from ..schema import MAX_MEMORIES, MIN_RELEVANCE, SEMANTIC_FLOOR, SOURCE_SHARE, TEXT_RESCUE, WEIGHTS

#: Names of memories that sum a document up, and names that say nothing.
OVERVIEW_NAMES = ("overview", "summary", "introduction", "abstract", "preface")
GENERIC_NAMES = ("introduction", "conclusion", "summary", "overview", "background", "related work", "methodology", "discussion", "references", "acknowledgments")


def semantic(vector: Column, text: Column, graph: Column, preferred: Column) -> Column:
    raw = 0.5 * unit(vector) + 0.3 * unit(text) + 0.2 * unit(graph)
    return unit(F.when(preferred, raw * 1.15).otherwise(raw))


def importance_boost(importance: Column, kind: Column, whole: Column, results: Column, problem: Column) -> Column:
    return F.when(whole & (importance >= 9), 0.35).when(whole & (importance >= 8), 0.25).when(whole & (importance >= 7), 0.15).when(results & (kind == "fact") & (importance >= 8), 0.2).when(problem & (kind == "problem") & (importance >= 8), 0.2).when(importance >= 9, 0.1).otherwise(0.0)


def significance_boost(significance: Column) -> Column:
    n = F.length(F.coalesce(significance, F.lit("")))
    return F.when(n > 100, 0.05).when(n > 50, 0.03).when(n > 0, 0.01).otherwise(0.0)


def overview_boost(name: Column, importance: Column, whole: Column) -> Column:
    is_overview = reduce(Column.__or__, (F.contains(F.lower(name), F.lit(w)) for w in OVERVIEW_NAMES))
    return F.when(whole & is_overview & (importance >= 8), 0.3).when(whole & is_overview, 0.15).otherwise(0.0)


def target_boost(hits: Column) -> Column:
    return F.when(hits >= 6, 0.15).when(hits >= 4, 0.1).when(hits >= 2, 0.05).otherwise(0.0)


def generic_penalty(name: Column, kind: Column, importance: Column, definition: Column) -> Column:
    return F.when(F.lower(name).isin(*GENERIC_NAMES), 0.05).when((kind == "fact") & (importance <= 3) & (F.length(F.coalesce(definition, F.lit(""))) < 30), 0.03).otherwise(0.0)


def raw_relevance(candidates: DataFrame, as_of: datetime) -> DataFrame:
    """Adds semantic, recency and raw. Candidates carry their question: question_id, key_terms, expanded_terms, preferred_types, is_abstract, document_scoped, current_document."""
    asked = F.array_join("key_terms", " ")
    whole = F.col("is_abstract") | asked.rlike(MAIN_ASKED)
    hours = (F.unix_micros(F.lit(as_of)) - F.unix_micros("last_accessed")) / 3_600_000_000.0
    out = candidates.withColumn("semantic", semantic(F.col("vector_score"), F.col("text_score"), F.col("graph_score"), F.array_contains("preferred_types", F.col("concept_type")))).withColumn("recency", decay.recency(hours))
    connected = unit(F.col("connectivity") + F.when(F.col("to_current"), 0.1).otherwise(0.0) + F.when(F.col("to_recent"), 0.05).otherwise(0.0))
    base = WEIGHTS["semantic"] * F.col("semantic") + WEIGHTS["strength"] * unit(F.col("current")) + WEIGHTS["recency"] * F.col("recency") + WEIGHTS["connectivity"] * connected
    hits = term_hits(F.col("canonical"), F.col("definition"), F.concat("key_terms", "expanded_terms"))
    affinity = F.when(F.col("document_scoped") & F.coalesce(F.col("document_id") == F.col("current_document"), F.lit(False)), 0.1).otherwise(0.0)
    boosts = importance_boost(F.col("importance"), F.col("concept_type"), whole, asked.rlike(RESULTS_ASKED), asked.rlike(PROBLEM_ASKED)) + significance_boost(F.col("significance")) + overview_boost(F.col("canonical"), F.col("importance"), whole) + affinity + target_boost(hits)
    return out.withColumn("raw", base + boosts - generic_penalty(F.col("canonical"), F.col("concept_type"), F.col("importance"), F.col("definition")))


def softmax_ranked(scored: DataFrame, per: str = "question_id", key: str = "bucket_id", most: int | None = MAX_MEMORIES) -> DataFrame:
    """relevance (four decimals) and rank within each question: a softmax over the raw scores' range, even where the range is nothing.

    A question's candidates are bounded (80), so a window over them is small."""
    whole = Window.partitionBy(per)
    top, spread = F.max("raw").over(whole), F.max("raw").over(whole) - F.min("raw").over(whole)
    out = scored.withColumn("__spread", spread).withColumn("__exp", F.exp((F.col("raw") - top) / F.greatest(spread, F.lit(0.1))))
    share = F.when(F.col("__spread") < 0.001, 1.0 / F.count(F.lit(1)).over(whole)).otherwise(F.col("__exp") / F.sum("__exp").over(whole))
    rank = F.row_number().over(Window.partitionBy(per).orderBy(F.desc(F.round("raw", 9)), key))
    out = out.withColumn("relevance", r4(share)).withColumn("rank", rank).drop("__spread", "__exp")
    return out.filter(F.col("rank") <= most) if most else out


def evidence_gate(ranked: DataFrame) -> DataFrame:
    """Keeps the questions that may get a context at all: no small talk, and a broad or abstract question or some direct evidence."""
    whole = Window.partitionBy("question_id")
    direct = (F.max("semantic").over(whole) >= SEMANTIC_FLOOR) | (F.max("text_score").over(whole) >= TEXT_RESCUE)
    broad = F.col("intent").isin("recall", "explore", "summarize") & (F.col("specificity") < 0.4)
    return ranked.withColumn("__direct", direct).filter(~F.col("is_chitchat") & (broad | F.col("is_abstract") | F.col("__direct"))).drop("__direct")


def budget_of(specificity: Column, candidates: Column, most: int = MAX_MEMORIES) -> Column:
    asked = F.when(specificity > 0.8, -(-most * 6 // 10)).when(specificity > 0.5, -(-most * 8 // 10)).otherwise(most)
    return F.when(candidates == 0, 0).otherwise(F.greatest(F.lit(1), F.least(asked, candidates))).cast("int")


def within_budget(ranked: DataFrame, per: str = "question_id", share: float = SOURCE_SHARE, least: float = MIN_RELEVANCE, carry: tuple[str, ...] = ()) -> DataFrame:
    """Greedy choice in order of relevance: too little relevance is passed over, and so is a source that has its share once three are chosen. If all chosen are of one type, the last gives way to the best of another type that was left.

    The candidates of a question (80 at most) are folded in one array expression; columns of ``carry`` go along."""
    item = F.struct(F.col("relevance"), F.col("bucket_id"), F.col("concept_type"), F.coalesce("source", F.lit("unknown")).alias("source"), *carry)
    grouped = ranked.groupBy(per, "budget").agg(F.array_sort(F.collect_list(item), lambda a, b: F.when(a["relevance"] > b["relevance"], -1).when(a["relevance"] < b["relevance"], 1).when(a["bucket_id"] < b["bucket_id"], -1).otherwise(1)).alias("items"))
    kind = grouped.schema["items"].dataType
    limit = F.ceil(F.col("budget") * share)

    def step(chosen: Column, x: Column) -> Column:
        of_source = F.size(F.filter(chosen, lambda c: c["source"] == x["source"]))
        skip = (F.size(chosen) >= F.col("budget")) | (x["relevance"] < least) | ((of_source >= limit) & (F.size(chosen) > 2))
        return F.when(skip, chosen).otherwise(F.concat(chosen, F.array(x)))

    chosen = grouped.withColumn("chosen", F.aggregate("items", F.array().cast(kind), step))
    kinds = F.array_distinct(F.transform("chosen", lambda c: c["concept_type"]))
    others = F.filter("items", lambda x: (x["concept_type"] != F.col("chosen")[0]["concept_type"]) & ~F.exists("chosen", lambda c: c["bucket_id"] == x["bucket_id"]))
    swapped = F.concat(F.slice("chosen", F.lit(1), F.size("chosen") - 1), F.slice(others, 1, 1))
    final = F.when((F.size(kinds) < 2) & (F.size("chosen") >= 2) & (F.size(others) > 0), swapped).otherwise(F.col("chosen"))
    return chosen.select(per, "budget", F.explode(final).alias("c")).select(per, "budget", "c.*")


def source_capped(ranked: DataFrame, budget: int, per: str = "question_id", share: float = SOURCE_SHARE) -> DataFrame:
    """First at most floor(budget * share) of each source in order of rank, then those deferred, up to the budget."""
    most = max(1, int(budget * share))
    source = F.coalesce("source", F.lit("unknown"))
    small = F.count(F.lit(1)).over(Window.partitionBy(per)) <= 2
    out = ranked.withColumn("__nth", F.row_number().over(Window.partitionBy(per, source).orderBy("rank"))).withColumn("__late", F.when(small, False).otherwise(F.col("__nth") > most))
    return out.withColumn("position", F.row_number().over(Window.partitionBy(per).orderBy("__late", "rank"))).filter(F.col("position") <= budget).drop("__nth", "__late")


#: Order of types in a serverless context.
TYPE_ORDER = ("decision", "problem", "fact", "code", "entity", "event", "preference")


def type_order(kind: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for i, k in enumerate(TYPE_ORDER) for x in (k, i)))[kind], F.lit(len(TYPE_ORDER)))


def context_line(rank: Column, kind: Column, label: Column, definition: Column, strength: Column, source: Column, connection: Column, to_current: Column, connected: Column) -> Column:
    """(1) [TYPE] label: definition [strength: 80%] [source: ..] [connection: 0.50] [linked to current document] [connected: ..]"""
    return F.concat_ws(
        " ",
        F.concat(F.lit("("), rank.cast("string"), F.lit(") ["), F.upper(kind), F.lit("] "), label, F.lit(": "), definition, F.lit(" [strength: "), F.floor(strength * 100 + 0.5).cast("string"), F.lit("%]")),
        F.when(F.length(source) > 0, F.concat(F.lit("[source: "), source, F.lit("]"))),
        F.when(connection > 0, F.concat(F.lit("[connection: "), F.format_string("%.2f", connection), F.lit("]"))),
        F.when(to_current, "[linked to current document]"),
        F.when(F.size(connected) > 0, F.concat(F.lit("[connected: "), F.array_join(F.slice(connected, 1, 3), ", "), F.lit("]"))),
    )


def context_block(lines: DataFrame, per: str = "question_id") -> DataFrame:
    """A question's lines in order of rank between a head and a foot."""
    body = F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"])
    head, foot = "=== RETRIEVED MEMORIES FROM THE USER'S KNOWLEDGE BASE ===", "=== END OF CANDIDATE MEMORIES ==="
    return lines.groupBy(per).agg(F.concat_ws("\n", F.lit(head), F.lit(""), F.array_join(body, "\n"), F.lit(""), F.lit(foot)).alias("context"), F.count(F.lit(1)).alias("memories"))


def additive_scores(vector_hits: DataFrame, term_hits_: DataFrame, terms: int, least: float = 0.3) -> DataFrame:
    """Serverless retrieval: similarity above ``least`` plus, for each term that hits, 1 - i / (2 n); term hits have term_place from 0."""
    a = vector_hits.filter(F.col("similarity") > least).select("bucket_id", F.col("similarity").alias("points"))
    b = term_hits_.select("bucket_id", (1 - 0.5 * F.col("term_place") / terms).alias("points"))
    return a.unionByName(b).groupBy("bucket_id").agg(F.sum("points").alias("score"))


def title_match(documents: DataFrame, question: str) -> DataFrame:
    """The document that a question names: score by name, stem and words of the name; the best if it leads by more than 1, else none."""
    low = question.lower()
    words = F.array(*map(F.lit, sorted({w for w in "".join(c if c.isalnum() else " " for c in low).split() if len(w) >= 3}))) if low.strip() else F.array().cast("array<string>")
    name = F.lower("filename")
    base = F.trim(F.regexp_replace(F.regexp_replace(name, r"\.[^.]+$", ""), r"[_.\-]+", " "))
    tight = F.replace(base, F.lit(" "), F.lit(""))
    generic = ("document", "paper", "file", "pdf", "text", "doc", "docx", "book", "report", "article", "notes")
    of_words = F.aggregate(F.array_intersect(F.array_distinct(F.split(base, " +")), words), F.lit(0.0), lambda n, w: n + F.when(w.isin(*generic), 0.5).when(F.length(w) >= 5, 3.0).otherwise(2.0))
    inside = lambda x: F.contains(F.lit(low), x)
    score = F.when(inside(name), 8.0).otherwise(0.0) + F.when(inside(base), 6.0).otherwise(0.0) + F.when((F.length(tight) > 5) & F.contains(F.lit("".join(low.split())), tight), 5.0).otherwise(0.0) + of_words
    best = documents.withColumn("score", score).filter(F.col("score") >= 2.5).orderBy(F.desc("score"), F.length("filename"), "document_id").limit(2)
    second = F.lead("score").over(Window.orderBy(F.desc("score"), F.length("filename"), "document_id"))  # over two rows
    return best.withColumn("second", second).withColumn("n", F.row_number().over(Window.orderBy(F.desc("score"), F.length("filename"), "document_id"))).filter((F.col("n") == 1) & (F.col("second").isNull() | (F.col("second") < F.col("score") - 1))).select("document_id", "filename", "score")


def available(ranked: DataFrame, chosen: DataFrame, most: int = 8) -> DataFrame:
    """What was found for a question but not chosen, the best first."""
    rest = ranked.join(chosen.select("question_id", "bucket_id"), ["question_id", "bucket_id"], "left_anti")
    return rest.withColumn("n", F.row_number().over(Window.partitionBy("question_id").orderBy("rank"))).filter(F.col("n") <= most)


def serverless_selection(ranked: DataFrame, budget: int) -> DataFrame:
    """Sources held to their share, then by type and relevance."""
    kept = source_capped(ranked, budget)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy(type_order(F.col("concept_type")), "rank")))
