"""Retrieval: from questions with their vectors to a context block, as one lazy plan.

A question is few rows and the archive is many, so questions travel to the archive: candidates of each kind are found by
one pass over a table for all questions, reduced to the best of each question, and only then joined with names,
evidence and edges. Nothing runs before the result is asked for."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..adapters import Tables
from ..functions import decay
from ..functions.numbers import unit
from ..functions.query import analysed, search_terms
from ..functions.vector import cosine, valid
from ..operators import graph, scoring
from ..schema import CANDIDATES, HIGH_IMPORTANCE, MAX_MEMORIES, NEIGHBOURS, SEEDS

#: Questions that may be broadcast to the archive; more are asked in several calls.
QUESTIONS = 1000


def held(questions: DataFrame, most: int = QUESTIONS) -> DataFrame:
    """user_id and the question as one value, marked for broadcast: whoever asks for it gets the same exchange. More than ``most`` questions raise an error when the plan runs."""
    counted = F.count(F.lit(1)).over(Window.partitionBy())  # a question is a row; they are few, or refused
    checked = F.when(counted <= most, F.col("user_id")).otherwise(F.raise_error(F.lit(f"more than {most} questions in one call")).cast("long"))
    return F.broadcast(questions.select(checked.alias("user_id"), F.struct(*questions.columns).alias("q")))


def best(df: DataFrame, score: str, most: int) -> DataFrame:
    w = Window.partitionBy("question_id").orderBy(F.desc(F.round(score, 9)), "bucket_id")
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most).drop("__n")


def terms_of(q: Column) -> Column:
    return search_terms(F.concat(q["key_terms"], q["expanded_terms"]))


def direct_hits(t: Tables, questions: DataFrame, least: float = 0.15, most: int = CANDIDATES) -> DataFrame:
    """question_id, bucket_id, vector_score, text_score: the most similar memories and those that a term occurs in, of the question's tenant. ``questions`` are ``held``.

    A tenant's questions travel as one list, so that a text is read once for all of them."""
    memories = t.buckets.select("bucket_id", "user_id", "canonical", (F.col("importance") + F.col("strength")).alias("weight"))
    vectors = memories.join(t.embeddings.filter(valid(F.col("embedding"))), "bucket_id").join(questions, "user_id")
    near = vectors.select(F.col("q.question_id").alias("question_id"), "bucket_id", cosine(F.col("embedding"), F.col("q.vector")).alias("vector_score")).filter(F.col("vector_score") >= least)
    lists = F.broadcast(questions.groupBy("user_id").agg(F.collect_list(F.struct(F.col("q.question_id").alias("question_id"), terms_of(F.col("q")).alias("terms"))).alias("asked")))
    names = memories.select("bucket_id", "user_id", "weight", F.lower("canonical").alias("told"))
    items = t.items.select("bucket_id", F.lower(F.concat_ws(" ", "label", "definition")).alias("told"))
    evidence = graph.dealt(items, t.parts, "bucket_id").join(memories.drop("canonical"), "bucket_id").select("bucket_id", "user_id", "weight", "told")
    found = names.unionByName(evidence).join(lists, "user_id")
    textual = found.select("bucket_id", "weight", F.explode(F.filter("asked", lambda a: F.exists(a["terms"], lambda x: F.contains("told", x)))).alias("a")).select("a.question_id", "bucket_id", "weight").distinct()
    a = best(near, "vector_score", most).select("question_id", "bucket_id", "vector_score", F.lit(0.0).alias("text_score"))
    b = best(textual, "weight", most).select("question_id", "bucket_id", F.lit(0.0).alias("vector_score"), F.lit(1.0).alias("text_score"))
    return a.unionByName(b).groupBy("question_id", "bucket_id").agg(F.max("vector_score").alias("vector_score"), F.max("text_score").alias("text_score"))


def with_neighbours(edges: DataFrame, direct: DataFrame, seeds: int = SEEDS, most: int = NEIGHBOURS) -> DataFrame:
    """The direct hits, and with a number of ``hits`` the neighbours of the best of them that are no seeds themselves: the most confident ones.

    Each seed is joined to its edges, and a row gives both ends; a memory that is reached in both ways becomes one row."""
    order = Window.partitionBy("question_id").orderBy(F.desc(F.round(F.col("vector_score") + 0.2 * F.col("text_score"), 9)), "bucket_id")
    marked = direct.withColumn("seed", F.row_number().over(order) <= seeds)
    halves = graph.halves(edges).select(F.col("bucket_id").alias("__from"), "other_id", "confidence")
    joined = marked.join(halves, (F.col("bucket_id") == F.col("__from")) & F.col("seed"), "left")
    own = F.struct(F.col("bucket_id"), F.col("vector_score"), F.col("text_score"), F.col("seed"), F.lit(True).alias("direct"), F.lit(0).cast("long").alias("hits"), F.lit(None).cast("double").alias("confidence"))
    other = F.struct(F.col("other_id").alias("bucket_id"), F.lit(0.0).alias("vector_score"), F.lit(0.0).alias("text_score"), F.lit(False).alias("seed"), F.lit(False).alias("direct"), F.lit(1).cast("long").alias("hits"), F.col("confidence"))
    ends = joined.select("question_id", F.explode(F.filter(F.array(own, other), lambda x: x["bucket_id"].isNotNull())).alias("x")).select("question_id", "x.*")
    merged = ends.groupBy("question_id", "bucket_id").agg(*(F.max(c).alias(c) for c in ("vector_score", "text_score", "seed", "direct", "confidence")), F.sum("hits").alias("hits"))
    near = (F.col("hits") > 0) & ~F.col("seed")
    place = F.row_number().over(Window.partitionBy("question_id", near).orderBy(F.desc(F.round("confidence", 9)), "bucket_id"))
    kept = merged.withColumn("hits", F.when(near & (place <= most), F.col("hits")).otherwise(F.lit(0).cast("long")))
    return kept.filter(F.col("direct") | (F.col("hits") > 0)).select("question_id", "bucket_id", "vector_score", "text_score", "hits")


def fallback_hits(t: Tables, questions: DataFrame, most: int = HIGH_IMPORTANCE) -> DataFrame:
    """The most important memories of the tenant, for questions about a whole. ``questions`` are ``held``."""
    rows = t.buckets.filter("importance >= 8").select("bucket_id", "user_id", (F.col("importance") + F.col("strength")).alias("weight")).join(questions, "user_id").filter("q.is_abstract")
    return best(rows.select(F.col("q.question_id").alias("question_id"), "bucket_id", "weight"), "weight", most).select("question_id", "bucket_id")


def candidates(t: Tables, questions: DataFrame, as_of: datetime) -> DataFrame:
    """The best 80 of each question with all that scoring asks for. ``questions``: analysed.

    One chain: what is found is joined to its memory, its question, its evidence and its edges one after another, so that no part of the plan runs twice."""
    own = held(questions)
    zero, none = F.lit(0.0), F.lit(0).cast("long")
    found = with_neighbours(t.edges, direct_hits(t, own)).unionByName(fallback_hits(t, own).select("question_id", "bucket_id", zero.alias("vector_score"), zero.alias("text_score"), none.alias("hits")))
    merged = found.groupBy("question_id", "bucket_id").agg(F.max("vector_score").alias("vector_score"), F.max("text_score").alias("text_score"), F.sum("hits").alias("hits"))
    first = best(merged.withColumn("__p", F.col("vector_score") + 0.25 * F.col("text_score") + 0.05 * F.col("hits")), "__p", CANDIDATES).drop("__p")
    days = F.coalesce(decay.days_between(F.col("last_accessed"), F.lit(as_of)), F.lit(999.0))
    named = first.join(t.buckets, "bucket_id").withColumn("current", decay.unrounded_strength(F.col("strength"), decay.tier_scan(F.col("importance")), days))
    asked = named.join(own.select("q"), F.col("question_id") == F.col("q.question_id")).select(*named.columns, *(F.col(f"q.{c}").alias(c) for c in questions.columns if c not in ("question_id", "user_id", "vector")))
    scoped = ~F.col("document_scoped") | F.col("current_document").isNull() | F.coalesce(F.col("document_id") == F.col("current_document"), F.lit(False)) | (F.col("hits") > 0)
    kept = asked.filter(scoped & ((F.col("current") >= 0.1) | F.col("document_scoped")))
    out = with_connectivity(t, with_evidence(t, kept))
    return out.withColumns({"graph_score": F.least(F.lit(1.0), 0.25 * F.col("hits")), "vector_score": unit(F.col("vector_score")), "to_current": F.lit(False), "to_recent": F.lit(False), "significance": F.lit("")})


def with_evidence(t: Tables, rows: DataFrame) -> DataFrame:
    """Rows of (question_id, bucket_id) with the longest definition of the memory (the first at a tie), and its first source by name."""
    items = t.items.select(F.col("bucket_id").alias("__of"), "definition", F.col("source").alias("__source"), F.struct(F.length("definition"), -F.col("item_id")).alias("__order"))
    found = rows.join(items, F.col("bucket_id") == F.col("__of"), "left").groupBy("question_id", "bucket_id")
    longest = found.agg(F.any_value(F.struct(*rows.columns)).alias("__row"), F.max_by("definition", "__order").alias("definition"), F.min("__source").alias("source"))
    return longest.select("__row.*", "definition", F.coalesce("source", F.lit("")).alias("source"))


def with_connectivity(t: Tables, rows: DataFrame) -> DataFrame:
    """Rows of (question_id, bucket_id) with the connectivity of the memory, from its edges and the documents at their other ends."""
    near = graph.halves(t.edges).select(F.col("bucket_id").alias("__of"), "other_id", "confidence")
    documents = t.buckets.select(F.col("bucket_id").alias("__other"), F.col("document_id").alias("__document"))
    joined = rows.join(near, F.col("bucket_id") == F.col("__of"), "left").join(documents, F.col("other_id") == F.col("__other"), "left")
    known = F.when(F.col("__other").isNotNull(), F.col("other_id"))
    cross = F.when(F.col("__document").isNotNull() & ~F.col("__document").eqNullSafe(F.col("document_id")), F.col("other_id"))
    grouped = joined.groupBy("question_id", "bucket_id").agg(F.any_value(F.struct(*rows.columns)).alias("__row"), F.size(F.collect_set(known)).alias("d"), F.size(F.collect_set(cross)).alias("x"), F.avg(F.when(known.isNotNull(), F.col("confidence"))).alias("c"))
    score = unit(0.45 * F.least(F.lit(1.0), F.col("d") / 8) + 0.25 * F.least(F.lit(1.0), F.col("x") / 4) + 0.2 * F.col("c"))
    return grouped.select("__row.*", F.when(F.col("d") > 0, score).otherwise(0.0).alias("connectivity"))


def retrieve(t: Tables, questions: DataFrame, as_of: datetime, most: int = MAX_MEMORIES) -> DataFrame:
    """The best memories of each question with relevance and rank. ``questions``: question_id, user_id, text, vector, current_document."""
    return scoring.softmax_ranked(scoring.raw_relevance(candidates(t, analysed(questions), as_of), as_of), most=most)


def assemble(ranked: DataFrame) -> DataFrame:
    """question_id, context, memories: gate, budget, diversity of types and sources, lines."""
    open_ = scoring.evidence_gate(ranked)
    n = F.count(F.lit(1)).over(Window.partitionBy("question_id"))
    line = scoring.context_line(F.col("rank"), F.col("concept_type"), F.col("canonical"), F.coalesce("definition", F.lit("")), F.col("current"), F.col("source"), F.col("connectivity"), F.col("to_current"), F.array().cast("array<string>"))
    rows = open_.withColumn("budget", scoring.budget_of(F.col("specificity"), n)).withColumn("line", line)
    return scoring.context_block(scoring.within_budget(rows, carry=("rank", "line")))
