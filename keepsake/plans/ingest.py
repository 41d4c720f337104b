"""Ingestion: from documents or messages to memories, evidence, vectors and edges."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph, merge, segment
from ..schema import MAX_CONCEPTS, MAX_RELATED, MIN_IMPORTANCE
from ..sources.store import ModelFunction, embedded_once, extracted, stub_concepts, stub_embedding

RAW = "array<struct<label:string,definition:string,type:string,importance:string,significance:string,related:array<string>>>"


def repaired(reply: Column) -> Column:
    """Concepts of a model's reply: as it stands, inside a fence, the first array, or the first object; trailing commas are forgiven."""
    shape = lambda c: F.regexp_replace(c, r",\s*([}\]])", "$1")
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    array = F.regexp_extract(reply, r"(?s)(\[\s*\{.*\}\s*\])", 1)
    single = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    as_list = lambda c: F.when(F.trim(c).startswith("["), F.from_json(shape(c), RAW))
    as_one = lambda c: F.when(F.trim(c).startswith("{"), F.filter(F.array(F.from_json(shape(c), RAW[6:-1])), lambda x: x["label"].isNotNull()))
    return F.coalesce(as_list(reply), as_list(fenced), as_list(array), as_one(single), F.array().cast(RAW))


def concepts_of(replies: DataFrame) -> DataFrame:
    """Valid concepts of each document: cleaned, without section names and poor ones, the best of each label, the first 80 by importance, related names only if they are concepts too."""
    rows = replies.select("document_id", "section_index", F.posexplode(repaired(F.col("concepts"))).alias("place", "c")).select("document_id", (F.col("section_index") * 1000 + F.col("place")).alias("ordinal"), text.clean_label(F.col("c.label")).alias("label"), text.clean_string(F.col("c.definition"), 2000).alias("definition"), text.concept_type(F.col("c.type")).alias("concept_type"), text.importance(F.col("c.importance")).alias("importance"), text.clean_string(F.col("c.significance"), 500).alias("significance"), F.coalesce("c.related", F.array().cast("array<string>")).alias("related"))
    good = rows.filter((F.col("importance") >= MIN_IMPORTANCE) & ~text.is_structural(F.col("label")) & ~text.is_low_quality(F.col("label"), F.col("definition"))).withColumn("key", text.normalize_label(F.col("label")))
    best = merge.best_concepts(good, ["document_id", "key"])
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("importance"), "ordinal"))
    kept = best.withColumn("n", rank).filter(F.col("n") <= MAX_CONCEPTS).drop("n")
    known = F.collect_set("key").over(Window.partitionBy("document_id"))  # at most MAX_CONCEPTS; a join would extract all again
    named = F.filter(F.transform(text.clean_related(F.col("related")), text.normalize_label), lambda x: F.array_contains("known", x) & (x != F.col("key")))
    return kept.withColumn("known", known).withColumn("related", F.slice(F.array_distinct(named), 1, MAX_RELATED)).drop("known")


def ingest(documents: DataFrame, known: DataFrame, buckets: DataFrame, as_of: datetime, model: ModelFunction = stub_concepts, embed: Callable[[Column], Column] = stub_embedding) -> dict[str, DataFrame]:
    """documents, concepts, buckets (the new table), embeddings and edges of what is new; ``buckets`` is unique on (user_id, normalized).

    Documents whose content the tenant has already are left out."""
    fresh = merge.new_by_content(known, documents).withColumn("content", text.clean_text(F.col("content")))
    concepts = concepts_of(extracted(segment.sectioned(fresh.select("document_id", "content")), model)).join(fresh.select("document_id", "user_id"), "document_id").withColumnRenamed("label", "canonical")
    table = merge.upsert_buckets(buckets, concepts, as_of)
    vectors = embedded_once(concepts.withColumn("embedding_text", text.cut_at_boundary(text.concept_text(F.col("canonical"), F.col("definition"), F.col("significance"), F.col("related")))), "embedding_text", embed).select("document_id", "key", "embedding")
    edges = concepts.select("document_id", "key", F.explode("related").alias("related_key")).withColumn("confidence", F.lit(0.65))
    return {"documents": fresh, "concepts": concepts, "buckets": table, "embeddings": vectors, "edges": edges}


def ingest_messages(messages: DataFrame) -> DataFrame:
    """Chunks of messages: cleaned, cut, with their estimate of tokens."""
    cleaned = messages.withColumn("content", text.clean_message(F.col("content"))).filter("content <> ''")
    return segment.chunked(cleaned)


def undirected_edges(edges: DataFrame) -> DataFrame:
    return graph.undirected(edges)
