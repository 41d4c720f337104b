"""Columns of the engine's tables, and the constants that are part of its results."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Time at which the registered queries are asked.
AS_OF = datetime(2024, 1, 31)

BUCKETS = "bucket_id long, user_id long, document_id long, canonical string, concept_type string, importance int, strength double, decay_rate double, access_count int, last_accessed timestamp, created_at timestamp"
BUCKET_ITEMS = "item_id long, bucket_id long, label string, definition string, source string, item_ts timestamp"
EMBEDDINGS = "bucket_id long, embedding array<double>"
EDGES = "source_bucket_id long, target_bucket_id long, relation_type string, confidence double, method string"
DOCUMENTS = "document_id long, user_id long, filename string, content string, n_chars long, lang string, source string"
DOCUMENT_LINKS = "source_document_id long, target_document_id long, edge_count long, avg_confidence double, shared_concepts long, score double"
MESSAGES = "message_id long, session_id long, user_id long, role string, content string, ts timestamp"
CHUNKS = "chunk_id long, message_id long, document_id long, text string, chunk_index int, token_estimate int"
REMINDERS = "reminder_id long, user_id long, message string, memories array<long>, active boolean, created_at timestamp"
CONTRADICTIONS = "user_id long, existing_id long, incoming_id long, description string, resolved boolean"
JOBS = "job_id long, user_id long, status string, stage string, progress int, started_at timestamp"
USERS = "user_id long, email string, sandbox boolean, expires_at timestamp"

#: Concept types in order of priority, relation types, tiers and their lower bounds.
CONCEPT_TYPES = ("decision", "problem", "fact", "code", "entity", "event", "preference")
RELATION_TYPES = ("causes", "related_to", "replaces", "part_of", "requires", "evolves_into")
TIERS = {"strong": 0.7, "fading": 0.4, "critical": 0.1, "forgotten": 0.0}

#: Scoring weights, limits and thresholds.
WEIGHTS = {"semantic": 0.45, "strength": 0.30, "recency": 0.25, "connectivity": 0.12}
RECENCY_PER_HOUR = 0.1
MAX_MEMORIES, CANDIDATES, SEEDS, NEIGHBOURS, HIGH_IMPORTANCE = 20, 80, 12, 40, 12
SEMANTIC_FLOOR, TEXT_RESCUE, SOURCE_SHARE, MIN_RELEVANCE = 0.12, 0.5, 0.6, 0.015
CHUNK_TOKENS = (150, 250)
SECTION_CHARS, SINGLE_SECTION_CHARS, MIN_SECTION_CHARS, MAX_SECTIONS = 8000, 6000, 500, 20
MIN_IMPORTANCE, MAX_CONCEPTS, MAX_RELATED = 4, 80, 4
LINK_SIMILARITY, LINKS_PER_CONCEPT, LINKS_PER_DOCUMENT = 0.7, 5, 150


def struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)  # needs an active session


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Columns of ``ddl`` in its order, cast; columns that ``df`` lacks are null."""
    out: list[Column] = []
    for part in ddl.split(", "):
        name, kind = part.split(" ", 1)
        out.append((F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name))
    return df.select(*out)
