"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keepsake import attach
from keepsake.llm import mixing, packing, simhash, suffix, toxicity
from keepsake.llm.common import read, written

STAGES = [
    ("toxicity", toxicity.toxicity_stage),
    ("simhash near-dedup", simhash.simhash_stage),
    ("suffix-array dedup", suffix.suffix_stage),
    ("mixing", mixing.mixed_stage),
    ("packing", packing.packed_stage),
]

#: No SQL states a trained classifier, connected components or a segment tree.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    attach(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
