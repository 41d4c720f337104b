"""Cutting the lineage of what a loop goes over again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def _folder(df: DataFrame) -> str:
    """The checkpoint folder that driver and executors share; a temporary one only in local mode."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="keepsake-"))
    return context._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """The rows as files in the checkpoint folder."""
    _folder(df)
    return df.checkpoint()


def settled_by(df: DataFrame, column: str) -> DataFrame:
    """The same in parts by a column, so that a filter on it reads no others."""
    path = f"{_folder(df)}/{uuid.uuid4().hex}"
    df.write.partitionBy(column).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
