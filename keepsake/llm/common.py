"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: What a stage of the corpus pipeline carries on.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: By application: the folder that stands in for one that drivers and executors share.
OWN_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session; where that is unset, a temporary one, but only in local mode, as in tests."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = OWN_FOLDERS.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="keepsake-")
        OWN_FOLDERS[context.applicationId] = folder
    return folder.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts the lineage, survives a lost executor, and is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/keepsake-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(dropped, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table._keepsake_path = path
    return table


def numbered(rows: DataFrame, keys: list[str], part: str, within: str, name: str) -> DataFrame:
    """``rows`` with a number from 0 among those of equal keys: rows of a part count from the sum of the parts before it.

    rows: each has its part and its place among the rows of its keys in that part. No key is gathered in one task: only
    a row for each part and key is ordered."""
    sizes = rows.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(part).alias("__part"), F.coalesce(before, F.lit(0)).alias("__before"))
    same = (F.col(part) == F.col("__part")) & reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    return rows.join(offsets, same).withColumn(name, F.col("__before") + F.col(within)).drop("__part", "__before", *(f"__{k}" for k in keys))


def discarded(table: DataFrame) -> None:
    """Deletes the files of a written table that nothing will read again."""
    dropped(table.sparkSession, table._keepsake_path)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a written table; at exit the JVM may be gone already."""
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001
        pass


def give_back() -> None:
    """Returns this worker's free memory to the system; workers go on from task to task and would keep it."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def in_slices(run, rows: int = 1024):
    """``run`` over Arrow batches of at most so many rows, so that few texts are Python objects at a time; gives memory back at the end."""

    def over(batches):
        try:
            yield from run(batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows))
        finally:
            give_back()

    return over


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
