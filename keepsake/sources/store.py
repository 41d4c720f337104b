"""Tables as snapshots in a folder that Spark reaches: append, replace by a swap of folders, change in the parts that are touched, list, move, delete; sealed files; model functions."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import title_of, words_of


#: Parts of a table that is laid out by key, unless it says otherwise.
PARTS = 64


class Store:
    """Named Parquet tables below a folder; every access is by Spark or its file system, so the folder may be remote."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    @property
    def files(self):
        return self.path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self.files.exists(self.path(name))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.folder}/{name}")

    def append(self, name: str, df: DataFrame) -> None:
        df.write.mode("append").parquet(f"{self.folder}/{name}")

    def replace(self, name: str, df: DataFrame) -> None:
        """Writes beside the old table, which ``df`` may read, and swaps the folders."""
        new, old = f"{name}-new-{uuid.uuid4().hex}", f"{name}-old-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{new}")
        had = self.exists(name)
        if had:
            self.move(name, old)
        self.move(new, name)
        if had:
            self.delete(old)

    def change(self, name: str, changes: DataFrame, key: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], parts: int = PARTS, removes: bool = False) -> list[int]:
        """Merges changes into a table that lies in parts by a hash of ``key``, and writes only the parts they touch, which are returned.

        ``merge`` gets the old rows of those parts and the changes, and gives their new rows; it must give the same again
        if the changes are in already, as a run that was broken off between two parts is repeated. ``removes``: it may
        leave a part without rows. The table is laid out by its first change."""
        column = next((n.partition("=")[0] for n, _ in self.names(name) if n.startswith("part_of_")), f"part_of_{parts}")
        of = F.pmod(F.xxhash64(*key), F.lit(int(column.removeprefix("part_of_")))).cast("int")
        touched = sorted(r[0] for r in changes.select(of.alias(column)).distinct().collect())  # as many as the table has parts, at most
        old = self.read(name).filter(F.col(column).isin(touched)) if self.exists(name) else None
        new = (merge(old.drop(column), changes) if old is not None else merge(changes.limit(0), changes)).withColumn(column, of)
        left = {r[0] for r in new.select(column).distinct().collect()} if removes else set(touched)
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(f"{self.folder}/{name}")
        for part in set(touched) - left:
            self.delete(f"{name}/{column}={part}")
        return touched

    def read_parts(self, name: str, key: list[str], values: DataFrame) -> DataFrame:
        """Of a table laid out by ``key``: the rows of some keys, read from their parts only."""
        column = next(n.partition("=")[0] for n, _ in self.names(name) if n.startswith("part_of_"))
        of = F.pmod(F.xxhash64(*key), F.lit(int(column.removeprefix("part_of_")))).cast("int")
        touched = [r[0] for r in values.select(of.alias("part")).distinct().collect()]
        return self.read(name).filter(F.col(column).isin(touched)).drop(column).join(values.select(*key).distinct(), key, "left_semi")

    def names(self, name: str) -> list[tuple[str, bool]]:
        """What a table's folder holds, and whether it is a folder."""
        folder = self.path(name) if name else self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        return [(s.getPath().getName(), s.isDirectory()) for s in self.files.listStatus(folder)] if self.files.exists(folder) else []

    def move(self, name: str, to: str) -> None:
        if not self.files.rename(self.path(name), self.path(to)):
            raise OSError(f"{name} could not be moved to {to}")

    def delete(self, name: str) -> bool:
        return self.files.delete(self.path(name), True)

    def list(self, prefix: str = "") -> list[tuple[str, int]]:
        """Names and bytes of what lies in the folder."""
        found = [(s.getPath().getName(), self.files.getContentSummary(s.getPath()).getLength()) for s in self.files.listStatus(self.path(""))]
        return sorted(x for x in found if x[0].startswith(prefix))

    def page(self, prefix: str = "", after: str = "", most: int = 1000) -> list[tuple[str, int]]:
        """The first names after one, and their bytes: a listing in pages, however many names there are."""
        names = sorted(n for n, _ in self.names("") if n.startswith(prefix) and n > after)[:most]
        return [(n, self.files.getContentSummary(self.path(n)).getLength()) for n in names]

    def head(self, name: str) -> tuple[int, datetime] | None:
        """Bytes and time of the last change; None if there is no such name."""
        if not self.exists(name):
            return None
        status = self.files.getFileStatus(self.path(name))
        return self.files.getContentSummary(self.path(name)).getLength(), datetime.fromtimestamp(status.getModificationTime() / 1000, tz=timezone.utc)

    def copy(self, name: str, to: str) -> None:
        """Copies beside the target and moves it there, so a copy that is broken off leaves nothing under the name."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        part = f"{to}-new-{uuid.uuid4().hex}"
        if not jvm.org.apache.hadoop.fs.FileUtil.copy(self.files, self.path(name), self.files, self.path(part), False, conf):
            raise OSError(f"{name} could not be copied")
        if self.exists(to):
            self.delete(to)
        self.move(part, to)

    def delete_prefix(self, prefix: str) -> int:
        """Deletes all names that begin so; how many there were. An empty prefix is refused."""
        if not prefix:
            raise ValueError("a prefix is needed")
        return sum(self.delete(n) for n, _ in self.names("") if n.startswith(prefix))

    def usage(self) -> int:
        return sum(n for _, n in self.list())


def sealed(text: Column, key: Column) -> Column:
    """AES-GCM in base64; ``key`` is a 32-byte key, see ``key_of``."""
    return F.regexp_replace(F.base64(F.aes_encrypt(text.cast("binary"), key, F.lit("GCM"))), "[\r\n]", "")


def opened(text: Column, key: Column) -> Column:
    """The text again; what can't be opened is returned as it is."""
    plain = F.try_aes_decrypt(F.unbase64(F.when(text.rlike(r"^[A-Za-z0-9+/]+={0,2}$") & (F.length(text) % 4 == 0), text)), key, F.lit("GCM"))
    return F.coalesce(plain.cast("string"), text)


def key_of(password: str, salt: bytes) -> bytes:
    """A 32-byte key, derived on the driver once."""
    return hashlib.scrypt(password.encode(), salt=salt, n=16384, r=8, p=1, dklen=32, maxmem=64 << 20)


#: From batches of rows to batches of rows: where an outside model is called.
ModelFunction = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
CONCEPTS = "document_id long, section_index int, concepts string"


def stub_concepts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A deterministic stand-in for an extraction model: the section's capitalised words as concepts, as JSON."""
    import json
    import re

    for rows in batches:
        out = []
        for text in rows["section"]:
            names = list(dict.fromkeys(re.findall(r"\b[A-Z][a-z]{4,}\b", text or "")))[:5]
            out.append(json.dumps([{"label": n, "definition": f"{n} as told in: {(text or '')[:120]}", "type": "fact", "importance": 4 + i, "related": names[:i]} for i, n in enumerate(names)]))
        yield pd.DataFrame({"document_id": rows["document_id"], "section_index": rows["section_index"], "concepts": out})


def stub_embedding(text: Column, dimensions: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: signed counts of hashed words at unit length."""
    hashes = F.transform(words_of(F.lower(text)), lambda w: F.xxhash64(w))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.aggregate(hashes, F.lit(0.0), lambda s, h: s + F.when(F.pmod(h, F.lit(dimensions)) == i, F.when(h > 0, 1.0).otherwise(-1.0)).otherwise(0.0)))
    return F.transform(F.array(raw), lambda v: F.transform(v, lambda x: x / F.greatest(F.lit(1e-9), F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y)))))[0]


def extracted(sections: DataFrame, model: ModelFunction = stub_concepts) -> DataFrame:
    return sections.select("document_id", "section_index", "section").mapInPandas(model, CONCEPTS)


def embedded_once(rows: DataFrame, text: str, embed: Callable[[Column], Column] = stub_embedding) -> DataFrame:
    """Distinct texts are embedded once and joined back."""
    vectors = rows.select(text).distinct().withColumn("embedding", embed(F.col(text)))
    return rows.join(vectors, text)


def titled(sessions: DataFrame, first_message: str = "content", default: str = "New conversation") -> DataFrame:
    """Sessions still called by the default get the beginning of their first message."""
    return sessions.withColumn("title", F.when(F.col("title") == default, title_of(F.col(first_message))).otherwise(F.col("title")))
