"""Shared helpers: cutting lineage in the shared folder, word splitting and hashing inside tasks."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII whitespace is exactly what bytes.split() splits on: \x20 and \x09-\x0D.
NULL_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a new one where it is unset and all is one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.conf.get("spark.master", "").split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not path:
        path = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as a table in the shared folder and read it back: later plans start here, and no executor's loss undoes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def apart(df: DataFrame) -> DataFrame:
    """df under new attribute ids, so that it can be cogrouped with a frame of the same origin."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def fresh(columns: list[str], name: str) -> str:
    """name, with underscores before it until no column has it, whatever the case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = f"_{name}"
    return name


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


class HashedWords(dict):
    """word (bytes) -> 64-bit hash; forgets everything once it holds `most` words, so its memory is bounded."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 40:
            self[word] = value
        return value


_words = HashedWords()


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; null gives none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def binary_column(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, type=pa.binary())


def crc_mod(column, mod: int):
    """crc32 of an id written as text, modulo `mod`; null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % F.lit(mod)
