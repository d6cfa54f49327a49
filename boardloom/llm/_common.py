"""Helpers shared by the corpus operators: staging, row hashing, word arrays."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A task's table of word hashes is emptied when it holds more words than this.
WORD_CACHE = 300_000
#: A null id sorts after every other one.
LAST_ID = (1 << 63) - 1
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_TABLES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stage_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, survives lost executors, gives Catalyst true sizes (so that a small
    table is broadcast under Spark's own threshold and a large one is not) and lets AQE split a
    skewed join, which it can't do above an aggregate.
    """
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def staged_by(df: DataFrame, *keys: str) -> DataFrame:
    """As :func:`staged`, but bucketed by ``keys``: later joins on them leave these rows where they are.

    There are as many buckets as shuffle partitions, so rows that a join or a grouping by the same
    keys has just dealt go to their buckets without another shuffle.
    """
    spark = df.sparkSession
    name = f"staged_{uuid.uuid4().hex}"
    path = f"{stage_dir(spark)}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, *keys).sortBy(*keys).option("compression", "zstd").option("path", path).saveAsTable(name)
    out = spark.table(name)
    _PATHS[out], _TABLES[out] = path, name
    return out


def discard(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more: whatever came of them is staged itself."""
    for frame in frames:
        spark = frame.sparkSession
        if frame in _TABLES:
            spark.sql(f"DROP TABLE {_TABLES.pop(frame)}")
        path = spark._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(frame))
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def splitmix(x: np.ndarray) -> np.ndarray:
    """Mix 64-bit words (the finaliser of the public SplitMix64 generator)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """bytes -> 64-bit hash, computed on first sight; emptied when it grows past its bound."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > WORD_CACHE:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def split_words(text: str | None, fold: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 bytes; ``bytes.split`` knows just that white space.

    ``fold`` lowers A-Z; ``bytes.lower`` leaves every other byte alone.
    """
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    return (data.lower() if fold else data).split()


def column_or_null(df: DataFrame, name: str, kind: str):
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)
