"""A folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; only a local session without it gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: several readers, one computation."""
    path = shared_folder(df.sparkSession, "staged")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def together(*frames: DataFrame) -> DataFrame:
    """Staged tables of the same columns as one: a single scan, however many they are."""
    return frames[0].sparkSession.read.schema(frames[0].schema).parquet(*[_PATHS[f] for f in frames])


def discard(*frames: DataFrame) -> None:
    """Delete staged tables once whatever came of them is staged itself."""
    for frame in frames:
        spark = frame.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(frame))
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
