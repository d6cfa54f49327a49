"""Streams into tables.

Appending streams use Spark's file sink: its metadata names the files of finished batches, so a
batch that broke off is not seen and a repeated one is seen once. Rows that repeat a key are
dropped within a watermark, so the state holds the keys of the delay and not of all time. Counts are
streamed in update mode; each batch overwrites a folder of its own, and readers take the newest row
of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from boardloom.functions.rules import ItemSets, is_commitment

DELAY = "7 days"


def append_once(rows: DataFrame, path: str, checkpoint: str, *, key: list[str], at: str, delay: str = DELAY) -> None:
    """Take in what has arrived, one row for each ``key``, then stop; the next call goes on from there.

    Rows that come later than ``delay`` behind the newest time seen are dropped, as they could no
    longer be told from repeated ones.
    """
    once = rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)
    stream = once.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    stream.trigger(availableNow=True).start().awaitTermination()


def stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of finished batches."""
    return spark.read.schema(schema).parquet(path)


def live_counts(rows: DataFrame, keys: list[str], path: str, checkpoint: str, *, at: str, delay: str = DELAY, width: str = "1 day") -> dict[str, int]:
    """Counts by time window and ``keys``; a window closes when the watermark passes it and leaves the state.

    Rows of a closed window are dropped and counted apart: the result has ``late``, such rows of this
    call, and ``open``, the counts that the state holds after it.
    """
    window = F.window(at, width)
    counts = rows.withWatermark(at, delay).groupBy(window, *keys).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(F.col("window.start").alias("starts"), *keys, "n")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    stream = counts.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
    run = stream.trigger(availableNow=True).start()
    run.awaitTermination()
    states = [p["stateOperators"][0] for p in run.recentProgress if p["stateOperators"]]
    return {"late": sum(s["numRowsDroppedByWatermark"] for s in states), "open": states[-1]["numRowsTotal"] if states else 0}


def append_matched(left: DataFrame, right: DataFrame, path: str, checkpoint: str, *, key: list[str], at: str, columns: list[str], delay: str = DELAY) -> None:
    """Rows of one stream that a row of the other one matches by ``key`` within ``delay`` of its time, whichever arrives first.

    Both sides are kept until the watermark is past any match they could have, then leave the state. A
    row with several matches, or one that repeats all ``columns``, is written once.
    """
    late = f"INTERVAL {delay}"
    one = left.select(*columns, at).withWatermark(at, delay)
    two = right.select(*[F.col(k).alias(f"__{k}") for k in key], F.col(at).alias("__at")).withWatermark("__at", delay)
    near = F.expr(f"__at >= {at} - {late} AND __at <= {at} + {late}")
    for k in key:
        near = near & (F.col(k) == F.col(f"__{k}"))
    met = one.join(two, near).select(*columns, at).dropDuplicatesWithinWatermark(columns)
    stream = met.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    stream.trigger(availableNow=True).start().awaitTermination()


def newest_counts(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest count of each time window and key."""
    rows = spark.read.parquet(path)
    return rows.groupBy("starts", *keys).agg(F.max_by("n", "batch_id").alias("n"))


def committed_units(boards: Column, sets: ItemSets) -> Column:
    """The distinct committed champions of each board of a document, as one array of ids.

    A document holds whole boards, so copies collapse without a group.
    """
    held = lambda u: F.when(F.size(u["itemNames"]) > 0, u["itemNames"]).otherwise(F.coalesce(u["item_names"], F.array().cast("array<string>")))
    empty = F.array().cast("array<string>")
    of_board = lambda p: F.array_distinct(F.transform(F.filter(p["units"], lambda u: is_commitment(held(u), sets)), lambda u: u["character_id"]))
    return F.flatten(F.transform(boards, lambda p: F.coalesce(of_board(p), empty)))
