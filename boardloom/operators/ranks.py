"""Row numbers, running sums and last values inside groups of any size.

A window over a group puts the group into one task. Here rows are sorted in ranges of
(group, order), numbered inside each range, and shifted by the sizes of the group's earlier
ranges, so a group with most of the rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardloom.sources.shared import shared_folder


def _in_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` dealt to ranges of ``order``, with ``__range``; written, since a range that is computed again need not hold the same rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("__range", F.lit(0))
    keyed = keyed.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id())
    path = shared_folder(df.sparkSession, "ranges")
    keyed.write.parquet(path)
    return df.sparkSession.read.schema(keyed.schema).parquet(path)


def spread_running_sum(df: DataFrame, group: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over each row and those before it in its group; ``order`` must be total.

    The offsets have a row for each range and group in it: the number of ranges plus that of groups.
    """
    keyed = _in_ranges(df, [*[F.col(g) for g in group], *order])
    sizes = keyed.groupBy(*group, "__range").agg(F.sum(value).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    shift = sizes.select(*group, "__range", F.coalesce(before, F.lit(0)).alias("__shift"))
    own = F.sum(value).over(Window.partitionBy(*group, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return keyed.join(shift, [*group, "__range"]).withColumn(name, own + F.col("__shift")).drop("__range", "__shift")


def as_of(rows: DataFrame, marks: DataFrame, at: str, since: str) -> DataFrame:
    """``rows`` with the columns of the mark with the latest ``since`` not after ``at``; null where none is.

    Rows and marks are sorted together in ranges of time; a range takes the last mark of the ranges
    before it along, so no side is broadcast and no time is compared with all marks. Rows with a null ``at`` get none.
    """
    mark = F.struct(F.col(since).alias("__since"), *[F.col(c) for c in marks.columns])
    kept = F.struct(*[F.col(c) for c in rows.columns])
    both = rows.select(F.col(at).alias("__at"), F.lit(1).alias("__kind"), F.xxhash64(kept).alias("__salt"), kept.alias("__row")).withColumn("__mark", F.lit(None).cast(marks.select(mark.alias("m")).schema["m"].dataType))
    both = both.unionByName(marks.select(F.col(since).alias("__at"), F.lit(0).alias("__kind"), F.lit(0).cast("long").alias("__salt"), F.lit(None).cast(rows.select(kept.alias("r")).schema["r"].dataType).alias("__row"), mark.alias("__mark")))
    keyed = _in_ranges(both, [F.col("__at"), F.col("__kind"), F.col("__salt")])
    last = keyed.groupBy("__range").agg(F.max("__mark").alias("__m"))
    before = F.max("__m").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    carried = last.select("__range", before.alias("__before"))
    here = F.max("__mark").over(Window.partitionBy("__range").orderBy("__at", "__kind", "__salt").rowsBetween(Window.unboundedPreceding, 0))
    found = keyed.withColumn("__here", here).where("__kind = 1").join(carried, "__range").withColumn("__m", F.when(F.col("__at").isNotNull(), F.coalesce("__here", "__before")))
    return found.select(*[F.col(f"__row.{c}").alias(c) for c in rows.columns], *[F.col(f"__m.{c}").alias(c) for c in marks.columns if c not in rows.columns])


def spread_row_number(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with the 1-based position of each row in its group; ``order`` must be total.

    The offsets have a row for each range and group in it: the number of ranges plus that of groups.
    """
    keyed = _in_ranges(df, [*[F.col(g) for g in group], *order])
    sizes = keyed.groupBy(*group, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    shift = sizes.select(*group, "__range", F.coalesce(before, F.lit(0)).alias("__shift"))
    own = F.row_number().over(Window.partitionBy(*group, "__range").orderBy(*order))
    return keyed.join(shift, [*group, "__range"]).withColumn(name, own + F.col("__shift")).drop("__range", "__shift")
