"""Connected components of a link table, as alternating star joins.

Large-star and small-star rounds (Kiveris and others, "Connected Components in MapReduce and
Beyond", 2014) end in one star for each component, centred on its smallest node. Every round is
two grouped minima and two joins on staged tables; the driver sees one row that says whether all
is stars yet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("m").alias("u"), "v")
    return moved.unionByName(least.select(F.col("m").alias("u"), F.col("u").alias("v")))


def _only_stars(edges: DataFrame) -> bool:
    """Whether no leaf (v) has two centres or is a centre (u) itself."""
    ends = edges.select(F.col("v").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre"))
    ends = ends.unionByName(edges.select(F.col("u").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
    roles = ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
    return roles.where("leaf + centre > 1").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component is its smallest node.

    Loops and repeated links do no harm; an empty table gives an empty result.
    """
    clean = edges.select(F.least("u", "v").cast("long").alias("u"), F.greatest("u", "v").cast("long").alias("v"))
    loops = clean.where("u = v").select(F.col("u").alias("node")).distinct()
    now = staged(clean.where("u < v").distinct())
    while not _only_stars(now):
        large = staged(_large_star(now))
        discard(now)
        now = staged(_small_star(large).distinct())
        discard(large)
    members = now.select(F.col("v").alias("node"), F.col("u").alias("component"))
    found = members.unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
    out = staged(found.unionByName(loops.join(found.select("node"), "node", "left_anti").withColumn("component", F.col("node"))))
    discard(now)
    return out
