"""What a reader sees of a group of boards: units with their items and stars, traits, shape, placements, item pairs.

A partition is (window, board, group). One copy of a unit stands for it on a board: the one with most
completed items, then stars, then the lowest index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardloom.functions.rules import ItemSets, size_band
from boardloom.operators.families import CORE, KEY, WITHIN, nearest_groups, own_similarity
from boardloom.operators.groups import mean_profiles
from boardloom.operators.merge_reports import nearest_ranks

GROUP = [*WITHIN, "group"]
OTHER = 0.15
SMALL_SAMPLE = 10


def standing_copies(units: DataFrame, partition: DataFrame) -> DataFrame:
    """(window, board, group, unit, items, tier, held, committed) of ``units`` (window, board, unit, unit_index, ...)."""
    rank = F.struct("held", "tier", (-F.col("unit_index")).alias("first"))
    best = units.groupBy(*KEY, "unit").agg(F.max_by(F.struct("items", "tier", "held", "committed"), rank).alias("c"))
    return best.join(partition.select(*KEY, "group"), KEY).select(*KEY, "group", "unit", "c.*")


def _sizes(partition: DataFrame) -> DataFrame:
    return partition.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("boards"))


def unit_rows(partition: DataFrame, units: DataFrame, sets: ItemSets) -> DataFrame:
    """(window, group, unit, presence, and shares of the group's boards where the unit's copy is so).

    two_items, qualified (a commitment), defensive (an item without carry evidence), gloves, adaptive; and shares of its copies by stars.
    """
    any_of = lambda ids: F.arrays_overlap("items", F.array(*[F.lit(i) for i in ids]))
    tests = {"two_items": F.col("held") >= 2, "qualified": F.col("committed"), "defensive": any_of(sets.no_evidence), "gloves": any_of(sets.gloves), "adaptive": any_of(sets.adaptive)}
    stars = {f"stars_{k}": F.col("tier") == k for k in (1, 2, 3)}
    rows = standing_copies(units, partition).groupBy(*GROUP, "unit").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(t).alias(k) for k, t in {**tests, **stars}.items()]).join(_sizes(partition), GROUP)
    shares = [(F.col(k) / F.col("boards")).alias(k) for k in tests] + [(F.col(k) / F.col("n")).alias(k) for k in stars]
    return rows.select(*GROUP, "unit", (F.col("n") / F.col("boards")).alias("presence"), *shares)


def trait_rows(partition: DataFrame, traits: DataFrame, *, limit: int = 10) -> DataFrame:
    """(window, group, trait_name, share, place): the active traits on most of a group's boards."""
    held = traits.where("tier_current >= 1").join(partition, KEY).groupBy(*GROUP, "trait_name").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("n"), "trait_name"))
    rows = held.withColumn("place", place).where(F.col("place") <= limit).join(_sizes(partition), GROUP)
    return rows.select(*GROUP, "trait_name", (F.col("n") / F.col("boards")).alias("share"), "place")


def group_shape(partition: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row a group: its share of all boards, units a board, other common units, the largest step in presence and its rank, stable slots.

    Presences are ranked from the highest; of equal steps the last counts. Stable slots are core units over units a board.
    """
    every = vectors.select(*KEY).distinct().groupBy(*WITHIN).agg(F.count(F.lit(1)).alias("all"))
    counts = vectors.join(partition, KEY).groupBy(*KEY, "group").agg(F.count(F.lit(1)).alias("units"))
    spread = nearest_ranks(counts, GROUP, "units", ranks={"p10": 0.1, "median": 0.5, "p90": 0.9}).select(*GROUP, F.col("n").alias("boards"), F.col("p10").alias("units_p10"), F.col("median").alias("units_median"), F.col("p90").alias("units_p90"))
    mean = counts.groupBy(*GROUP).agg(F.avg("units").alias("mean"))
    shares = vectors.join(partition, KEY).groupBy(*GROUP, "unit").agg(F.count(F.lit(1)).alias("n")).join(_sizes(partition), GROUP).withColumn("p", F.col("n") / F.col("boards"))
    down = Window.partitionBy(*GROUP).orderBy(F.desc("p"), "unit")
    steps = shares.withColumns({"step": F.col("p") - F.lead("p").over(down), "rank": F.row_number().over(down)})
    top = F.max(F.when(F.col("step").isNotNull(), F.struct("step", "rank")))
    common = F.array_sort(F.collect_list(F.when((F.col("p") >= OTHER) & (F.col("p") < CORE), F.col("unit"))))
    told = steps.groupBy(*GROUP).agg(top.alias("g"), common.alias("other_units"), F.count_if(F.col("p") >= CORE).alias("core"))
    rows = spread.join(mean, GROUP).join(told, GROUP).join(every, WITHIN)
    return rows.select(*GROUP, "boards", (F.col("boards") / F.col("all")).alias("share"), "units_p10", "units_median", "units_p90", "other_units", F.coalesce("g.step", F.lit(0.0)).alias("step"), F.coalesce("g.rank", F.lit(0)).alias("after_rank"), (F.col("core") / F.col("mean")).alias("stable_slots"))


def placements(partition: DataFrame, boards: DataFrame) -> DataFrame:
    """(window, group, placement, boards)."""
    return partition.join(boards, KEY).groupBy(*GROUP, "placement").agg(F.count(F.lit(1)).alias("boards"))


def item_pairs(partition: DataFrame, units: DataFrame, boards: DataFrame, sets: ItemSets, *, limit: int = 5, small: int = SMALL_SAMPLE) -> DataFrame:
    """(window, group, unit, pair, n, share, results, stars, qualified, flags, place): a unit's most common two-item cores.

    Over the group's boards where the unit's copy has two completed items or more. Flags name gloves in the pair and small samples.
    """
    copies = standing_copies(units, partition).withColumn("own", F.array_sort(F.filter("items", lambda x: (x != "") & ~x.isin(*sets.components)))).where(F.size("own") >= 2).join(boards, KEY)
    whole = copies.groupBy(*GROUP, "unit").agg(F.count(F.lit(1)).alias("population"))
    i = F.sequence(F.lit(1), F.size("own") - 1)
    pairs = F.flatten(F.transform(i, lambda a: F.transform(F.sequence(a + 1, F.size("own")), lambda b: F.concat(F.element_at("own", a), F.lit("+"), F.element_at("own", b)))))
    rows = copies.withColumn("pair", F.explode(F.array_distinct(pairs))).groupBy(*GROUP, "unit", "pair").agg(
        F.count(F.lit(1)).alias("n"), F.avg("placement").alias("mean"), F.avg((F.col("placement") <= 4).cast("int")).alias("top4"), F.avg((F.col("placement") == 1).cast("int")).alias("wins"),
        F.avg((F.col("tier") >= 3).cast("int")).alias("three_star"), F.avg(F.col("committed").cast("int")).alias("qualified"),
    )
    place = F.row_number().over(Window.partitionBy(*GROUP, "unit").orderBy(F.desc("n"), "pair"))
    parts = F.split("pair", "\\+")
    flags = F.array_compact(F.array(F.when(F.arrays_overlap(parts, F.array(*[F.lit(g) for g in sets.gloves])), "gloves"), F.when(F.col("n") < small, "small sample")))
    kept = rows.withColumn("place", place).where(F.col("place") <= limit).join(whole, [*GROUP, "unit"])
    return kept.withColumns({"share": F.col("n") / F.col("population"), "flags": flags}).drop("population")


def size_bands(partition: DataFrame) -> DataFrame:
    """(window, band, groups, boards)."""
    sizes = _sizes(partition).withColumn("band", size_band(F.col("boards")))
    return sizes.groupBy(*WITHIN, "band").agg(F.count(F.lit(1)).alias("groups"), F.sum("boards").alias("boards"))


def metric_quantiles(vectors: DataFrame, partition: DataFrame) -> DataFrame:
    """(window, measure, n, min, ranks, max) of group sizes, similarity within groups and to the nearest other group."""
    near = nearest_groups(mean_profiles(vectors, partition, KEY, GROUP)).select(*WITHIN, F.lit("nearest").alias("measure"), F.col("similarity").alias("value"))
    own = own_similarity(vectors, partition).select(*WITHIN, F.lit("within").alias("measure"), F.col("similarity").alias("value"))
    size = _sizes(partition).select(*WITHIN, F.lit("size").alias("measure"), F.col("boards").cast("double").alias("value"))
    return nearest_ranks(near.unionByName(own).unionByName(size), [*WITHIN, "measure"], "value")
