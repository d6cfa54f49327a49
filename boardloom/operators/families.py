"""One pass over a partition of boards, and what describes a partition.

A partition is (window, board, group). The loops are in ``refinement`` and ``merging``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardloom.functions.rules import size_band
from boardloom.operators.groups import best_group, mean_profiles, nearest, scored, similarities
from boardloom.operators.ranks import spread_row_number
from boardloom.sources.shared import staged

WITHIN = ["balance_window"]
BOARD = ["match_id", "participant_index"]
KEY = [*WITHIN, *BOARD]
TAU = 0.60
CORE = 0.75


def _sized(partition: DataFrame, least: int) -> DataFrame:
    sizes = partition.groupBy(*WITHIN, "group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return partition.join(sizes.drop("n"), [*WITHIN, "group"], "left_semi")


def moves(old: DataFrame, new: DataFrame) -> DataFrame:
    """(window, moved): boards in just one of the partitions, and members outside their new group's most common old group."""
    both = old.select(*KEY, F.col("group").alias("o")).join(new.select(*KEY, F.col("group").alias("g")), KEY, "full_outer")
    lone = both.where("o is null or g is null").groupBy(*WITHIN).agg(F.count(F.lit(1)).alias("lone"))
    cells = both.where("o is not null and g is not null").groupBy(*WITHIN, "g", "o").agg(F.count(F.lit(1)).alias("n"))
    kept = cells.groupBy(*WITHIN, "g").agg((F.sum("n") - F.max("n")).alias("m")).groupBy(*WITHIN).agg(F.sum("m").alias("m"))
    windows = both.select(*WITHIN).distinct()
    out = windows.join(lone, WITHIN, "left").join(kept, WITHIN, "left").fillna(0, ["lone", "m"])
    return out.select(*WITHIN, (F.col("lone") + F.col("m")).alias("moved"))


def refine_pass(vectors: DataFrame, partition: DataFrame, *, tau: float = TAU, least: int = 2) -> DataFrame:
    """Every board at its most similar group of at least ``least`` boards, if that reaches ``tau``."""
    profiles = mean_profiles(vectors, _sized(partition, least), KEY, [*WITHIN, "group"])
    return nearest(vectors, profiles, KEY, within=WITHIN, group="group", least=tau).select(*KEY, "group")


def stable_ids(partition: DataFrame, vectors: DataFrame | None) -> DataFrame:
    """Group ids by size, then the units on half the boards, then the first board; from 0 in each window.

    A partition that has each board's ``vector`` needs no join with the vectors and keeps its further columns.
    """
    sizes = partition.groupBy(*WITHIN, "group").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*BOARD)).alias("first"))
    rows = vectors.join(partition, KEY) if vectors is not None else partition.select(*WITHIN, "group", F.explode("vector.unit").alias("unit"))
    held = rows.groupBy(*WITHIN, "group", "unit").agg(F.count(F.lit(1)).alias("c")).join(sizes.drop("first"), [*WITHIN, "group"])
    common = held.where("2 * c >= n").groupBy(*WITHIN, "group").agg(F.array_sort(F.collect_list("unit")).alias("common"))
    order = [F.desc("n"), F.coalesce("common", F.array().cast("array<string>")), F.col("first")]
    placed = spread_row_number(sizes.join(common, [*WITHIN, "group"], "left"), WITHIN, order, "place")
    ids = placed.select(*WITHIN, "group", (F.col("place") - 1).cast("string").alias("id"))
    return partition.join(ids, [*WITHIN, "group"]).select(*KEY, F.col("id").alias("group"), *[c for c in partition.columns if c not in (*KEY, "group")])


def prune_audit(vectors: DataFrame, partition: DataFrame, *, sample: int = 300, tau: float = TAU) -> DataFrame:
    """(window, audited, disagreements): a sample scored against every group of its window, next to the pruned choice.

    The sample is a parameter, so its product with the groups of a window is bounded.
    """
    profiles = mean_profiles(vectors, partition, KEY, [*WITHIN, "group"])
    boards = vectors.select(*KEY).distinct()
    place = F.row_number().over(Window.partitionBy(*WITHIN).orderBy(F.xxhash64(*BOARD), *BOARD))
    picked = staged(boards.withColumn("__p", place).where(F.col("__p") <= sample).drop("__p"))
    own = vectors.join(picked, KEY, "left_semi")
    every = picked.join(profiles.select(*WITHIN, "group").distinct(), WITHIN)
    brute = best_group(scored(every, own, profiles, KEY, within=WITHIN, group="group"), KEY, group="group", least=tau).select(*KEY, F.col("group").alias("b"))
    pruned = best_group(similarities(own, profiles, KEY, within=WITHIN, group="group"), KEY, group="group", least=tau).select(*KEY, F.col("group").alias("p"))
    both = picked.join(brute, KEY, "left").join(pruned, KEY, "left")
    return both.groupBy(*WITHIN).agg(F.count(F.lit(1)).alias("audited"), F.count_if(~F.col("b").eqNullSafe(F.col("p"))).alias("disagreements"))


def group_units(partition: DataFrame, units: DataFrame) -> DataFrame:
    """(window, group, unit, n, presence, itemized, three_star): shares of the group's boards.

    ``units`` has (window, board, unit, tier, held), a row a copy; the copy with most items, then
    the highest tier, stands for a board.
    """
    sizes = partition.groupBy(*WITHIN, "group").agg(F.count(F.lit(1)).alias("boards"))
    best = units.join(partition, KEY).groupBy(*KEY, "group", "unit").agg(F.max(F.struct("held", "tier")).alias("c"))
    rows = best.groupBy(*WITHIN, "group", "unit").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c.held") >= 2).alias("two"), F.count_if(F.col("c.tier") >= 3).alias("stars")).join(sizes, [*WITHIN, "group"])
    return rows.select(*WITHIN, "group", "unit", "n", (F.col("n") / F.col("boards")).alias("presence"), (F.col("two") / F.col("n")).alias("itemized"), (F.col("stars") / F.col("n")).alias("three_star"))


def group_summary(partition: DataFrame, units: DataFrame, boards: DataFrame) -> DataFrame:
    """One row a group: size, band, results, core, the largest gap between presences, and its most itemized unit.

    ``boards`` has (window, board, placement).
    """
    shares = group_units(partition, units)
    results = partition.join(boards, KEY).groupBy(*WITHIN, "group").agg(
        F.count(F.lit(1)).alias("boards"), F.avg("placement").alias("mean"), F.count_if(F.col("placement") <= 4).alias("top4"), F.count_if(F.col("placement") >= 7).alias("low"), (F.count(F.lit(1)) - F.count_distinct("match_id")).alias("same_lobby")
    )
    down = Window.partitionBy(*WITHIN, "group").orderBy(F.desc("presence"), "unit")
    steps = shares.withColumns({"gap": F.col("presence") - F.lead("presence").over(down), "rank": F.row_number().over(down)})
    gaps = steps.groupBy(*WITHIN, "group").agg(F.coalesce(F.max("gap"), F.lit(0.0)).alias("gap"))
    core = F.array_sort(F.collect_list(F.when(F.col("presence") >= CORE, F.col("unit"))))
    named = shares.groupBy(*WITHIN, "group").agg(core.alias("core"), F.max_by("unit", F.struct("itemized", "presence", "unit")).alias("primary"))
    out = results.join(named, [*WITHIN, "group"]).join(gaps, [*WITHIN, "group"])
    return out.withColumn("band", size_band(F.col("boards")))


def group_item_sets(partition: DataFrame, units: DataFrame, boards: DataFrame, *, limit: int = 5) -> DataFrame:
    """(window, group, unit, item_set, n, top4, place): the most common exact sets of units with two or more items.

    ``units`` has items as a sorted array.
    """
    held = units.where(F.size("items") >= 2).join(partition, KEY)
    best = held.groupBy(*KEY, "group", "unit").agg(F.max(F.struct("held", "tier", "items")).alias("c"))
    rows = best.join(boards, KEY).groupBy(*WITHIN, "group", "unit", F.array_join("c.items", "+").alias("item_set")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("placement") <= 4).alias("top4"))
    place = F.row_number().over(Window.partitionBy(*WITHIN, "group", "unit").orderBy(F.desc("n"), "item_set"))
    return rows.withColumn("place", place).where(F.col("place") <= limit)


def own_similarity(vectors: DataFrame, partition: DataFrame) -> DataFrame:
    """(window, board, group, similarity) of each board to its own group's mean profile."""
    profiles = mean_profiles(vectors, partition, KEY, [*WITHIN, "group"])
    return scored(partition.select(*KEY, "group"), vectors, profiles, KEY, within=WITHIN, group="group")


def nearest_groups(profiles: DataFrame) -> DataFrame:
    """(window, group, nearest, similarity) of profiles; 0 and null where no other group shares two common units."""
    common = profiles.withColumnRenamed("group", "nearest")
    pairs = similarities(profiles.select(*WITHIN, "group", "unit", "weight"), common, [*WITHIN, "group"], within=WITHIN, group="nearest").where(F.col("group") != F.col("nearest"))
    best = pairs.groupBy(*WITHIN, "group").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "nearest")).alias("b"))
    every = profiles.select(*WITHIN, "group").distinct()
    out = every.join(best, [*WITHIN, "group"], "left")
    return out.select(*WITHIN, "group", F.col("b.nearest").alias("nearest"), F.coalesce(-F.col("b.s"), F.lit(0.0)).alias("similarity"))


def global_metrics(vectors: DataFrame, partition: DataFrame, *, tau: float = TAU) -> DataFrame:
    """One row a window: boards, grouped ones, groups, the largest, mean similarity inside, and groups with another one at or above ``tau``."""
    boards = vectors.select(*KEY).distinct().groupBy(*WITHIN).agg(F.count(F.lit(1)).alias("boards"))
    sizes = partition.groupBy(*WITHIN, "group").agg(F.count(F.lit(1)).alias("n")).groupBy(*WITHIN).agg(F.sum("n").alias("grouped"), F.count(F.lit(1)).alias("groups"), F.max("n").alias("largest"))
    inside = own_similarity(vectors, partition).groupBy(*WITHIN).agg(F.avg("similarity").alias("within"), F.count_if(F.col("similarity") < tau).alias("below"))
    near = nearest_groups(mean_profiles(vectors, partition, KEY, [*WITHIN, "group"])).groupBy(*WITHIN).agg(F.count_if(F.col("similarity") >= tau).alias("close_groups"))
    return boards.join(sizes, WITHIN, "left").join(inside, WITHIN, "left").join(near, WITHIN, "left")


def final_diagnostics(vectors: DataFrame, partition: DataFrame, *, tau: float = TAU) -> DataFrame:
    """(window, group, boards, below, weakest): members under ``tau`` and the least similar one."""
    own = own_similarity(vectors, partition)
    weakest = F.min(F.struct("similarity", *BOARD))
    rows = own.groupBy(*WITHIN, "group").agg(F.count(F.lit(1)).alias("boards"), F.count_if(F.col("similarity") < tau).alias("below"), weakest.alias("w"))
    return rows.select(*WITHIN, "group", "boards", "below", F.col("w.similarity").alias("weakest"), F.col("w.match_id").alias("match_id"), F.col("w.participant_index").alias("participant_index"))


def control_comparison(control: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, control, other, change) of two metric tables, one row a metric."""
    metrics = [c for c in control.columns if c not in keys]
    long = lambda df, name: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in metrics])).alias("m")).select(*keys, "m.metric", F.col("m.v").alias(name))
    both = long(control, "control").join(long(other, "other"), [*keys, "metric"], "full_outer")
    return both.withColumn("change", F.col("other") - F.col("control"))


def core_pairs(summaries: DataFrame) -> DataFrame:
    """(window, a, b, overlap) of groups whose cores (arrays) share a unit; overlap is shared over all units."""
    unit = summaries.select(*WITHIN, "group", "core", F.explode("core").alias("unit"))
    left = unit.select(*WITHIN, F.col("group").alias("a"), F.col("core").alias("ca"), "unit")
    right = unit.select(*WITHIN, F.col("group").alias("b"), F.col("core").alias("cb"), "unit")
    met = left.join(right, [*WITHIN, "unit"]).where("a < b").select(*WITHIN, "a", "b", "ca", "cb").distinct()
    return met.select(*WITHIN, "a", "b", (F.size(F.array_intersect("ca", "cb")) / F.size(F.array_union("ca", "cb"))).alias("overlap"))


def shell_cases(summaries: DataFrame, *, least: int = 10, most_overlap: float = 0.5, least_overlap: float = 0.6) -> DataFrame:
    """(window, kind, a, b): one main unit in different shells, or similar shells around different main units."""
    big = summaries.where(F.col("boards") >= least).select(*WITHIN, "group", "primary", "core")
    pairs = core_pairs(big)
    side = lambda name: big.select(*WITHIN, F.col("group").alias(name), F.col("primary").alias(f"{name}_unit"))
    same = side("a").join(side("b"), WITHIN).where("a < b and a_unit = b_unit").join(pairs, [*WITHIN, "a", "b"], "left").where(F.coalesce("overlap", F.lit(0.0)) <= most_overlap)
    close = pairs.where(F.col("overlap") >= least_overlap).join(side("a"), [*WITHIN, "a"]).join(side("b"), [*WITHIN, "b"]).where("a_unit <> b_unit")
    return same.select(*WITHIN, F.lit("same unit").alias("kind"), "a", "b").unionByName(close.select(*WITHIN, F.lit("same shell").alias("kind"), "a", "b"))


def anchored_groups(summaries: DataFrame, anchors: DataFrame) -> DataFrame:
    """(window, anchor, group) whose core holds all units of an anchor (name, units).

    Anchors and cores meet on single units; an anchor without units meets nothing.
    """
    wanted = anchors.select("name", F.size(F.array_distinct("units")).alias("need"), F.explode(F.array_distinct("units")).alias("unit"))
    held = summaries.select(*WITHIN, "group", F.explode("core").alias("unit"))
    met = held.join(wanted, "unit").groupBy(*WITHIN, "group", "name", "need").agg(F.count(F.lit(1)).alias("n")).where("n = need")
    return met.select(*WITHIN, F.col("name").alias("anchor"), "group")


def anchor_changes(base: DataFrame, other: DataFrame) -> DataFrame:
    """(window, anchor, base groups, other groups, change) between two :func:`anchored_groups` results.

    ``change`` says what became of an anchor: absent, gained, lost, unchanged (as many groups), split or joined.
    """
    count = lambda df, name: df.groupBy(*WITHIN, "anchor").agg(F.count(F.lit(1)).alias(name))
    both = count(base, "base_groups").join(count(other, "other_groups"), [*WITHIN, "anchor"], "full_outer").fillna(0, ["base_groups", "other_groups"])
    x, y = F.col("base_groups"), F.col("other_groups")
    change = F.when(x == 0, "gained").when(y == 0, "lost").when(x == y, "unchanged").when(x < y, "split").otherwise("joined")
    return both.withColumn("change", change)


def merge_candidates(shares: DataFrame, *, least: int = 3, fraction: float = 0.6, swaps: int = 1, flex: float = 0.15, itemized: float = 0.5, whole_core: int = 5) -> DataFrame:
    """(window, a, b, shared, overlap) of groups that may merge, from :func:`group_units` rows.

    Cores share enough units, at most ``swaps`` differ on one side, and every differing unit is
    explained: on enough boards of the other side, rarely itemized on its own, or the one addition
    to a whole shared core.
    """
    core = shares.where(F.col("presence") >= CORE)
    lists = core.groupBy(*WITHIN, "group").agg(F.collect_set("unit").alias("core"))
    left = core.select(*WITHIN, F.col("group").alias("a"), "unit")
    pairs = left.join(core.select(*WITHIN, F.col("group").alias("b"), "unit"), [*WITHIN, "unit"]).where("a < b").groupBy(*WITHIN, "a", "b").agg(F.count(F.lit(1)).alias("shared"))
    rows = pairs.join(lists.select(*WITHIN, F.col("group").alias("a"), F.col("core").alias("ca")), [*WITHIN, "a"]).join(lists.select(*WITHIN, F.col("group").alias("b"), F.col("core").alias("cb")), [*WITHIN, "b"])
    rows = rows.withColumns({"da": F.array_except("ca", "cb"), "db": F.array_except("cb", "ca")})
    need = F.greatest(F.lit(least), F.ceil(fraction * F.greatest(F.size("ca"), F.size("cb"))))
    rows = rows.where((F.col("shared") >= need) & (F.least(F.size("da"), F.size("db")) <= swaps))
    splash = (F.col("shared") >= whole_core) & (F.size("da") + F.size("db") == 1)
    odd = rows.select(*WITHIN, "a", "b", F.explode("da").alias("unit"), F.col("a").alias("own"), F.col("b").alias("other")).unionByName(rows.select(*WITHIN, "a", "b", F.explode("db").alias("unit"), F.col("b").alias("own"), F.col("a").alias("other")))
    told = odd.join(shares.select(*WITHIN, F.col("group").alias("own"), "unit", F.col("itemized").alias("i")), [*WITHIN, "own", "unit"]).join(shares.select(*WITHIN, F.col("group").alias("other"), "unit", F.col("presence").alias("p")), [*WITHIN, "other", "unit"], "left")
    unexplained = told.where(~((F.coalesce("p", F.lit(0.0)) >= flex) | (F.col("i") < itemized))).select(*WITHIN, "a", "b").distinct().withColumn("__no", F.lit(True))
    out = rows.join(unexplained, [*WITHIN, "a", "b"], "left").where(F.col("__no").isNull() | splash)
    return out.select(*WITHIN, "a", "b", "shared", (F.col("shared") / F.size(F.array_union("ca", "cb"))).alias("overlap"))
