"""Boards as weighted unit vectors, profiles of groups, and the most similar group of a board.

Vectors are long tables (board, unit, weight): similarity needs only the units both sides hold,
because the sum of maxima is the two totals less the sum of minima. Similarities are rounded to
nine digits before they are compared, so the order of summation can't decide a tie. What boards
have to do with groups follows from their vectors, so it is worked out once for boards that are alike.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardloom.sources.shared import staged

DIGITS = 9


def board_vectors(units: DataFrame, board: list[str], *, itemized: float = 2.0, splash: float = 0.5) -> DataFrame:
    """(board, unit, weight): the heaviest copy of each unit.

    Two or more items weigh ``itemized``; a bare one-star unit of cost 4 or more ``splash``; any
    other unit 1. Null items count as none.
    """
    held = F.coalesce(F.size("items"), F.lit(0))
    bare = (F.coalesce("cost", F.lit(0)) >= 4) & (held <= 0) & (F.col("tier") == 1)
    weight = F.when(held >= 2, itemized).when(bare, splash).otherwise(1.0)
    return units.groupBy(*board, "unit").agg(F.max(weight).alias("weight"))


def mean_profiles(vectors: DataFrame, members: DataFrame, board: list[str], group: list[str]) -> DataFrame:
    """(group, unit, weight, presence): mean weight, and share of boards with the unit."""
    sizes = members.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    sums = vectors.join(members, board).groupBy(*group, "unit").agg(F.sum("weight").alias("s"), F.count(F.lit(1)).alias("held"))
    return sums.join(sizes, group).select(*group, "unit", (F.col("s") / F.col("n")).alias("weight"), (F.col("held") / F.col("n")).alias("presence"))


def candidates(vectors: DataFrame, profiles: DataFrame, board: list[str], *, within: list[str], group: str, presence: float = 0.3, shared: int = 2) -> DataFrame:
    """(board, group) that share ``shared`` units which are on at least ``presence`` of the group's boards.

    An equi join on the units that count; nothing else of either side is touched before this.
    """
    right = profiles.where(F.col("presence") >= presence).select(*within, group, "unit")
    keys = list(dict.fromkeys([*within, *board]))
    met = vectors.select(*keys, "unit").join(right, [*within, "unit"]).groupBy(*keys, group)
    return met.agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= shared).drop("hits")


def scored(pairs: DataFrame, vectors: DataFrame, profiles: DataFrame, board: list[str], *, within: list[str], group: str) -> DataFrame:
    """``pairs`` with ``similarity``: the sum of minima over the sum of maxima, over all units of both sides."""
    keys = list(dict.fromkeys([*within, *board]))
    a = vectors.groupBy(*keys).agg(F.sum("weight").alias("a"))
    g = profiles.groupBy(*within, group).agg(F.sum("weight").alias("g"))
    right = profiles.select(*within, group, "unit", F.col("weight").alias("w"))
    low = pairs.join(vectors, keys).join(right, [*within, group, "unit"]).groupBy(*keys, group).agg(F.sum(F.least("weight", "w")).alias("low"))
    rows = pairs.join(low, [*keys, group], "left").join(a, keys, "left").join(g, [*within, group], "left").fillna(0.0, ["low", "a", "g"])
    most = F.col("a") + F.col("g") - F.col("low")
    return rows.select(*keys, group, F.when(most > 0, F.round(F.col("low") / most, DIGITS)).otherwise(0.0).alias("similarity"))


def over_kinds(vectors: list[DataFrame], board: list[str], within: list[str], of_kinds: Callable[..., DataFrame]) -> DataFrame:
    """``of_kinds(*vectors)``, worked out for one board of each kind and given to all boards of that kind.

    Boards of a window that are alike in all ``vectors`` are of one kind; boards outside the first take no part.
    """
    keys = list(dict.fromkeys([*within, *board]))
    names = [f"__v{n}" for n in range(len(vectors))]
    lists = [v.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("unit", "weight"))).alias(name)) for name, v in zip(names, vectors, strict=True)]
    boards = staged(reduce(lambda x, y: x.join(y, keys, "left"), lists).select(*keys, F.struct(*names).alias("__kind")))
    kinds = boards.groupBy(*within, "__kind").agg(F.min(F.struct(*[c for c in keys if c not in within])).alias("__first"))
    kinds = staged(kinds.select(*within, "__kind", "__first.*"))
    found = of_kinds(*[kinds.select(*keys, F.inline(f"__kind.{name}")) for name in names])
    entry = F.struct(*[c for c in found.columns if c not in keys])
    rows = staged(kinds.join(found, keys).groupBy(*within, "__kind").agg(F.collect_list(entry).alias("__found")))
    return boards.join(rows, [*within, "__kind"]).select(*keys, F.inline("__found"))


def similarities(vectors: DataFrame, profiles: DataFrame, board: list[str], *, within: list[str], group: str, presence: float = 0.3, shared: int = 2) -> DataFrame:
    """(board, group, similarity) of the candidates."""
    profiles = staged(profiles)

    def of_kinds(own: DataFrame) -> DataFrame:
        pairs = candidates(own, profiles, board, within=within, group=group, presence=presence, shared=shared)
        return scored(pairs, own, profiles, board, within=within, group=group)

    return over_kinds([vectors], board, within, of_kinds)


def blended(units: DataFrame, unit_profiles: DataFrame, traits: DataFrame, trait_profiles: DataFrame, board: list[str], *, within: list[str], group: str, trait_share: float = 0.25) -> DataFrame:
    """Similarities of the candidates by units, with ``trait_share`` of them by active traits."""
    keys = [*dict.fromkeys([*within, *board]), group]
    unit_profiles, trait_profiles = staged(unit_profiles), staged(trait_profiles)

    def of_kinds(own: DataFrame, own_traits: DataFrame) -> DataFrame:
        pairs = candidates(own, unit_profiles, board, within=within, group=group)
        by_unit = scored(pairs, own, unit_profiles, board, within=within, group=group)
        by_trait = scored(pairs, own_traits, trait_profiles, board, within=within, group=group).withColumnRenamed("similarity", "t")
        mixed = F.round((1 - trait_share) * F.col("similarity") + trait_share * F.col("t"), DIGITS)
        return by_unit.join(by_trait, keys).select(*keys, mixed.alias("similarity"))

    return over_kinds([units, traits], board, within, of_kinds)


def best_group(scores: DataFrame, board: list[str], *, group: str, least: float = 0.6) -> DataFrame:
    """(board, group, similarity): the most similar group at or above ``least``, ties to the smallest id."""
    top = F.min(F.struct((-F.col("similarity")).alias("s"), F.col(group))).alias("t")
    return scores.where(F.col("similarity") >= least).groupBy(*board).agg(top).select(*board, F.col(f"t.{group}"), (-F.col("t.s")).alias("similarity"))


def nearest(vectors: DataFrame, profiles: DataFrame, board: list[str], *, within: list[str], group: str, least: float = 0.6) -> DataFrame:
    """:func:`best_group` of the candidates, worked out once for boards that are alike."""
    profiles = staged(profiles)

    def of_kinds(own: DataFrame) -> DataFrame:
        pairs = candidates(own, profiles, board, within=within, group=group)
        return best_group(scored(pairs, own, profiles, board, within=within, group=group), board, group=group, least=least)

    return over_kinds([vectors], board, within, of_kinds)


def group_core(profiles: DataFrame, *, share: float = 0.75) -> DataFrame:
    """The rows of ``profiles`` whose unit is on at least ``share`` of the group's boards."""
    return profiles.where(F.col("presence") >= share)


def partition_disagreement(x: DataFrame, y: DataFrame, board: list[str], *, within: list[str], boards: str | None = None) -> DataFrame:
    """How two partitions of the same boards (column ``group``) differ, by pairs of boards.

    Pairs are counted from sizes of groups and of their intersections; none is made. Boards that
    only one partition holds take no part. ``boards`` names a column of ``x``: how many boards that no
    partition tells apart a row stands for.
    """
    count = F.col(boards) if boards else F.lit(1).cast("long")
    both = x.select(*board, F.col("group").alias("x"), count.alias("__n")).join(y.select(*board, F.col("group").alias("y")), board)
    cells = both.groupBy(*within, "x", "y").agg(F.sum("__n").alias("n"))
    pairs = F.sum(F.expr("n * (n - 1) div 2"))
    shared = cells.groupBy(*within).agg(F.sum("n").alias("boards"), pairs.alias("pairs_both"))
    side = lambda c: cells.groupBy(*within, c).agg(F.sum("n").alias("n")).groupBy(*within).agg(pairs.alias(f"pairs_{c}"))
    found = shared.join(side("x"), within).join(side("y"), within)
    return found.withColumns({"disagree": F.expr("pairs_x + pairs_y - 2 * pairs_both"), "either": F.expr("pairs_x + pairs_y - pairs_both")})
