"""Exact line-ups, one-slot alternatives and flex patterns.

A line-up is the sorted multiset of a board's unit ids, as an array. Alternatives are found by an
equi join on delete-one signatures, not by comparing all pairs. The choice of flex shells runs on
promoted line-ups only; a shell never joins line-ups of two sizes, so a task holds those of one
(window, level, carry, size).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardloom.functions.rules import valid_level
from boardloom.operators.ranks import spread_row_number
from boardloom.sources.shared import discard, staged, together

BOARD = ["match_id", "participant_index"]
AT = ["balance_window", "level"]


def board_lineups(participants: DataFrame, units: DataFrame, windows: DataFrame, unit_col: str = "shape_id") -> DataFrame:
    """Every board of a valid level with its line-up, highest star and committed carries."""
    lineups = units.groupBy(*BOARD).agg(
        F.array_sort(F.collect_list(unit_col)).alias("lineup"),
        F.max("tier").alias("best_tier"),
        F.array_sort(F.collect_set(F.when(F.col("committed"), F.col("character_id")))).alias("carries"),
    )
    return participants.where(valid_level(F.col("level"))).join(lineups, BOARD).join(windows, "match_id")


def exact_lineups(boards: DataFrame, *, min_boards: int = 10, extra: list[str] | None = None) -> DataFrame:
    """Line-ups on at least ``min_boards`` boards of one level, with their results."""
    keys = [*AT, *(extra or [])]
    sizes = boards.groupBy(*keys).agg(F.count(F.lit(1)).alias("level_boards"))
    got = boards.groupBy(*keys, "lineup").agg(
        F.count(F.lit(1)).alias("boards"),
        F.sum("placement").alias("placement_sum"),
        F.count_if(F.col("placement") <= 4).alias("top4"),
        F.count_if(F.col("placement") == 1).alias("wins"),
        F.count_if(F.col("best_tier") >= 3).alias("three_star"),
    )
    return got.where(F.col("boards") >= min_boards).join(sizes, keys)


def level_summary(boards: DataFrame, *, min_boards: int = 10) -> DataFrame:
    """Boards, distinct line-ups, promoted line-ups and the boards in them, for each level."""
    got = boards.groupBy(*AT, "lineup").agg(F.count(F.lit(1)).alias("n"))
    many = F.col("n") >= min_boards
    return got.groupBy(*AT).agg(F.sum("n").alias("boards"), F.count(F.lit(1)).alias("distinct_lineups"), F.count_if(many).alias("promoted"), F.sum(F.when(many, F.col("n")).otherwise(0)).alias("boards_in_promoted"))


def lineup_carries(boards: DataFrame, promoted: DataFrame) -> DataFrame:
    """(window, level, lineup, carry, boards): committed carries of promoted line-ups; null when a board has none."""
    rows = boards.join(promoted.select(*AT, "lineup"), [*AT, "lineup"], "left_semi")
    return rows.select(*AT, "lineup", F.explode_outer("carries").alias("carry")).groupBy(*AT, "lineup", "carry").agg(F.count(F.lit(1)).alias("boards"))


def _signatures(promoted: DataFrame, keys: list[str]) -> DataFrame:
    """Each line-up with every distinct unit left out once."""
    rows = promoted.select(*keys, "lineup", "boards", F.posexplode("lineup").alias("i", "unit"))
    shell = F.concat(F.slice("lineup", 1, F.col("i")), F.slice("lineup", F.col("i") + 2, F.size("lineup")))
    return rows.withColumn("shell", shell).select(*keys, "lineup", "boards", "unit", "shell").dropDuplicates([*keys, "lineup", "unit"])


def one_slot_alternatives(promoted: DataFrame, protected: str | None = None) -> DataFrame:
    """(window, level, [carry,] lineup, out_unit, in_unit, other, other_boards) for pairs that differ by one copy.

    ``protected`` names a column with the carry of each row: its copies are never swapped.
    """
    keys = [*AT, *([protected] if protected else [])]
    sig = _signatures(promoted, keys)
    if protected:
        sig = sig.where(F.col("unit") != F.col(protected))
    other = sig.select(*keys, "shell", F.col("lineup").alias("other"), F.col("boards").alias("other_boards"), F.col("unit").alias("in_unit"))
    pairs = sig.join(other, [*keys, "shell"]).where(F.col("lineup") != F.col("other"))
    return pairs.select(*keys, "lineup", F.col("unit").alias("out_unit"), "in_unit", "other", "other_boards")


def _without(lineup: Column, unit: Column) -> Column:
    """``lineup`` less one copy of ``unit``."""
    i = F.array_position(lineup, unit).cast("int")
    return F.concat(F.slice(lineup, F.lit(1), i - 1), F.slice(lineup, i + 1, F.size(lineup)))


def _shells(rows: DataFrame, keys: list[str], protected: str | None) -> DataFrame:
    """(shell, at, boards, unit): every line-up less one copy of each of its units but the protected one.

    Only shells that another line-up has too, numbered in order of the keys and their units; a shell
    has at most as many line-ups as there are units.
    """
    unit = rows.select(*keys, "at", "boards", "lineup", F.explode(F.array_distinct("lineup")).alias("unit"))
    if protected:
        unit = unit.where(F.col("unit") != F.col(protected))
    table = unit.withColumn("units", _without(F.col("lineup"), F.col("unit")))
    shared = table.groupBy(*keys, "units").agg(F.collect_list(F.struct("at", "boards", "unit")).alias("held")).where(F.size("held") > 1)
    return spread_row_number(shared, [], [*[F.col(k) for k in keys], F.col("units")], "shell").select("shell", F.inline("held"))


def _turns(live: DataFrame) -> DataFrame:
    """``live`` with ``pattern``, the line-up whose turn takes this row's shell, and ``gone``, whether its line-up is settled.

    A line-up has its turn if it comes before all others within two shared shells of it. Each window is one
    shell or one line-up, which both have few rows, so nothing is joined or broadcast.
    """
    shell, own = Window.partitionBy("shell"), Window.partitionBy("at")
    rows = live.withColumns({"n": F.count(F.lit(1)).over(shell), "sum": F.sum("boards").over(shell), "low": F.min("at").over(shell)}).where("n > 1")
    rows = rows.withColumn("low", F.min("low").over(own)).withColumn("low", F.min("low").over(shell)).withColumn("low", F.min("low").over(own))
    rows = rows.withColumn("best", F.min(F.struct((-F.col("n")).alias("n"), (-F.col("sum")).alias("sum"), "shell")).over(own))
    takes = (F.col("low") == F.col("at")) & (F.col("best.shell") == F.col("shell"))
    rows = rows.withColumn("pattern", F.max(F.when(takes, F.col("at"))).over(shell))
    gone = F.max(F.col("pattern").isNotNull()).over(own)
    return rows.select("shell", "at", "boards", "unit", "pattern", gone.alias("gone"))


def board_patterns(promoted: DataFrame, protected: str | None = None) -> DataFrame:
    """Each promoted line-up in one flex shell or alone: (window, level, [carry,] size, pattern, lineup, shell, flex, place, boards).

    A pattern is the first line-up that is left (by boards, then by name), and of its shells with another
    line-up left the one with the most line-ups, then boards, then the smallest; alone if there is none.
    ``protected`` names a column with the carry of each row; pattern numbers count from 0 for each
    (window, level, carry, size).

    The cover is built in rounds. A line-up takes its turn once no line-up ahead of it is left within two
    shared shells: others ahead could neither take it nor one that it could take, so all such line-ups
    take their turns at once, and end where they would one after another. Line-ups and shells go by
    numbers in the rounds; one without a shell that another has too stands alone.
    """
    keys = [*AT, *([protected] if protected else []), "size"]
    rows = promoted.withColumn("size", F.size("lineup")).select(*keys, "lineup", "boards")
    rows = staged(spread_row_number(rows, [], [*[F.col(k) for k in keys], F.desc("boards"), F.col("lineup")], "at"))
    live, rounds = staged(_shells(rows, keys, protected)), []
    first = live
    while not live.isEmpty():
        rounds.append(staged(_turns(live)))
        live = rounds[-1].where("not gone").drop("pattern", "gone")
    discard(first)
    taken = together(*rounds).where("pattern is not null") if rounds else rows.select("at", F.col("at").alias("pattern"), F.lit("").alias("unit")).where("false")
    out = rows.join(taken.select("at", "pattern", F.col("unit").alias("flex")).hint("merge"), "at", "left").withColumn("first", F.coalesce("pattern", "at")).drop("pattern")
    out = staged(out.withColumn("shell", F.when(F.col("flex").isNotNull(), _without(F.col("lineup"), F.col("flex")))))
    discard(rows, *rounds)
    numbers = spread_row_number(out.where("at = first").select(*keys, "first"), keys, [F.col("first")], "pattern").select("first", (F.col("pattern") - 1).cast("long").alias("pattern"))
    place = F.row_number().over(Window.partitionBy("first").orderBy("at")) - 1
    named = out.withColumn("place", place).join(numbers.hint("merge"), "first")
    return named.select(*keys, "pattern", "lineup", "shell", "flex", F.col("place").cast("long").alias("place"), "boards")


def pattern_sums(patterns: DataFrame, carries: DataFrame) -> DataFrame:
    """Boards, line-ups, anchor and carries of each pattern, in order of its boards.

    ``carries`` is :func:`lineup_carries`; the lead is the carry on the most boards, ties to the
    smaller id.
    """
    key = [*AT, "size", "pattern"]
    sums = patterns.groupBy(*key).agg(F.sum("boards").alias("boards"), F.count(F.lit(1)).alias("members"), F.min_by("lineup", "place").alias("anchor"), F.first("shell").alias("shell"))
    rows = patterns.select(*key, "lineup").join(carries.withColumnRenamed("boards", "n"), [*AT, "lineup"]).groupBy(*key, "carry").agg(F.sum("n").alias("n"))
    named = F.col("carry").isNotNull()
    held = rows.groupBy(*key).agg(
        F.min_by(F.when(named, F.col("carry")), F.when(named, F.struct(-F.col("n"), "carry"))).alias("lead"),
        F.count_if(named).alias("carries"),
        F.coalesce(F.sum(F.when(~named, F.col("n"))), F.lit(0)).alias("without_carry"),
    )
    return sums.join(held, key)


def comp_rows(sums: DataFrame, costs: DataFrame, *, level: int | None = None, lead_costs: list[int] | None = None, limit: int | None = None) -> DataFrame:
    """Patterns by level and the lead's cost, in order of boards; no filter changes a pattern.

    ``costs`` is (character_id, cost); ``limit`` is a report's length for each window.
    """
    rows = sums.join(costs.select(F.col("character_id").alias("lead"), F.col("cost").alias("lead_cost")), "lead", "left")
    if level is not None:
        rows = rows.where(F.col("level") == level)
    if lead_costs:
        rows = rows.where(F.col("lead_cost").isin(lead_costs))
    placed = spread_row_number(rows, ["balance_window"], [F.desc("boards"), F.col("level"), F.col("anchor")], "place").withColumn("place", F.col("place").cast("int"))
    return placed.where(F.col("place") <= limit) if limit else placed


def distribution(rows: DataFrame, group: list[str], value: Column, usable: Column) -> DataFrame:
    """Boards for each usable value of a metric with its share, and the missing ones under null."""
    got = rows.withColumn("value", F.when(usable, value)).groupBy(*group, "value").agg(F.count(F.lit(1)).alias("boards"))
    known = F.sum(F.when(F.col("value").isNotNull(), F.col("boards"))).over(Window.partitionBy(*group))
    return got.withColumn("share", F.when(F.col("value").isNotNull(), F.col("boards") / known))


def lineup_difference(pairs: DataFrame) -> DataFrame:
    """Multiset difference a - b of two array columns, as a sorted array with copies."""
    tagged = lambda c: F.transform(F.col(c), lambda x, i: F.struct(x.alias("u"), F.size(F.filter(F.slice(F.col(c), 1, i + 1), lambda y: y == x)).alias("k")))
    return pairs.withColumn("difference", F.array_sort(F.transform(F.array_except(tagged("a"), tagged("b")), lambda s: s["u"])))


def comp_name(rows: DataFrame, dim: DataFrame, *, shown: int = 3) -> DataFrame:
    """``rows`` (units, lead) with ``name``: the lead, then the dearest units by cost and name, copies as ``x2``, and how many copies are left.

    ``dim`` is (character_id, name, cost); a unit it lacks shows its id and costs nothing.
    """
    parts = rows.select("units", "lead").distinct().withColumn("unit", F.explode("units"))
    copies = parts.groupBy("units", "lead", "unit").agg(F.count(F.lit(1)).alias("n"))
    named = copies.join(dim.select(F.col("character_id").alias("unit"), F.col("name").alias("text"), "cost"), "unit", "left")
    text = F.coalesce("text", "unit")
    label = F.when(F.col("n") > 1, F.concat(text, F.lit(" ×"), F.col("n").cast("string"))).otherwise(text)
    entry = F.struct(~F.coalesce(F.col("unit") == F.col("lead"), F.lit(False)), -F.coalesce("cost", F.lit(0)), F.lower(text), F.col("unit"), label.alias("label"), F.col("n").alias("n"))
    first = named.groupBy("units", "lead").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, shown).alias("first"))
    rest = F.size("units") - F.aggregate("first", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    name = F.concat(F.array_join(F.transform("first", lambda x: x["label"]), " · "), F.when(rest > 0, F.concat(F.lit(" + "), rest.cast("string"))).otherwise(""))
    found = first.withColumn("name", name).select(F.col("units").alias("__u"), F.col("lead").alias("__l"), "name")
    return rows.join(found, F.expr("units = __u and lead <=> __l"), "left").drop("__u", "__l")
