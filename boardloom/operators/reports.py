"""Reports over a store: ranks, rule comparisons, summaries, samples for review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardloom.functions.rules import ItemSets, completed_list, is_commitment
from boardloom.operators.evidence import BOARD, CARRY
from boardloom.operators.quality import broken_lobbies, first_reason
from boardloom.operators.ranks import spread_running_sum


def candidate_ranks(scores: DataFrame, listed: Column) -> DataFrame:
    """``scores`` with rank_overall, rank_in_cost and rank_listed (among ``listed`` rows, else null), for each window.

    Windows hold a row for each carry, so a window function sees few rows.
    """
    by_score = [F.desc(F.round("opportunity", 9)), "character_id", "cost"]
    overall = Window.partitionBy("balance_window").orderBy(*by_score)
    in_cost = Window.partitionBy("balance_window", "cost").orderBy(*by_score)
    running = F.sum(F.when(listed, 1).otherwise(0)).over(overall.rowsBetween(Window.unboundedPreceding, 0))
    return scores.withColumns({"rank_overall": F.row_number().over(overall), "rank_in_cost": F.row_number().over(in_cost), "rank_listed": F.when(listed, running)})


def under_rule(units: DataFrame, sets: ItemSets) -> DataFrame:
    """``units`` judged by other item sets: every analytic runs on it as on the stored ones."""
    return units.withColumn("committed", is_commitment(F.col("items"), sets))


def compare_rules(current: DataFrame, baseline: DataFrame, appearances: DataFrame) -> DataFrame:
    """Every champion that is seen, with counts, rates, scores and ranks under both rules.

    Both inputs have (window, champion, commitment_games, usage_rate, score, rank); ``appearances``
    has (window, champion, appearances).
    """
    side = lambda rows, tag: rows.select(*CARRY, *[F.col(c).alias(f"{c}_{tag}") for c in ("commitment_games", "usage_rate", "score", "rank")])
    both = appearances.join(side(baseline, "old"), CARRY, "left").join(side(current, "new"), CARRY, "left")
    filled = {f"{c}_{t}": F.coalesce(f"{c}_{t}", F.lit(0)) for c in ("commitment_games", "usage_rate") for t in ("old", "new")}
    out = both.withColumns(filled)
    return out.withColumn("change", F.col("commitment_games_new") - F.col("commitment_games_old"))


def package_changes(units: DataFrame, windows: DataFrame, old: ItemSets, new: ItemSets) -> DataFrame:
    """(window, champion, change, package, boards): boards that gain or lose their commitment.

    A board commits when any copy qualifies; the package is that of the canonical copy among those
    that qualify under the rule that still counts the board.
    """
    copy = F.struct(-F.col("completed_item_count"), -F.col("tier"), "unit_index", F.array_join(completed_list(F.col("items"), new), "+").alias("package"))
    judged = units.select(*BOARD, "character_id", is_commitment(F.col("items"), old).alias("was"), is_commitment(F.col("items"), new).alias("is"), copy.alias("copy"))
    boards = judged.groupBy(*BOARD, "character_id").agg(F.min(F.when(F.col("was"), F.col("copy"))).alias("was"), F.min(F.when(F.col("is"), F.col("copy"))).alias("is"))
    changed = boards.where(F.col("was").isNull() != F.col("is").isNull()).join(windows, "match_id")
    change = F.when(F.col("is").isNull(), "lost").otherwise("gained")
    package = F.coalesce("is.package", "was.package")
    return changed.groupBy(*CARRY, change.alias("change"), package.alias("package")).agg(F.count(F.lit(1)).alias("boards"))


def store_distributions(matches: DataFrame) -> DataFrame:
    """(kind, value, matches, earliest, latest): matches for each version, patch and window."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("version", "game_version"), ("patch", "patch"), ("window", "balance_window"))])
    rows = matches.select("game_datetime", F.explode(kinds).alias("k")).select("game_datetime", "k.kind", "k.value")
    return rows.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("matches"), F.min("game_datetime").alias("earliest"), F.max("game_datetime").alias("latest"))


def dataset_summary(matches: DataFrame, participants: DataFrame, units: DataFrame) -> DataFrame:
    """Counts of each window: matches, boards, boards without units, bad placements, broken lobbies, times."""
    at = matches.select("match_id", "balance_window")
    held = units.select(*BOARD).distinct().withColumn("held", F.lit(True))
    bad = ~F.coalesce(F.col("placement").between(1, 8), F.lit(False))
    boards = participants.join(held, BOARD, "left").join(at, "match_id").groupBy("balance_window").agg(F.count(F.lit(1)).alias("boards"), F.count_if(F.col("held").isNull()).alias("without_units"), F.count_if(bad).alias("bad_placements"))
    lobbies = broken_lobbies(participants).join(at, "match_id").groupBy("balance_window").agg(F.count(F.lit(1)).alias("broken_lobbies"))
    whole = matches.groupBy("balance_window").agg(F.count(F.lit(1)).alias("matches"), F.min("game_datetime").alias("earliest"), F.max("game_datetime").alias("latest"))
    return whole.join(boards, "balance_window", "left").join(lobbies, "balance_window", "left").fillna(0, ["boards", "without_units", "bad_placements", "broken_lobbies"])


def cohort_report(selected: DataFrame, seats: DataFrame, discoveries: DataFrame) -> DataFrame:
    """For each cohort: seats, players selected, of them never sampled, match references, matches, and matches other cohorts surfaced too.

    ``selected`` is (cohort, player, last_sampled), ``discoveries`` (cohort, player, match_id).
    """
    chosen = selected.groupBy("cohort").agg(F.count(F.lit(1)).alias("selected"), F.count_if(F.col("last_sampled").isNull()).alias("never_sampled"))
    by_match = discoveries.groupBy("match_id", "cohort").agg(F.count(F.lit(1)).alias("n"))
    spread = by_match.groupBy("match_id").agg((F.count(F.lit(1)) > 1).alias("shared"))
    found = by_match.join(spread, "match_id").groupBy("cohort").agg(F.sum("n").alias("references"), F.count(F.lit(1)).alias("matches"), F.count_if("shared").alias("cross_cohort"))
    out = seats.select("cohort", F.col("k").alias("requested")).join(chosen, "cohort", "left").join(found, "cohort", "left")
    return out.fillna(0, ["selected", "never_sampled", "references", "matches", "cross_cohort"])


def review_sample(rows: DataFrame, reasons: list[tuple[str, Column]], order: list, per_reason: int, within: list[str]) -> DataFrame:
    """A fixed number of rows for each reason, each row under the first reason it meets."""
    told = rows.withColumn("reason", first_reason(*reasons)).where("reason is not null")
    place = F.row_number().over(Window.partitionBy(*within, "reason").orderBy(*order))
    return told.withColumn("place", place).where(F.col("place") <= per_reason)


def quantiles(rows: DataFrame, group: list[str], value: str, shares: tuple[float, ...]) -> DataFrame:
    """(group, n, least, most, mean, and q of each share): nearest rank at round-half-even(p * (n - 1)).

    Distinct values are counted, and the counts summed in ranges of (group, value): no task takes a whole group.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("c"))
    counts = spread_running_sum(counts, group, [F.col(value)], "c", "upto")
    sizes = counts.groupBy(*group).agg(F.sum("c").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), (F.sum(F.col(value) * F.col("c")) / F.sum("c")).alias("mean"))
    rank = lambda p: F.least(F.col("n") - 1, F.bround(F.lit(p) * (F.col("n") - 1)).cast("long"))
    here = lambda p: (F.col("upto") > rank(p)) & (F.col("upto") - F.col("c") <= rank(p))
    met = counts.join(sizes, group).where(reduce(Column.__or__, [here(p) for p in shares]))
    return met.groupBy(*group, "n", "least", "most", "mean").agg(*[F.max(F.when(here(p), F.col(value))).alias(f"p{round(100 * p):02d}") for p in shares])


def load_population(participants: DataFrame, units: DataFrame, matches: DataFrame, *, ranked_queue: int = 1100) -> DataFrame:
    """Ranked boards with units, with ``obs`` numbered from 0 by (match, index) in each window."""
    from boardloom.operators.ranks import spread_row_number

    ranked = matches.where(F.col("queue_id") == ranked_queue).select("match_id", "balance_window")
    boards = participants.join(ranked, "match_id").join(units.select(*BOARD), BOARD, "left_semi")
    numbered = spread_row_number(boards, ["balance_window"], [F.col("match_id"), F.col("participant_index")], "obs")
    return numbered.withColumn("obs", F.col("obs").cast("long") - 1)


def unit_index_backfill(units: DataFrame, order: list) -> DataFrame:
    """``units`` with unit_index counted from 0 on each board in order of arrival."""
    return units.withColumn("unit_index", F.row_number().over(Window.partitionBy(*BOARD).orderBy(*order)) - 1)


def recount(units: DataFrame, counted: Column, stored: str = "completed_item_count") -> DataFrame:
    """Rows whose stored count differs from the one under the present item lists, with both."""
    return units.withColumn("recounted", counted).where(F.col("recounted") != F.col(stored))


def write_report(rows: DataFrame, path: str, order: list[str]) -> None:
    """A ranked report as CSV with headers, and as JSON lines: files in ranges of ``order``, so their names sort as the rows do."""
    ranked = rows.sort(*order)
    ranked.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    ranked.write.mode("overwrite").json(f"{path}/json")


def read_run(published: DataFrame, *, costs: list[int], least: int, entries: int, limit: int) -> DataFrame:
    """A published run by cost and sample, most boards first, evidence lists cut, ``limit`` a window."""
    chosen = published.where(F.col("cost").isin(costs) & (F.col("commitment_games") >= least))
    place = F.row_number().over(Window.partitionBy("balance_window").orderBy(F.desc("commitment_games"), "character_id", "cost"))
    lists = [c for c, t in published.dtypes if t.startswith("array")]
    return chosen.withColumn("place", place).where(F.col("place") <= limit).withColumns({c: F.slice(c, 1, entries) for c in lists})
