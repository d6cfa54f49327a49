"""What a merge run says of itself: attempts in full, other rules, histograms, trajectory, tails and lineage.

All of it is worked out after the run, from its attempts and the similarities before and after each of
them; nothing here changes a family. Rows of equal boards carry their count, so quantiles are taken
over running counts of distinct similarities.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardloom.functions.rules import banded, size_band, tail_band
from boardloom.operators.merging import BOARD, WITHIN, MergeRules, MergeRun, _ruzicka, s2_conditions

RANKS = {"p01": 0.01, "p05": 0.05, "p10": 0.10, "median": 0.5, "p90": 0.90}
SHADOWS = ("s0", "s1", "s2", "s3", "s4")
#: fixed values: what a merge may be warned of
DANGERS = {"a": "whole smaller side below tau", "b": "more than half of the smaller side below tau", "c": "core overlap below 0.6", "d": "both sides have boards below tau", "e": "weakest board below tau - 0.10"}
#: fixed values: why a larger side holds boards below tau
ATTRIBUTION = ("all historical", "partly historical", "none historical", "larger side whole")


def nearest_ranks(rows: DataFrame, keys: list[str], value: str, *, weight: Column | None = None, ranks: dict[str, float] = RANKS) -> DataFrame:
    """(keys, n, min, one column a rank, max) of ``value`` by nearest rank, rounded half to even; nulls are left out."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.sum(F.lit(1) if weight is None else weight).alias("__n"))
    group = Window.partitionBy(*keys)
    placed = counts.withColumns({"__upto": F.sum("__n").over(group.orderBy("__v")), "__all": F.sum("__n").over(group)})
    at = lambda p: F.min(F.when(F.col("__upto") > F.bround(F.lit(p) * (F.col("__all") - 1)), F.col("__v")))
    return placed.groupBy(*keys).agg(F.max("__all").alias("n"), F.min("__v").alias("min"), *[at(p).alias(name) for name, p in ranks.items()], F.max("__v").alias("max"))


def _prefixed(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c not in keys])


def attempt_details(run: MergeRun, *, within: list[str] = WITHIN, rules: MergeRules | None = None) -> DataFrame:
    """One row a pair judged by similarity: sides, cores, overlap, similarities before and after, tails, the weakest board.

    Pairs whose merged core wears away are judged by that alone and have no row here.
    """
    rules = rules or MergeRules()
    keys = [*within, "attempt"]
    rows = run.attempts.where("verdict <> 'core'")
    posts = run.posts.where("verdict <> 'core'")
    some = {"p05": 0.05, "p10": 0.10, "median": 0.5}
    few = lambda frame, value: nearest_ranks(frame, keys, value, weight=F.col("n"), ranks=some).drop("n", "max")
    summaries = [_prefixed(few(posts, "post"), keys, "post"), _prefixed(few(posts, "pre"), keys, "pre")]
    summaries += [_prefixed(few(posts.where(F.col("side") == side), "pre"), keys, f"pre_{side}") for side in ("a", "b")]
    low = posts.where(F.col("post") < rules.tau).withColumn("short", rules.tau - F.col("post"))
    short = low.groupBy(*keys).agg(F.max("short").alias("shortfall_max"), (F.sum(F.col("short") * F.col("n")) / F.sum("n")).alias("shortfall_mean"))
    rows = reduce(lambda left, right: left.join(right, keys), summaries, rows).join(short, keys, "left")
    weak = {"weakest_side": "side", "weakest_before": "pre", "weakest_after": "post"}
    rows = rows.withColumns({**{k: F.col(f"weakest.{v}") for k, v in weak.items()}, **{f"weakest_{c}": F.col(f"weakest.cell.{c}") for c in BOARD}})
    identical = (F.size("a_only") == 0) & (F.size("b_only") == 0)
    either = F.array_union("a_core", "b_core")
    cores = {"identical": identical, "dropped": F.array_except(either, "merged_core"), "gained": F.array_except("merged_core", either)}
    return rows.withColumns(cores).withColumn("shortfall", rules.tau - F.col("weakest_after")).drop("weakest", "key", "a_version", "b_version")


def shadow_rules(details: DataFrame, *, rules: MergeRules | None = None) -> DataFrame:
    """``details`` with what other rules would have said (s0 to s4), and the dangers of the merge."""
    rules = rules or MergeRules()
    c = s2_conditions(rules.tau, rules.floor)
    s1 = c["merged_hundredth"] & c["floor"]
    s2 = s1 & c["larger_side_whole"] & c["smaller_side_tenth"]
    alike = (F.col("overlap") >= 0.8) | F.col("identical") | F.col("splash")
    s4 = (F.col("post_p10") >= rules.tau) & (F.col("post_median") >= rules.tau + 0.05) & c["floor"]
    said = {"s0": F.col("merged_below") == 0, "s1": s1, "s2": s2, "s3": s2 & alike, "s4": s4}
    danger = {
        "a": F.col("smaller_below") == F.col("smaller_boards"), "b": 2 * F.col("smaller_below") > F.col("smaller_boards"), "c": (F.col("overlap") < 0.6) & ~F.col("identical"),
        "d": (F.col("larger_below") > 0) & (F.col("smaller_below") > 0), "e": F.col("min_post") < rules.tau - rules.floor,
    }
    flags = F.array_compact(F.array(*[F.when(is_so, F.lit(DANGERS[k])) for k, is_so in danger.items()]))
    return details.withColumns(said).withColumn("dangers", flags)


def shadow_evaluation(shadows: DataFrame, *, within: list[str] = WITHIN) -> DataFrame:
    """(window, rule, attempts, accepted, recovered, lost, net, dangers, shared_s0 .. shared_s4).

    Recovered: accepted by the rule, turned down by the run; lost: the other way round. ``dangers`` counts
    them over what the rule accepts; ``shared_*`` are recoveries that another rule has too.
    """
    real = F.col("verdict") == "accepted"
    won = lambda s: F.col(s) & ~real
    told = F.array(*[F.struct(F.lit(s).alias("rule"), F.col(s).alias("yes"), won(s).alias("won"), (real & ~F.col(s)).alias("lost"), *[(won(s) & won(t)).alias(f"shared_{t}") for t in SHADOWS]) for s in SHADOWS])
    rows = shadows.select(*within, "dangers", F.inline(told))
    sums = {"accepted": "yes", "recovered": "won", "lost": "lost"} | {f"shared_{t}": f"shared_{t}" for t in SHADOWS}
    dangers = [F.sum(F.when(F.col("yes") & F.array_contains("dangers", text), 1).otherwise(0)).alias(f"danger_{k}") for k, text in DANGERS.items()]
    out = rows.groupBy(*within, "rule").agg(F.count(F.lit(1)).alias("attempts"), *[F.count_if(F.col(c)).alias(n) for n, c in sums.items()], *dangers)
    return out.withColumn("net", F.col("recovered") - F.col("lost"))


def overlap_band(overlap: Column) -> Column:
    return F.when(overlap >= 0.8, ">= 0.8").when(overlap >= 0.6, "[0.6, 0.8)").otherwise("< 0.6")


def merge_histograms(details: DataFrame, *, within: list[str] = WITHIN) -> DataFrame:
    """(window, verdict, measure, bucket, attempts) of tails, overlaps, sizes and the weakest board's fall."""
    fall = F.col("weakest_before") - F.col("weakest_after")
    size = lambda x: banded(x, [("<= 0.01", 0.01), ("(0.01, 0.05]", 0.05), ("(0.05, 0.10]", 0.10)], "> 0.10")
    buckets = {
        "tail": tail_band(F.col("merged_below"), F.col("merged_boards")), "overlap": overlap_band(F.col("overlap")), "boards": size_band(F.col("merged_boards")),
        "fall": F.when(fall <= 0, "none").otherwise(size(fall)), "distance": size(F.abs("shortfall")),
    }
    long = details.select(*within, "verdict", F.inline(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("bucket")) for k, v in buckets.items()])))
    return long.groupBy(*within, "verdict", "measure", "bucket").agg(F.count(F.lit(1)).alias("attempts"))


MEASURES = ("merged_boards", "smaller_boards", "merged_below", "overlap", "min_post", "post_p10", "post_median", "shortfall")


def measure_quantiles(details: DataFrame, by: list[str], measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """(by, measure, n, min, ranks, max) of attempt measures."""
    long = details.select(*by, F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])))
    return nearest_ranks(long, [*by, "measure"], "value")


def variant_band(variants: Column) -> Column:
    return banded(variants, [("2", 2), ("3-4", 4), ("5-9", 9)], "10+")


def merge_trajectory(details: DataFrame, *, within: list[str] = WITHIN) -> DataFrame:
    """(window, band, measure, merges, tailed, n, min, ranks, max) of accepted merges by the variants that they hold.

    Each merge is measured when it was made; ``tailed`` counts those that took in a board below tau.
    """
    rows = details.where("verdict = 'accepted'").withColumn("share_below", F.col("merged_below") / F.col("merged_boards"))
    rows = rows.withColumn("band", variant_band(F.col("a_variants") + F.col("b_variants")))
    sizes = rows.groupBy(*within, "band").agg(F.count(F.lit(1)).alias("merges"), F.count_if(F.col("merged_below") > 0).alias("tailed"))
    return sizes.join(measure_quantiles(rows, [*within, "band"], ("min_post", "post_p10", "share_below")), [*within, "band"])


def tail_lock_in(run: MergeRun, *, within: list[str] = WITHIN, rules: MergeRules | None = None) -> tuple[DataFrame, DataFrame]:
    """(admissions, entries): boards that merges took in below tau, and what they do to later attempts.

    An admission is (window, cell, boards, attempt, side, role, similarity): a kind of board that an accepted
    merge left below tau; ``first`` marks its first one. An entry is a row an attempt: how many boards of each
    side an earlier merge had taken in below tau (historical ones), how many of the larger side's boards
    below tau are such, which conditions of the rule failed, and, for a refused attempt whose larger side
    holds historical boards, the verdict without them: their weights are taken from the sums of both
    sides, sides are told apart anew by their size, and the same conditions are judged.
    """
    rules = rules or MergeRules()
    tau = rules.tau
    keys, kind = [*within, "attempt"], [*within, "variant", "cell"]
    attempts = run.attempts.where("verdict <> 'core'")
    posts = run.posts.where("verdict <> 'core'").withColumn("low", F.col("post") < tau)
    larger = F.col("side") == F.col("larger")
    taken = posts.where("verdict = 'accepted' and low").withColumn("role", F.when(larger, "larger").otherwise("smaller"))
    first = taken.groupBy(*kind).agg(F.min("attempt").alias("since"))
    admissions = taken.join(first, kind).select(*kind, F.col("n").alias("boards"), "attempt", "side", "role", F.col("post").alias("similarity"), (F.col("attempt") == F.col("since")).alias("first"))

    told = posts.join(first, kind, "left").withColumn("old", F.coalesce(F.col("since") < F.col("attempt"), F.lit(False)))
    boards = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    entry = told.groupBy(*keys).agg(
        boards(F.col("old") & (F.col("side") == "a")).alias("historical_a"), boards(F.col("old") & (F.col("side") == "b")).alias("historical_b"), boards(F.col("old") & larger).alias("larger_historical"),
        boards(F.col("old") & larger & F.col("low")).alias("larger_below_historical"), boards(~F.col("old") & larger & F.col("low")).alias("larger_below_other"), boards(F.col("low")).alias("admitted"),
        boards(F.col("low") & F.coalesce(F.col("since") == F.col("attempt"), F.lit(False))).alias("newly_admitted"),
    )
    conditions = s2_conditions(tau, rules.floor)
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in conditions.items()]))
    below, other = F.col("larger_below_historical"), F.col("larger_below_other")
    why = F.when(below + other == 0, ATTRIBUTION[3]).when(other == 0, ATTRIBUTION[0]).when(below > 0, ATTRIBUTION[1]).otherwise(ATTRIBUTION[2])
    accepted = F.col("verdict") == "accepted"
    entries = attempts.select(*keys, "verdict", "larger", "larger_boards", failed.alias("failed")).join(entry, keys)
    entries = entries.withColumns({"attribution": why, "admitted": F.when(accepted, F.col("admitted")).otherwise(0), "newly_admitted": F.when(accepted, F.col("newly_admitted")).otherwise(0)})

    judged = told.join(entries.where("verdict = 'similarity' and larger_historical > 0").select(*keys), keys, "left_semi")
    kept = judged.where(~(F.col("old") & larger))
    units = kept.select(*keys, "n", F.inline("vector")).groupBy(*keys, "unit").agg(F.sum(F.col("n") * F.col("weight")).alias("s"))
    sizes = kept.groupBy(*keys).agg(F.sum("n").alias("left"), boards(F.col("side") == "a").alias("left_a"), boards(F.col("side") == "b").alias("left_b"))
    profile = units.join(sizes.select(*keys, "left"), keys).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("unit", (F.col("s") / F.col("left")).alias("w")))).alias("profile"), F.sum(F.col("s") / F.col("left")).alias("profile_sum"))
    low_sum = F.aggregate("vector", F.lit(0.0), lambda so_far, x: so_far + F.least(x["weight"], F.coalesce(F.try_element_at("profile", x["unit"]), F.lit(0.0))))
    again = kept.join(profile, keys).withColumn("now", _ruzicka(low_sum, F.col("total"), F.col("profile_sum"))).join(sizes, keys)
    new_larger = F.when(F.col("left_a") >= F.col("left_b"), "a").otherwise("b")
    is_larger, is_low = F.col("side") == new_larger, F.col("now") < tau
    after = again.groupBy(*keys).agg(
        boards(is_larger & is_low).alias("larger_below"), boards(~is_larger & is_low).alias("smaller_below"), boards(is_low).alias("merged_below"), F.min("now").alias("min_post"),
        F.min(F.least("left_a", "left_b")).alias("smaller_boards"), F.min(F.greatest("left_a", "left_b")).alias("larger_left"), F.max("left").alias("merged_boards"), F.first(new_larger).alias("new_larger"), F.first("larger").alias("old_larger"),
    )
    # nothing is left to merge with where every board of the larger side goes
    whole = judged.groupBy(*keys).agg(boards(larger & ~F.col("old")).alias("larger_kept"))
    after = after.join(whole, keys).where("larger_kept > 0")
    verdict = after.select(*keys, failed.alias("failed_without"), "merged_boards", "merged_below", F.col("min_post").alias("min_without"), (F.col("new_larger") != F.col("old_larger")).alias("flipped"))
    out = entries.join(_renamed(verdict, keys, {"merged_boards": "boards_without", "merged_below": "below_without"}), keys, "left")
    eligible = (F.col("verdict") == "similarity") & (F.col("larger_historical") > 0)
    passes = F.when(eligible, F.coalesce(F.size("failed_without") == 0, F.lit(False)))
    return admissions, out.withColumns({"eligible": eligible, "passes_without": passes})


def _renamed(df: DataFrame, keys: list[str], names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns])


def lock_in_counts(admissions: DataFrame, entries: DataFrame, *, within: list[str] = WITHIN) -> DataFrame:
    """One row a window: merges, those with a tail, boards taken in below tau, refusals, and what they are owed to."""
    whole = F.col("attribution") != ATTRIBUTION[3]
    refused = F.col("verdict") == "similarity"
    counts = {
        "merges": F.col("verdict") == "accepted", "tailed": F.col("admitted") > 0, "refused": refused, "larger_refused": refused & whole, "all_historical": refused & (F.col("attribution") == ATTRIBUTION[0]),
        "part_historical": refused & (F.col("attribution") == ATTRIBUTION[1]), "eligible": F.col("eligible"), "recovered": F.coalesce(F.col("passes_without"), F.lit(False)),
    }
    rows = entries.groupBy(*within).agg(*[F.count_if(test).alias(name) for name, test in counts.items()], F.sum("newly_admitted").alias("boards_admitted"))
    events = admissions.groupBy(*within).agg(F.sum("boards").alias("events"), F.sum(F.when(F.col("role") == "larger", F.col("boards")).otherwise(0)).alias("events_larger"))
    return rows.join(events, within, "left").fillna(0, ["events", "events_larger"])


def family_lineage(vectors: DataFrame, families: DataFrame, *, within: list[str] = WITHIN, rules: MergeRules | None = None) -> DataFrame:
    """One row a family: boards, variants merged in, boards below tau, weakest and median similarity, final core, drift.

    Drift is one less the overlap of the final core with the core of the family's largest variant (ties: the lowest number).
    """
    rules = rules or MergeRules()
    board = [*within, *[c for c in BOARD if c not in within]]
    on = [c for c in board if c in vectors.columns]
    held = vectors.join(families, on)
    group = [*within, "group"]

    def cores(keys: list[str]) -> DataFrame:
        sizes = families.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
        units = held.groupBy(*keys, "unit").agg(F.count(F.lit(1)).alias("c"), F.sum("weight").alias("s")).join(sizes, keys)
        share = F.col("c") / F.col("size")
        core = F.array_compact(F.array_sort(F.collect_list(F.when(share >= rules.core, F.col("unit")))))
        return units.groupBy(*keys).agg(F.first("size").alias("boards"), core.alias("core"), F.map_from_entries(F.collect_list(F.struct("unit", (F.col("s") / F.col("size")).alias("w")))).alias("profile"), F.sum(F.col("s") / F.col("size")).alias("profile_sum"))

    final = cores(group)
    largest = cores([*group, "variant"]).groupBy(*group).agg(F.count(F.lit(1)).alias("variants"), F.max_by("core", F.struct("boards", -F.col("variant"))).alias("base"))
    lists = held.groupBy(*board, "group").agg(F.array_sort(F.collect_list(F.struct("unit", "weight"))).alias("vector"), F.sum("weight").alias("total"))
    kinds = lists.groupBy(*group, "vector", "total").agg(F.count(F.lit(1)).alias("n"))
    low = F.aggregate("vector", F.lit(0.0), lambda so_far, x: so_far + F.least(x["weight"], F.coalesce(F.try_element_at("profile", x["unit"]), F.lit(0.0))))
    own = kinds.join(final.select(*group, "profile", "profile_sum"), group).withColumn("similarity", _ruzicka(low, F.col("total"), F.col("profile_sum")))
    below = own.groupBy(*group).agg(F.sum(F.when(F.col("similarity") < rules.tau, F.col("n")).otherwise(0)).alias("below"))
    # the lower median: the element at (n - 1) div 2
    lower = Window.partitionBy(*group)
    counts = own.groupBy(*group, "similarity").agg(F.sum("n").alias("n"))
    placed = counts.withColumns({"upto": F.sum("n").over(lower.orderBy("similarity")), "size": F.sum("n").over(lower)})
    middle = placed.groupBy(*group).agg(F.min("similarity").alias("weakest"), F.min(F.when(F.col("upto") > F.floor((F.col("size") - 1) / 2), F.col("similarity"))).alias("median"))
    rows = final.drop("profile", "profile_sum").join(largest, group).join(below, group).join(middle, group)
    union = F.size(F.array_union("core", "base"))
    drift = F.when(union > 0, 1 - F.size(F.array_intersect("core", "base")) / union).otherwise(0.0)
    return rows.withColumn("drift", drift).withColumn("core_units", F.size("core")).drop("base")
