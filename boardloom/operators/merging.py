"""Merging variants into families, with the outcome of the one-pair-at-a-time greedy pass.

The greedy pass judges the pair of groups whose cores overlap most (ties by a rule, then by an order
of ids), merges it or turns it down, re-scores what the merge touched and goes on until no pair is
left. Here a round takes many steps of that pass at once, in each window on its own:

* A verdict depends on the two groups alone, so judging ahead of time does no harm, and pairs of the
  same two groups are measured once however many orders of the pass meet them.
* Accepted pairs that come first at both ends lead. What their merges would bring about is measured
  before any of them is made.
* Leading pairs are merged in order of their keys up to the first accepted pair that comes in between:
  one that is still open, or one that a merge before it brings about.
* Pairs turned down whose turn comes before the last of these merges are recorded, those that the
  merges bring about among them; pairs of merged groups lapse.

The loop ends when no window has a pair to merge. Groups are kept as sums over the units of their
boards, so a merge adds two rows; boards with equal vectors in one variant are one row with a count.
A group is named by a digest of its variants, 128 bits. Similarities are rounded to nine digits before
they are compared.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardloom.functions.rules import tie_hash, unsigned_order
from boardloom.operators.ranks import spread_row_number
from boardloom.sources.shared import discard, staged, together

WITHIN = ["balance_window"]
BOARD = ["match_id", "participant_index"]
DIGITS = 9
#: How pairs of equal overlap are ranked before the order of ids; the most similar first.
TIE_RULES = ("centroid", "least member", "mean member")
#: The order of ids: lowest first, highest first, or a seeded permutation.
TIE_ORDERS = ("baseline", "reversed", "seeded")


@dataclass(frozen=True)
class MergeRules:
    """When two groups may merge, and what a merge must keep."""

    tau: float = 0.60
    core: float = 0.75
    shared: int = 3
    shared_fraction: float = 0.6
    swaps: int = 1
    flex: float = 0.15
    itemized: float = 0.5
    whole_core: int = 5
    kept_core: float = 0.6
    floor: float = 0.10
    #: "all": no board below tau after a merge; "s2": the rule for tails.
    tails: str = "all"


@dataclass
class MergeRun:
    """families (board, variant, group); attempts, a row a judged pair in order; posts, a row a kind of board in an attempt.

    ``groups`` (variant, group, boards) says the same as the families without a row a board.
    """

    families: DataFrame
    attempts: DataFrame
    posts: DataFrame | None
    rounds: int = field(default=0)
    groups: DataFrame | None = field(default=None)


def variant_cells(vectors: DataFrame, variants: DataFrame, within: list[str]) -> DataFrame:
    """(window, variant, cell, n, total, vector): the distinct vectors of a variant; ``cell`` is its first board.

    Variants that bring their ``vector`` and its ``total`` along need no join with the vectors.
    """
    board = [*within, *[c for c in BOARD if c not in within]]
    number = F.col("group").cast("long").alias("variant")
    if "vector" in variants.columns:
        lists = variants.select(*board, number, "vector", "total")
        return lists.groupBy(*within, "variant", "vector").agg(F.min(F.struct(*BOARD)).alias("cell"), F.count(F.lit(1)).alias("n"), F.first("total").alias("total"))
    held = vectors.join(variants.select(*board, number), [c for c in board if c in vectors.columns])
    lists = held.groupBy(*board, "variant").agg(F.array_sort(F.collect_list(F.struct("unit", "weight"))).alias("vector"), F.sum("weight").alias("total"))
    return lists.groupBy(*within, "variant", "vector").agg(F.min(F.struct(*BOARD)).alias("cell"), F.count(F.lit(1)).alias("n"), F.first("total").alias("total"))


def _name(parts: Column) -> Column:
    return F.md5(F.array_join(parts.cast("array<string>"), "+"))


def _first_groups(cells: DataFrame, within: list[str]) -> DataFrame:
    """A group for each variant: (window, id, g: its least variant, boards, variants, stats: unit -> boards, itemized boards, sum of weights; parts)."""
    long = cells.select(*within, F.col("variant").alias("g"), "n", F.inline("vector"))
    unit = long.groupBy(*within, "g", "unit").agg(F.sum("n").alias("c"), F.sum(F.when(F.col("weight") >= 2, F.col("n")).otherwise(0)).alias("i"), F.sum(F.col("n") * F.col("weight")).alias("s"))
    stats = unit.groupBy(*within, "g").agg(F.map_from_entries(F.collect_list(F.struct("unit", F.struct("c", "i", "s")))).alias("stats"))
    sizes = cells.groupBy(*within, F.col("variant").alias("g")).agg(F.sum("n").alias("boards"))
    return sizes.join(stats, [*within, "g"]).select(*within, _name(F.array("g")).alias("id"), "g", "boards", F.lit(1).alias("variants"), "stats", F.array("g").alias("parts"))


def _added(x: Column, y: Column) -> Column:
    """Two maps of unit statistics, added."""
    zero = F.struct(F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("i"), F.lit(0.0).alias("s"))

    def both(_, a, b):
        a, b = F.coalesce(a, zero), F.coalesce(b, zero)
        return F.struct((a["c"] + b["c"]).alias("c"), (a["i"] + b["i"]).alias("i"), (a["s"] + b["s"]).alias("s"))

    return F.map_zip_with(x, y, both)


def _merged_groups(groups: DataFrame, pairs: DataFrame, within: list[str]) -> DataFrame:
    """The group that each pair (window, a_id, b_id, id) makes, under its id; ``g`` is that of a, the lower one."""
    side = lambda x: groups.select(*within, *[F.col(c).alias(f"{x}_{c}") for c in ("id", "g", "boards", "variants", "stats", "parts")])
    both = pairs.select(*within, "id", "a_id", "b_id").join(side("a").hint("merge"), [*within, "a_id"]).join(side("b").hint("merge"), [*within, "b_id"])
    return both.select(
        *within, "id", F.col("a_g").alias("g"), (F.col("a_boards") + F.col("b_boards")).alias("boards"), (F.col("a_variants") + F.col("b_variants")).alias("variants"),
        _added(F.col("a_stats"), F.col("b_stats")).alias("stats"), F.array_sort(F.concat("a_parts", "b_parts")).alias("parts"),
    )


def _core(stats: Column, boards: Column, share: float) -> Column:
    return F.array_sort(F.map_keys(F.map_filter(stats, lambda _, v: v["c"] / boards >= share)))


def scored_pairs(groups: DataFrame, within: list[str], rules: MergeRules, fresh: DataFrame | None = None) -> DataFrame:
    """Pairs a < b of groups without a common variant that may merge, with their sides, cores and overlap.

    Of ``fresh`` (window, id), if given, each pair has one at least. Cores share enough units, at most
    ``swaps`` units differ on one side, and every differing unit is explained: held by enough boards of
    the other side, rarely itemized on its own, or the one addition to a whole shared core.
    """
    known = groups.withColumn("core", _core(F.col("stats"), F.col("boards"), rules.core))
    of = lambda frame, x, *more: frame.select(*within, F.explode("core").alias("unit"), F.col("id").alias(f"{x}_id"), F.col("g").alias(x), *more)
    if fresh is None:
        near = of(known, "a").join(of(known, "b"), [*within, "unit"]).where("a < b")
    else:
        marked = known.join(fresh.select(*within, "id", F.lit(True).alias("fresh")).distinct(), [*within, "id"], "left")
        met = of(marked.where("fresh"), "x").join(of(marked, "y", "fresh"), [*within, "unit"]).where("x <> y and (fresh is null or x < y)")
        low, other = F.when(F.col("x") < F.col("y"), "x").otherwise("y"), F.when(F.col("x") < F.col("y"), "y").otherwise("x")
        pick = lambda side, c: F.when(side == "x", F.col(f"x{c}")).otherwise(F.col(f"y{c}"))
        near = met.select(*within, pick(low, "_id").alias("a_id"), pick(other, "_id").alias("b_id"))
    near = near.groupBy(*within, "a_id", "b_id").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= rules.shared)
    side = lambda x: known.select(*within, F.col("id").alias(f"{x}_id"), F.col("g").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("boards", "variants", "stats", "parts", "core")])
    rows = near.join(side("a").hint("merge"), [*within, "a_id"]).join(side("b").hint("merge"), [*within, "b_id"]).where(~F.arrays_overlap("a_parts", "b_parts"))
    rows = rows.withColumns({"a_only": F.array_except("a_core", "b_core"), "b_only": F.array_except("b_core", "a_core")})
    need = F.greatest(F.lit(rules.shared), F.ceil(F.lit(rules.shared_fraction) * F.greatest(F.size("a_core"), F.size("b_core"))))
    splash = (F.col("shared") >= rules.whole_core) & (F.size("a_only") + F.size("b_only") == 1)
    rows = rows.where((F.col("shared") >= need) & (F.least(F.size("a_only"), F.size("b_only")) <= rules.swaps)).withColumn("splash", splash)

    def explained(x: str, y: str) -> Column:
        held = lambda u: F.coalesce(F.try_element_at(F.col(f"{y}_stats"), u)["c"], F.lit(0)) / F.col(f"{y}_boards") >= rules.flex
        bare = lambda u: F.try_element_at(F.col(f"{x}_stats"), u)["i"] / F.try_element_at(F.col(f"{x}_stats"), u)["c"] < rules.itemized
        return F.forall(f"{x}_only", lambda u: held(u) | bare(u))

    rows = rows.where(F.col("splash") | (explained("a", "b") & explained("b", "a")))
    return rows.withColumn("overlap", F.col("shared") / F.size(F.array_union("a_core", "b_core")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def _ruzicka(low: Column, x: Column, y: Column) -> Column:
    return F.round(low / (x + y - low), DIGITS)


def _vector_similarity(profile: str, total: str) -> Column:
    """Of the row's ``vector`` to a profile map with the sum ``total``."""
    low = F.aggregate("vector", F.lit(0.0), lambda so_far, x: so_far + F.least(x["weight"], F.coalesce(F.try_element_at(F.col(profile), x["unit"]), F.lit(0.0))))
    return _ruzicka(low, F.col("total"), F.col(total))


def _with_profiles(pairs: DataFrame) -> DataFrame:
    """Profiles of both sides and of the merged group, each with its sum."""
    own = lambda x: F.transform_values(f"{x}_stats", lambda _, v: v["s"] / F.col(f"{x}_boards"))
    merged = F.transform_values("stats", lambda _, v: v["s"] / (F.col("a_boards") + F.col("b_boards")))
    rows = pairs.withColumn("stats", _added(F.col("a_stats"), F.col("b_stats")))
    rows = rows.withColumns({"a_profile": own("a"), "b_profile": own("b"), "profile": merged})
    return rows.withColumns({f"{p}_sum": _sum(F.map_values(p)) for p in ("a_profile", "b_profile", "profile")})


def s2_conditions(tau: float = 0.60, floor: float = 0.10) -> dict[str, Column]:
    """The rule for tails over attempt rows: what may lie below ``tau`` after a merge."""
    return {
        "larger_side_whole": F.col("larger_below") == 0,
        "smaller_side_tenth": 10 * F.col("smaller_below") <= F.col("smaller_boards"),
        "merged_hundredth": 100 * F.col("merged_below") <= F.col("merged_boards"),
        "floor": F.col("min_post") >= tau - floor,
    }


def _key(ranked: Column, mode: Column, seed: Column) -> Column:
    """What pairs are ordered by: most overlap, then the tie rule, then the order of ids; the smallest comes first."""
    drawn = unsigned_order(tie_hash(seed, F.col("a"), F.col("b"), F.col("a_version"), F.col("b_version")))
    sign = F.when(mode == TIE_ORDERS[1], -1).otherwise(1)
    return F.struct((-F.col("overlap")).alias("overlap"), ranked.alias("rule"), F.when(mode == TIE_ORDERS[2], drawn).otherwise(F.lit(0).cast("long")).alias("draw"), (sign * F.col("a")).alias("a"), (sign * F.col("b")).alias("b"))


#: What an attempt tells of its pair, whatever the order in which it came.
TOLD = ["a_boards", "b_boards", "a_variants", "b_variants", "a_core", "b_core", "a_only", "b_only", "merged_core", "shared", "overlap", "splash", "larger"]
TOLD += ["larger_boards", "smaller_boards", "larger_below", "smaller_below", "merged_boards", "merged_below", "min_post", "weakest"]


def _measured(pairs: DataFrame, cells: DataFrame, within: list[str], rules: MergeRules, keep_posts: bool) -> tuple[DataFrame, DataFrame | None]:
    """(pairs with all that verdicts and keys are made of; posts: similarity of each kind of board before and after, if kept).

    Sums and profiles of groups are maps, many times larger in memory than on disk, so joins with them are never broadcast.
    """
    rows = _with_profiles(pairs)
    rows = rows.withColumn("merged_core", _core(F.col("stats"), F.col("a_boards") + F.col("b_boards"), rules.core))
    lost = lambda x: F.size(F.array_intersect("merged_core", f"{x}_core")) < F.ceil(F.lit(rules.kept_core) * F.size(f"{x}_core"))
    no_larger = lambda x, y: F.size(f"{x}_core") <= F.size(f"{y}_core")
    worn = (F.size("merged_core") < rules.whole_core) & ((no_larger("a", "b") & lost("a")) | (no_larger("b", "a") & lost("b")))
    both = F.aggregate(F.map_values(F.map_zip_with("a_profile", "b_profile", lambda _, x, y: F.least(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))))), F.lit(0.0), lambda t, x: t + x)
    rows = rows.withColumns({"worn": worn, "centroid": _ruzicka(both, F.col("a_profile_sum"), F.col("b_profile_sum")), "id": _name(F.array_sort(F.concat("a_parts", "b_parts")))})
    rows = staged(rows.drop("stats", "a_stats", "b_stats"))

    pair = [*within, "a_id", "b_id"]
    end = lambda x: rows.select(*pair, F.explode(f"{x}_parts").alias("variant"), F.lit(x).alias("side"), F.col(f"{x}_profile").alias("own"), F.col(f"{x}_profile_sum").alias("own_sum"), "profile", "profile_sum")
    members = cells.join(end("a").unionByName(end("b")).hint("merge"), [*within, "variant"])
    posts = members.select(*pair, "variant", "cell", "side", "n", _vector_similarity("own", "own_sum").alias("pre"), _vector_similarity("profile", "profile_sum").alias("post"))
    posts = staged(posts) if keep_posts else posts

    low = F.col("post") < rules.tau
    told = posts.groupBy(*pair).agg(
        *[F.sum(F.when(low & (F.col("side") == x), F.col("n")).otherwise(0)).alias(f"{x}_below") for x in ("a", "b")],
        F.min("post").alias("min_post"), F.sum(F.col("n") * F.col("post")).alias("sum_post"), F.min(F.struct("post", "cell", "side", "pre")).alias("weakest"),
    )
    out = rows.join(told, pair)
    larger = F.when(F.col("a_boards") >= F.col("b_boards"), "a").otherwise("b")
    of = lambda name, pick_a: F.when(pick_a, F.col(f"a_{name}")).otherwise(F.col(f"b_{name}"))
    is_a = F.col("larger") == "a"
    out = out.withColumn("larger", larger).withColumns(
        {"larger_boards": of("boards", is_a), "smaller_boards": of("boards", ~is_a), "larger_below": of("below", is_a), "smaller_below": of("below", ~is_a), "merged_boards": F.col("a_boards") + F.col("b_boards"), "merged_below": F.col("a_below") + F.col("b_below")}
    )
    done = staged(out.select(*pair, "id", *TOLD, "worn", "centroid", "sum_post"))
    discard(rows)
    return done, posts if keep_posts else None


#: A pair as an order of the pass knows it.
PAIR = ["a", "b", "a_version", "b_version", "a_id", "b_id", "id", "verdict", "key"]


def _judged(pairs: DataFrame, measured: DataFrame, within: list[str], base: list[str], rules: MergeRules, tie_rule: Column, mode: Column, seed: Column, tails: Column) -> DataFrame:
    """``pairs`` (window, order, a, b, versions, a_id, b_id) with verdict and key."""
    used = ["id", "overlap", "worn", "centroid", "sum_post", "min_post", "larger_below", "smaller_below", "smaller_boards", "merged_below", "merged_boards"]
    rows = pairs.join(measured.select(*base, "a_id", "b_id", *used), [*base, "a_id", "b_id"])
    fine = F.when(tails == "all", F.col("merged_below") == 0).otherwise(reduce(Column.__and__, s2_conditions(rules.tau, rules.floor).values()))
    verdict = F.when(F.col("worn"), "core").when(fine, "accepted").otherwise("similarity")
    ranked = F.when(tie_rule == TIE_RULES[0], -F.col("centroid")).when(tie_rule == TIE_RULES[1], -F.col("min_post")).when(tie_rule == TIE_RULES[2], -F.round(F.col("sum_post") / F.col("merged_boards"), DIGITS)).otherwise(0.0)
    more = [c for c in pairs.columns if c not in {*within, *PAIR}]
    return rows.withColumns({"verdict": verdict, "key": _key(ranked + 0.0, mode, seed)}).select(*within, *PAIR, *more)


def _ends(pairs: DataFrame, within: list[str], key: str) -> DataFrame:
    return pairs.select(*within, F.col("a_id").alias("id"), F.col("key").alias(key)).unionByName(pairs.select(*within, F.col("b_id").alias("id"), F.col("key").alias(key)))


def _at(ends: DataFrame, within: list[str], key: str, x: str) -> DataFrame:
    return ends.select(*within, F.col("id").alias(f"{x}_id"), F.col(key).alias(f"{x}_{key}"))


def _ranked(pairs: DataFrame, within: list[str]) -> DataFrame:
    """``pairs`` with ``top``: accepted, and the first accepted one at both ends."""
    fine = pairs.where("verdict = 'accepted'")
    first = _ends(fine, within, "first").groupBy(*within, "id").agg(F.min("first").alias("first"))
    rows = pairs.join(_at(first, within, "first", "a"), [*within, "a_id"], "left").join(_at(first, within, "first", "b"), [*within, "b_id"], "left")
    top = (F.col("verdict") == "accepted") & (F.col("key") == F.col("a_first")) & (F.col("key") == F.col("b_first"))
    return rows.select(*pairs.columns, F.coalesce(top, F.lit(False)).alias("top"))


def _decided(ranked: DataFrame, brought: DataFrame, within: list[str], number: int) -> tuple[DataFrame, DataFrame]:
    """(pairs with ``act``: merge, record (turned down for good), lapse or wait; the key of the last merge of each order).

    ``ranked`` are pairs at hand, ``brought`` those that leading pairs bring about, with the keys of the
    merges that make (``made``) and unmake (``gone``) them.
    """
    leading = ranked.where("top")
    ends = _ends(leading, within, "by")
    held = ranked.join(_at(ends, within, "by", "a"), [*within, "a_id"], "left").join(_at(ends, within, "by", "b"), [*within, "b_id"], "left")
    held = held.withColumn("gone", F.least("a_by", "b_by")).drop("a_by", "b_by")  # null only where neither end leads
    key, made = F.col("key"), F.col("made")
    alive = ~F.coalesce(F.col("gone") < key, F.lit(False))
    pending = held.where("verdict = 'accepted' and not top").where(alive).groupBy(*within).agg(F.min("key").alias("pending"))
    coming = brought.where("verdict = 'accepted'").where(alive).groupBy(*within).agg(F.min(F.greatest("made", "key")).alias("coming"))
    safe = (F.col("pending").isNull() | (key < F.col("pending"))) & (F.col("coming").isNull() | (key <= F.col("coming")))
    last = staged(leading.join(pending, within, "left").join(coming, within, "left").where(safe).groupBy(*within).agg(F.max("key").alias("last")))

    none = F.lit(None).cast(ranked.schema["key"].dataType)
    rows = held.withColumn("made", none).unionByName(brought.withColumn("top", F.lit(False))).join(last, within, "left")
    rows = rows.where("made is null or made <= last").withColumn("gone", F.when(F.col("gone") <= F.col("last"), F.col("gone")))
    turn = F.greatest("made", "key")
    in_time = (F.col("gone").isNull() | (turn < F.col("gone"))) & (F.col("last").isNull() | (turn < F.col("last")))
    act = F.when(F.col("top") & (key <= F.col("last")), "merge").when((F.col("verdict") != "accepted") & in_time, "record").when(F.col("gone").isNotNull(), "lapse").otherwise("wait")
    # a pair that is brought about behind its key comes right after the merge that made it
    late = F.coalesce(key < made, F.lit(False))
    return staged(rows.select(*within, *PAIR, turn.alias("turn"), late.alias("late"), act.alias("act"), F.lit(number).alias("round"))), last


def merge_in_order(
    vectors: DataFrame, variants: DataFrame, *, within: list[str] = WITHIN, rules: MergeRules | None = None,
    tie_rule: str | Column = "", mode: str | Column = "baseline", seed: int | Column = 0, tails: str | Column | None = None, orders: Column | None = None, keep_posts: bool = True,
) -> MergeRun:
    """Merge ``variants`` (window, board, group: whole numbers) of boards with ``vectors`` (window, board, unit, weight).

    ``within`` may have columns beyond the window; ``tie_rule``, ``mode``, ``seed`` and ``tails`` may be columns of it,
    so that many orders run side by side. ``orders``, an array of structs, brings such columns along once
    equal boards are one row; the families are then not written, as they repeat every board for each order.
    Without ``keep_posts`` the run has no ``posts``.
    """
    rules = rules or MergeRules()
    tie_rule, mode, seed, tails = (x if isinstance(x, Column) else F.lit(x) for x in (tie_rule, mode, seed, rules.tails if tails is None else tails))
    how = (within, base := [c for c in within if c in variants.columns], rules, tie_rule, mode, seed, tails)
    cells = staged(variant_cells(vectors, variants, base))
    groups, measured, posts, acts = [staged(_first_groups(cells, base))], [], [], []

    def measure(pairs: DataFrame) -> None:
        found, post = _measured(pairs, cells, base, rules, keep_posts)
        measured.append(found)
        posts.extend([post] if keep_posts else [])

    first = groups[0].select(*base, "id", "g", F.lit(0).alias("version"))
    live = staged(first if orders is None else first.select("*", F.inline(orders)))
    measure(scored_pairs(groups[0], base, rules))
    of = lambda x: live.select(*within, *[F.col(c).alias(x if c == "g" else f"{x}_{c}") for c in ("id", "g", "version")])
    met = measured[0].select(*base, "a_id", "b_id").join(of("a"), [*base, "a_id"]).join(of("b"), [*within, "b_id"])
    waiting = _judged(met, measured[0], *how)
    while True:
        ranked = staged(_ranked(waiting, within))
        leading = ranked.where("top")
        if leading.isEmpty():
            turns = {"turn": F.col("key"), "late": F.lit(False), "act": F.lit("record"), "round": F.lit(len(acts))}
            acts.append(staged(ranked.withColumns(turns).drop("top")))
            discard(ranked)
            break
        made = leading.select(*base, "a_id", "b_id", "id").dropDuplicates([*base, "id"])
        stock = together(*groups)
        groups.append(staged(_merged_groups(stock, made.join(stock.select(*base, "id"), [*base, "id"], "left_anti"), base)))
        none = F.lit(None).cast(ranked.schema["key"].dataType)
        own = live.join(_ends(leading, within, "gone"), [*within, "id"], "left").select(*within, "id", "g", "version", none.alias("made"), "gone")
        new = leading.select(*within, "id", F.col("a").alias("g"), (F.col("a_version") + 1).alias("version"), F.col("key").alias("made"), none.alias("gone"))
        there = staged(own.unionByName(new))
        alive = together(*groups).join(there.select(*base, "id").distinct(), [*base, "id"], "left_semi")
        scored = staged(scored_pairs(alive, base, rules, fresh=made))
        side = lambda x: there.select(*within, *[F.col(c).alias(x if c == "g" else f"{x}_{c}") for c in ("id", "g", "version", "made", "gone")])  # noqa: B023, E731
        both = scored.select(*base, "a_id", "b_id").join(side("a"), [*base, "a_id"]).join(side("b"), [*within, "b_id"])
        both = both.withColumns({"made": F.greatest("a_made", "b_made"), "gone": F.least("a_gone", "b_gone")}).where("made is not null and (gone is null or made < gone)")
        both = staged(both.drop("a_made", "b_made", "a_gone", "b_gone"))
        wanted = both.select(*base, "a_id", "b_id").distinct().join(together(*measured).select(*base, "a_id", "b_id"), [*base, "a_id", "b_id"], "left_anti")
        measure(scored.join(wanted, [*base, "a_id", "b_id"], "left_semi"))
        brought = staged(_judged(both, together(*measured), *how))
        decided, last = _decided(ranked, brought, within, len(acts))
        acts.append(decided)
        waiting = decided.where("act = 'wait'").select(*within, *PAIR)
        upto = there.join(last, within, "left").where("(made is null or made <= last) and not coalesce(gone <= last, false)")
        live_now = staged(upto.select(*within, "id", "g", "version"))
        discard(live, ranked, there, scored, both, brought, last)
        live = live_now
    rounds = len(acts)
    pair = [*base, "a_id", "b_id"]
    turns = together(*acts).where("act in ('merge', 'record')").drop("act", "id")
    numbered = spread_row_number(turns, within, [F.col(c) for c in ("round", "turn", "late", "key")], "attempt").withColumn("attempt", (F.col("attempt") - 1).cast("int"))
    named = staged(numbered.join(together(*measured).select(*pair, *TOLD), pair))
    attempts = staged(named.select(*within, "a", "b", "a_version", "b_version", *TOLD, "verdict", "key", "round", "attempt"))
    kept = None
    if keep_posts:
        told = together(*posts).join(named.select(*within, "a", "b", "a_id", "b_id", "attempt", "verdict", "larger"), pair).drop("a_id", "b_id")
        kept = staged(told.join(cells.select(*base, "variant", "cell", "total", "vector"), [*base, "variant", "cell"]))

    sized = live.join(together(*groups).select(*base, "id", "boards", "parts"), [*base, "id"])
    placed = spread_row_number(sized, within, [F.desc("boards"), F.col("g")], "rank")
    boards = cells.groupBy(*base, "variant").agg(F.sum("n").alias("boards"))
    told = placed.select(*within, F.explode("parts").alias("variant"), (F.col("rank") - 1).cast("string").alias("group")).join(boards, [*base, "variant"])
    final = staged(told.select(*within, "variant", "group", "boards"))
    board = [*base, *[c for c in BOARD if c not in base]]
    found = variants.select(*board, F.col("group").cast("long").alias("variant")).join(final.drop("boards"), [*base, "variant"])
    families = found.select(*within, *[c for c in board if c not in within], "variant", "group")
    families = families if orders is not None else staged(families)
    discard(cells, live, named, *groups, *measured, *posts, *acts)
    return MergeRun(families, attempts, kept, rounds, final)
