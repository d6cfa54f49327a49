"""Variants of boards: the leader pass with means that move, and refinement with an end of its own for each window.

Boards with equal vectors always share a group, so both work on distinct vectors with counts ("kinds",
numbered in structural order: more units first, then the sorted vector). Groups have whole numbers.
A board is compared with the groups that share two units held by at least 30% of their boards;
similarities are rounded to nine digits, and ties go to the lowest number.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardloom.operators.merging import BOARD, DIGITS, WITHIN, MergeRules, _ruzicka, _sum, merge_in_order
from boardloom.operators.ranks import spread_row_number
from boardloom.sources.shared import discard, staged

TAU = 0.60
PRESENCE, SHARED = 0.3, 2
#: Distinct vectors of a window that the leader pass takes at once.
BATCH = 2000


def vector_kinds(vectors: DataFrame, within: list[str] = WITHIN, *, least_units: int = 2) -> tuple[DataFrame, DataFrame]:
    """(kinds: window, kind, n, first, vector, total; boards: window, board, kind), both staged.

    Boards of fewer than ``least_units`` units (never below 2: they would meet no group) take no part.
    """
    board = [*within, *[c for c in BOARD if c not in within]]
    lists = vectors.groupBy(*board).agg(F.array_sort(F.collect_list(F.struct("unit", "weight"))).alias("vector"), F.sum("weight").alias("total"))
    lists = staged(lists.where(F.size("vector") >= max(SHARED, least_units)))
    sets = lists.groupBy(*within, "vector", "total").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*BOARD)).alias("first"))
    kinds = staged(spread_row_number(sets, within, [-F.size("vector"), F.col("vector")], "kind"))
    boards = staged(lists.join(kinds.select(*within, "vector", "kind"), [*within, "vector"]).select(*board, "kind"))
    discard(lists)
    return kinds, boards


class _Leaders:
    """Groups of one window while one batch of kinds joins them, one after another."""

    def __init__(self, tau: float):
        self.tau = tau
        self.sums: dict[int, dict[str, float]] = {}
        self.held: dict[int, dict[str, int]] = {}
        self.size: dict[int, int] = {}
        self.strong: dict[str, set[int]] = defaultdict(set)

    def add(self, g: int, n: int, vector: dict[str, float], held: dict[str, int]) -> None:
        sums, counts = self.sums.setdefault(g, {}), self.held.setdefault(g, {})
        self.size[g] = self.size.get(g, 0) + n
        for unit, weight in vector.items():
            sums[unit] = sums.get(unit, 0.0) + weight
            counts[unit] = counts.get(unit, 0) + held[unit]
        for unit, count in counts.items():
            (self.strong[unit].add if count / self.size[g] >= PRESENCE else self.strong[unit].discard)(g)

    def similarity(self, vector: dict[str, float], g: int) -> float:
        size, sums = self.size[g], self.sums[g]
        low = sum(min(w, sums[u] / size) for u, w in vector.items() if u in sums)
        return round(low / (sum(vector.values()) + sum(sums.values()) / size - low), DIGITS)

    def join(self, kind: int, n: int, vector: dict[str, float]) -> int:
        """The group of ``n`` boards of one kind; a new group is numbered by the kind that starts it."""
        shared: dict[int, int] = defaultdict(int)
        for unit in vector:
            for g in self.strong[unit]:
                shared[g] += 1
        best = min(((-self.similarity(vector, g), g) for g, k in shared.items() if k >= SHARED), default=(0.0, kind))
        g = best[1] if -best[0] >= self.tau else kind
        self.add(g, n, {u: n * w for u, w in vector.items()}, dict.fromkeys(vector, n))
        return g


def leader_groups(vectors: DataFrame, *, within: list[str] = WITHIN, tau: float = TAU, least_units: int = 2, batch: int = BATCH) -> DataFrame:
    """(window, board, group): in structural order, a board joins its most similar group at or above ``tau`` or starts one; each profile is the mean of its boards so far.

    Windows run side by side. In each, a batch of kinds is joined with the groups that any of them could
    meet and takes its turns in one task, which holds the batch and these groups only: a group
    that no kind of the batch meets at the start changes only when one joins it, so none is missed. Copies of a kind
    join in one go: the first of them only draws its group's mean nearer to the rest.
    """
    kinds, boards = vector_kinds(vectors, within, least_units=least_units)
    long = staged(kinds.select(*within, "kind", "n", F.inline("vector")))
    last = kinds.agg(F.max("kind")).first()[0] or 0
    groups: DataFrame | None = None
    found: list[DataFrame] = []
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds.schema.fields if f.name in within)

    def turns(key: tuple, rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        state = _Leaders(tau)
        for r in known.itertuples(index=False):
            state.add(r.g, r.size, dict(zip(r.units, r.sums, strict=True)), dict(zip(r.units, r.held, strict=True)))
        out = [(*key, r.kind, state.join(r.kind, r.n, dict(zip(r.units, r.weights, strict=True)))) for r in rows.sort_values("kind").itertuples(index=False)]
        return pd.DataFrame(out, columns=[*within, "kind", "g"])

    for start in range(0, last, batch):
        own = (F.col("kind") > start) & (F.col("kind") <= start + batch)
        rows = kinds.where(own).select(*within, "kind", "n", F.col("vector.unit").alias("units"), F.col("vector.weight").alias("weights"))
        if groups is None:
            known = long.where("false").select(*within, F.col("kind").cast("long").alias("g"), F.col("n").alias("size"), F.array("unit").alias("units"), F.array("weight").alias("sums"), F.array("n").alias("held"))
        else:
            strong = groups.where(F.col("held") / F.col("size") >= PRESENCE).select(*within, "g", "unit")
            met = long.where(own).join(strong, [*within, "unit"]).groupBy(*within, "kind", "g").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= SHARED)
            near = groups.join(met.select(*within, "g").distinct(), [*within, "g"], "left_semi")
            parts = F.sort_array(F.collect_list(F.struct("unit", "s", "held")))
            known = near.groupBy(*within, "g").agg(F.first("size").alias("size"), parts.alias("p")).select(*within, "g", "size", F.col("p.unit").alias("units"), F.col("p.s").alias("sums"), F.col("p.held").alias("held"))
        known = known.select(*[F.col(c).alias(f"at_{c}") for c in within], "g", "size", "units", "sums", "held")
        taken = staged(rows.groupBy(*within).cogroup(known.groupBy(*[f"at_{c}" for c in within])).applyInPandas(turns, f"{fields}, kind long, g long"))
        found.append(taken)
        new = long.where(own).join(taken, [*within, "kind"]).groupBy(*within, "g", "unit").agg(F.sum(F.col("n") * F.col("weight")).alias("s"), F.sum("n").alias("held"))
        sizes = kinds.where(own).join(taken, [*within, "kind"]).groupBy(*within, "g").agg(F.sum("n").alias("size"))
        if groups is not None:
            new = new.unionByName(groups.select(*within, "g", "unit", "s", "held")).groupBy(*within, "g", "unit").agg(F.sum("s").alias("s"), F.sum("held").alias("held"))
            sizes = sizes.unionByName(groups.select(*within, "g", "size").distinct()).groupBy(*within, "g").agg(F.sum("size").alias("size"))
        now = staged(new.join(sizes, [*within, "g"]))
        if groups is not None:
            discard(groups)
        groups = now
    every = found[0] if found else long.where("false").select(*within, "kind", F.col("kind").cast("long").alias("g"))
    for more in found[1:]:
        every = every.unionByName(more)
    out = staged(boards.join(every, [*within, "kind"]).select(*[c for c in boards.columns if c != "kind"], F.col("g").alias("group")))
    discard(kinds, boards, long, *found, *([groups] if groups is not None else []))
    return out


def _numbered(found: DataFrame, kinds: DataFrame, within: list[str]) -> DataFrame:
    """(window, kind, group) with groups numbered by size, then by the units on half their boards, then by their first board."""
    rows = found.join(kinds.select(*within, "kind", "n", "first", "vector"), [*within, "kind"])
    sizes = rows.groupBy(*within, "group").agg(F.sum("n").alias("size"), F.min("first").alias("first"))
    held = rows.select(*within, "group", "n", F.inline("vector")).groupBy(*within, "group", "unit").agg(F.sum("n").alias("c")).join(sizes.select(*within, "group", "size"), [*within, "group"])
    common = held.where("2 * c >= size").groupBy(*within, "group").agg(F.array_sort(F.collect_list("unit")).alias("common"))
    order = [F.desc("size"), F.coalesce("common", F.array().cast("array<string>")), F.col("first")]
    placed = spread_row_number(sizes.join(common, [*within, "group"], "left"), within, order, "place")
    ids = placed.select(*within, "group", (F.col("place") - 1).cast("long").alias("id"))
    return found.join(ids, [*within, "group"]).select(*within, "kind", F.col("id").alias("group"))


def _pass(kinds: DataFrame, now: DataFrame, within: list[str], tau: float) -> tuple[DataFrame, DataFrame]:
    """(window, kind, group), and the staged profiles it reads: every kind at its most similar group of two boards or more, if that reaches ``tau``."""
    members = kinds.join(now, [*within, "kind"])
    sizes = members.groupBy(*within, "group").agg(F.sum("n").alias("size")).where("size >= 2")
    unit = members.select(*within, "group", "n", F.inline("vector")).groupBy(*within, "group", "unit").agg(F.sum(F.col("n") * F.col("weight")).alias("s"), F.sum("n").alias("held")).join(sizes, [*within, "group"])
    entry = F.struct("unit", (F.col("s") / F.col("size")).alias("w"))
    strong = F.array_compact(F.collect_list(F.when(F.col("held") / F.col("size") >= PRESENCE, F.col("unit"))))
    profiles = unit.groupBy(*within, "group").agg(F.map_from_entries(F.collect_list(entry)).alias("profile"), strong.alias("strong"))
    profiles = staged(profiles.withColumn("mass", _sum(F.map_values("profile"))))
    long = kinds.select(*within, "kind", F.explode("vector.unit").alias("unit"))
    met = long.join(profiles.select(*within, "group", F.explode("strong").alias("unit")), [*within, "unit"]).groupBy(*within, "kind", "group").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= SHARED)
    rows = met.join(kinds.select(*within, "kind", "vector", "total"), [*within, "kind"]).join(profiles.drop("strong"), [*within, "group"])
    low = F.aggregate("vector", F.lit(0.0), lambda so_far, x: so_far + F.least(x["weight"], F.coalesce(F.try_element_at("profile", x["unit"]), F.lit(0.0))))
    scored = rows.select(*within, "kind", "group", _ruzicka(low, F.col("total"), F.col("mass")).alias("similarity")).where(F.col("similarity") >= tau)
    best = scored.groupBy(*within, "kind").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "group")).alias("b"))
    return best.select(*within, "kind", F.col("b.group").alias("group")), profiles


def _moved(kinds: DataFrame, old: DataFrame, new: DataFrame, within: list[str]) -> DataFrame:
    """(window, moved): boards in just one partition, and those outside their new group's most common old one."""
    both = old.select(*within, "kind", F.col("group").alias("o")).join(new.select(*within, "kind", F.col("group").alias("g")), [*within, "kind"], "full_outer").join(kinds.select(*within, "kind", "n"), [*within, "kind"])
    lone = F.sum(F.when(F.col("o").isNull() | F.col("g").isNull(), F.col("n")).otherwise(0))
    cells = both.groupBy(*within, "g", "o").agg(F.sum("n").alias("n"), lone.alias("lone"))
    met = F.when(F.col("g").isNotNull() & F.col("o").isNotNull(), F.col("n"))
    out = cells.groupBy(*within, "g").agg((F.coalesce(F.sum(met), F.lit(0)) - F.coalesce(F.max(met), F.lit(0)) + F.sum("lone")).alias("m"))
    return out.groupBy(*within).agg(F.sum("m").alias("moved"))


def refine(vectors: DataFrame, start: DataFrame, *, within: list[str] = WITHIN, tau: float = TAU, cap: int = 10, share: float = 0.001, least_units: int = 2) -> tuple[DataFrame, DataFrame]:
    """(partition: window, board, group; log: window, pass, groups, boards, moved, limit, status).

    Each window goes on until at most ``max(1, share of its boards)`` move ("converged"), a partition comes
    back ("cycle") or ``cap`` passes are made ("stopped"), and then leaves the loop: what one window does depends
    on no other. ``start`` must give equal vectors one group; where it doesn't, their lowest counts. Groups of one board are left out at the end.
    """
    kinds, boards = vector_kinds(vectors, within, least_units=least_units)
    first = boards.join(start.select(*[c for c in boards.columns if c != "kind"], F.col("group").cast("long").alias("group")), [c for c in boards.columns if c != "kind"])
    now = staged(first.groupBy(*within, "kind").agg(F.min("group").alias("group")))
    limits = staged(kinds.groupBy(*within).agg(F.greatest(F.lit(1).cast("long"), F.floor(share * F.sum("n"))).alias("limit")))
    seen, logs, done, active = limits.select(*within, F.lit("").alias("digest")).where("false"), [], [], kinds
    used = []
    for number in range(1, cap + 1):
        chosen, profiles = _pass(active, now, within, tau)
        new = staged(_numbered(chosen, kinds, within))
        discard(profiles)
        sums = new.join(kinds.select(*within, "kind", "n"), [*within, "kind"]).groupBy(*within).agg(F.count_distinct("group").alias("groups"), F.sum("n").alias("boards"), F.sum(F.xxhash64("kind", "group").cast("decimal(38,0)")).cast("string").alias("digest"))
        live = active.select(*within).distinct().join(limits, within).join(_moved(kinds, now, new, within), within, "left").join(sums, within, "left")
        live = live.join(seen.withColumn("again", F.lit(True)).distinct(), [*within, "digest"], "left").fillna(0, ["moved", "groups", "boards"])
        status = F.when(F.col("moved") <= F.col("limit"), "converged").when(F.col("again"), "cycle").when(F.lit(number == cap), "stopped")
        log = staged(live.select(*within, F.lit(number).alias("pass"), "groups", "boards", "moved", "limit", status.alias("status"), "digest"))
        logs.append(log)
        seen = seen.unionByName(log.select(*within, "digest").where("digest is not null"))
        left, going = log.where("status is not null").select(*within), log.where("status is null").select(*within)
        # staged: a union of joins whose partitions are coalesced apart can't be read as one
        done.append(staged(new.join(left, within, "left_semi")))
        used += [now, new]
        if going.isEmpty():
            break
        now = staged(new.join(going, within, "left_semi"))
        active = kinds.join(going, within, "left_semi")
    every, log = done[0], logs[0]
    for x, y in zip(done[1:], logs[1:], strict=True):
        every, log = every.unionByName(x), log.unionByName(y)
    sizes = every.join(kinds.select(*within, "kind", "n"), [*within, "kind"]).groupBy(*within, "group").agg(F.sum("n").alias("size")).where("size >= 2")
    final = _numbered(every.join(sizes, [*within, "group"], "left_semi"), kinds, within)
    out = staged(boards.join(final, [*within, "kind"]).select(*[c for c in boards.columns if c != "kind"], "group"))
    told = staged(log.drop("digest"))
    discard(kinds, boards, limits, *logs, *used, *done)
    return out, told


def family_candidate(vectors: DataFrame, start: DataFrame, *, within: list[str] = WITHIN, rules: MergeRules | None = None, cap: int = 20, least_units: int = 2, tie_rule: str = "") -> tuple[DataFrame, DataFrame]:
    """(families: window, board, variant, group; status: window, status, passes, variants, boards, groups, merges).

    Variants are refined up to ``cap`` passes and merged only in windows that converge; others are "not
    constructed", with how their refinement ended.
    """
    rules = rules or MergeRules(tails="s2")
    variants, log = refine(vectors, start, within=within, tau=rules.tau, cap=cap, least_units=least_units)
    ended = log.where("status is not null").select(*within, "status", F.col("pass").alias("passes"))
    good = variants.join(ended.where("status = 'converged'").select(*within), within, "left_semi")
    run = merge_in_order(vectors, good, within=within, rules=rules, tie_rule=tie_rule)
    counts = run.families.groupBy(*within).agg(F.count_distinct("variant").alias("variants"), F.count(F.lit(1)).alias("boards"), F.count_distinct("group").alias("groups"))
    merges = run.attempts.where("verdict = 'accepted'").groupBy(*within).agg(F.count(F.lit(1)).alias("merges"))
    rows = ended.join(counts, within, "left").join(merges, within, "left").fillna(0, ["variants", "boards", "groups", "merges"])
    return run.families, rows.withColumn("outcome", F.when(F.col("status") == "converged", "constructed").otherwise("not constructed"))
