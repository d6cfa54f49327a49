"""Merges against the plain greedy loop, pair by pair and in its order."""

import itertools
import random
from collections import defaultdict

import pytest
from plain_families import Merging, order_of, splitmix64, tie_hash
from pyspark.sql import functions as F

from boardloom.functions import rules as columns
from boardloom.operators import merging as me

VECTORS = "balance_window string, match_id string, participant_index int, unit string, weight double"
PARTS = "balance_window string, match_id string, participant_index int, `group` string"


def random_families(seed, groups=40, windows=2):
    """Variants that share cores of six units with swaps, rare items, and a few boards far from their variant."""
    rng = random.Random(seed)
    vectors, variant = {}, {}
    for w in range(windows):
        shells = [rng.sample("abcdefghijklmnopqr", 6) for _ in range(7)]
        for g in range(groups):
            own = list(rng.choice(shells))
            if rng.random() < 0.5:
                own[rng.randrange(6)] = rng.choice("stuvwxyz")
            if rng.random() < 0.4:
                own.append(rng.choice("stuvwxyz"))
            for i in range(rng.randint(2, 14)):
                held = {u: rng.choice([1.0, 1.0, 1.0, 1.0, 2.0, 0.5]) for u in own if rng.random() < 0.97}
                if rng.random() < 0.01:
                    held |= {u: 2.0 for u in rng.sample("ABCDEF", 3)}
                board = (f"w{w}", f"{g:02d}-{i:02d}", 0)
                vectors[board], variant[board] = held or {own[0]: 1.0}, g
                if rng.random() < 0.3:
                    twin = (f"w{w}", f"{g:02d}-{i:02d}", 1)
                    vectors[twin], variant[twin] = vectors[board], g
    return vectors, variant


def frames(spark, vectors, variant):
    rows = [(*board, u, w) for board, v in vectors.items() for u, w in v.items()]
    return spark.createDataFrame(rows, VECTORS), spark.createDataFrame([(*board, str(g)) for board, g in variant.items()], PARTS)


def by_window(table):
    out = defaultdict(dict)
    for board, x in table.items():
        out[board[0]][board] = x
    return out


def held_to(run, vectors, variant, rules, **how):
    """Families and attempts of ``run`` are those of the plain loop, window by window; returns the loops."""
    families = {tuple(r[:3]): r["group"] for r in run.families.select("balance_window", "match_id", "participant_index", "group").collect()}
    found = defaultdict(list)
    for r in run.attempts.orderBy("attempt").collect():
        found[r.balance_window].append((r.a, r.b, round(r.overlap, 6), r.a_boards, r.b_boards, r.a_variants + r.b_variants, r.verdict, r.min_post))
    loops = {}
    for w, own in by_window(variant).items():
        loops[w] = Merging(by_window(vectors)[w], own, rules, **how)
        assert found[w] == loops[w].attempts
        assert {b: g for b, g in families.items() if b[0] == w} == loops[w].family
    return loops


@pytest.mark.parametrize(("seed", "tails"), [(1, "all"), (2, "s2")])
def test_greedy_merges(spark, seed, tails):
    vectors, variant = random_families(seed)
    rules = me.MergeRules(tails=tails)
    run = me.merge_in_order(*frames(spark, vectors, variant), rules=rules)
    loops = held_to(run, vectors, variant, rules)
    verdicts = {a[6] for loop in loops.values() for a in loop.attempts}
    assert {"accepted", "similarity"} <= verdicts
    assert run.rounds < max(len(loop.attempts) for loop in loops.values())


def test_orders_side_by_side(spark):
    """Five orders and three rules in one run, each as on its own."""
    vectors, variant = random_families(5, groups=16, windows=1)
    rules = me.MergeRules(tails="s2")
    how = [("", *o) for o in (("baseline", 0), ("reversed", 0), ("seeded", 1), ("seeded", 2), ("seeded", 3))] + [(r, "baseline", 0) for r in me.TIE_RULES]
    rows, parts = frames(spark, vectors, variant)
    runs = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(m).alias("mode"), F.lit(s).alias("seed")) for r, m, s in how])
    many = parts.select("*", F.inline(runs))
    within = ["balance_window", "rule", "mode", "seed"]
    run = me.merge_in_order(rows, many, within=within, rules=rules, tie_rule=F.col("rule"), mode=F.col("mode"), seed=F.col("seed"))
    for r, m, s in how:
        own = (F.col("rule") == r) & (F.col("mode") == m) & (F.col("seed") == s)
        held_to(me.MergeRun(run.families.where(own), run.attempts.where(own), run.posts), vectors, variant, rules, tie_rule=r, mode=m, seed=s)


def test_nothing_to_merge(spark):
    vectors = {("w", "1", 0): {"a": 1.0, "b": 1.0}, ("w", "2", 0): {"x": 1.0}}
    run = me.merge_in_order(*frames(spark, vectors, {("w", "1", 0): 4, ("w", "2", 0): 2}))
    assert run.attempts.count() == 0
    assert {(r.match_id, r.group) for r in run.families.collect()} == {("1", "1"), ("2", "0")}


def test_splitmix_columns(spark):
    numbers = [0, 1, 2, -1, -(1 << 63), (1 << 63) - 1, 123456789012345, *[random.Random(7).getrandbits(63) for _ in range(20)]]
    rows = spark.createDataFrame([(x,) for x in numbers], "x long")
    got = rows.select("x", columns.splitmix64(F.col("x")).alias("m"), columns.tie_hash(3, F.col("x"), F.lit(5)).alias("t")).collect()
    for r in got:
        assert r.m % (1 << 64) == splitmix64(r.x % (1 << 64))
        assert r.t % (1 << 64) == tie_hash(3, r.x, 5)
    drawn = [r.x for r in rows.orderBy(columns.unsigned_order(columns.tie_hash(9, F.col("x"))), "x").collect()]
    assert drawn == sorted(numbers, key=lambda x: tie_hash(9, x))
    assert list(itertools.islice((order_of("reversed", 0, a, b, 0, 0) for a, b in [(1, 2)]), 1)) == [(-1, -2)]


def test_orders_are_brought_to_equal_boards(spark):
    """Both rules for tails in one run from vectors at hand: no row a board and order is written, and groups say what families say."""
    vectors, variant = random_families(3, groups=14, windows=1)
    rows = [(*board, str(variant[board]), sorted(v.items()), sum(v.values())) for board, v in vectors.items()]
    parts = spark.createDataFrame(rows, PARTS + ", vector array<struct<unit: string, weight: double>>, total double")
    both = F.array(*[F.struct(F.lit(t).alias("tails")) for t in ("all", "s2")])
    run = me.merge_in_order(None, parts, within=["balance_window", "tails"], tails=F.col("tails"), orders=both, keep_posts=False)
    assert run.posts is None
    for tails in ("all", "s2"):
        own = F.col("tails") == tails
        loop = held_to(me.MergeRun(run.families.where(own), run.attempts.where(own), None), vectors, variant, me.MergeRules(tails=tails))["w0"]
        sizes = {}
        for board, g in loop.family.items():
            sizes[variant[board], g] = sizes.get((variant[board], g), 0) + 1
        assert {(r.variant, r.group): r.boards for r in run.groups.where(own).collect()} == sizes


def test_refused_pairs_end_no_round(spark, monkeypatch):
    """What a merge brings about ends a round only if it is accepted, and orders that meet the same groups measure them once."""
    vectors, variant = {}, {}
    for family in range(5):
        for k, first in enumerate((1.0, 2.0, 20.0)):  # the third is too far from the other two
            for i in range(2):
                board = ("w0", f"{family}-{k}-{i}", 0)
                vectors[board] = {f"{family}{u}": first if u == "a" else 1.0 for u in "abcde"}
                variant[board] = 3 * family + k
    rows, parts = frames(spark, vectors, variant)
    measured, measure = [], me._measured

    def counted(pairs, *how):
        measured.append(pairs.count())
        return measure(pairs, *how)

    monkeypatch.setattr(me, "_measured", counted)
    alone = me.merge_in_order(rows, parts, keep_posts=False)
    loop = held_to(alone, vectors, variant, me.MergeRules())["w0"]
    assert [a[6] for a in loop.attempts] == ["accepted", "similarity"] * 5
    assert alone.rounds == 2
    pairs, measured[:] = sum(measured), []
    same = F.array(*[F.struct(F.lit(i).alias("copy")) for i in range(3)])
    many = me.merge_in_order(rows, parts, within=["balance_window", "copy"], orders=same, keep_posts=False)
    assert sum(measured) == pairs == 20
    assert many.attempts.count() == 3 * len(loop.attempts)
