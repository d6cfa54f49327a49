"""The leader pass and refinement against plain loops, each window as on its own."""

import random
from collections import defaultdict

import pytest
from plain_families import Merging, leaders, refined
from test_merging import by_window, frames

from boardloom.operators import refinement as rf
from boardloom.operators.merging import MergeRules


def noisy_boards(seed, sizes):
    """Boards around a few shells, with swaps; many share a vector."""
    rng = random.Random(seed)
    vectors = {}
    for w, size in enumerate(sizes):
        shells = [rng.sample("abcdefghijkl", 6) for _ in range(6 + w)]
        for i in range(size):
            own = list(rng.choice(shells))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                own[rng.randrange(6)] = rng.choice("abcdefghijklmnop")
            vectors[(f"w{w}", f"{i:03d}", i % 3)] = {u: rng.choice([1.0, 1.0, 1.0, 2.0, 0.5]) for u in own}
            if i % 5 == 0:
                vectors[(f"w{w}", f"{i:03d}", 7)] = dict(vectors[(f"w{w}", f"{i:03d}", i % 3)])
    vectors["w0", "lone", 0] = {"a": 1.0}
    return vectors


def grouped(rows):
    return {(r.balance_window, r.match_id, r.participant_index): r.group for r in rows.collect()}


def same_partition(got, want):
    assert got.keys() == want.keys()
    one, two = defaultdict(set), defaultdict(set)
    for x in got:
        one[x[0], got[x]].add(x)
        two[x[0], want[x]].add(x)
    assert {frozenset(v) for v in one.values()} == {frozenset(v) for v in two.values()}


@pytest.mark.parametrize("batch", [60, 1000])
def test_leaders_with_moving_means(spark, batch):
    vectors = noisy_boards(3, [380, 120])
    rows, _ = frames(spark, vectors, {})
    got = grouped(rf.leader_groups(rows, batch=batch))
    want = {}
    for own in by_window(vectors).values():
        want |= leaders({b: v for b, v in own.items() if len(v) >= 2}, rf.TAU)
    same_partition(got, want)
    # groups are numbered in the order in which they start
    for w, own in by_window(want).items():
        order = sorted({got[b] for b in own})
        assert all(order.index(got[b]) == g for b, g in own.items()), w


@pytest.mark.parametrize("cap", [2, 10])
def test_each_window_is_refined_on_its_own(spark, cap):
    vectors = {b: v for b, v in noisy_boards(8, [300, 90, 40]).items() if len(v) >= 2}
    start = {}
    for own in by_window(vectors).values():
        start |= leaders(own, rf.TAU)
    rows, parts = frames(spark, vectors, start)
    found, log = rf.refine(rows, parts, cap=cap)
    got, told = grouped(found), defaultdict(list)
    for r in log.orderBy("pass").collect():
        told[r.balance_window].append((r.moved, r.status))
    ends = set()
    for w, own in by_window(vectors).items():
        want, moves, status = refined(own, by_window(start)[w], rf.TAU, cap)
        assert [m for m, _ in told[w]] == moves
        assert [s for _, s in told[w]] == [None] * (len(moves) - 1) + [status]
        assert {b: g for b, g in got.items() if b[0] == w} == want
        ends.add((len(moves), status))
    assert len(ends) > 1 or cap == 2


def test_candidate(spark):
    """Windows that do not converge are not constructed, and the others are merged as alone."""
    vectors = {b: v for b, v in noisy_boards(8, [200, 60]).items() if len(v) >= 2}
    start = {}
    for own in by_window(vectors).values():
        start |= leaders(own, rf.TAU)
    rows, parts = frames(spark, vectors, start)
    ends = {w: refined(own, by_window(start)[w], rf.TAU, 20) for w, own in by_window(vectors).items()}
    cap = min(len(moves) for _, moves, _ in ends.values())
    families, status = rf.family_candidate(rows, parts, cap=cap)
    got = {(r.balance_window, r.match_id, r.participant_index): r.group for r in families.collect()}
    for r in status.collect():
        variants, moves, how = refined(by_window(vectors)[r.balance_window], by_window(start)[r.balance_window], rf.TAU, cap)
        assert (r.status, r.passes, r.outcome) == (how, len(moves), "constructed" if how == "converged" else "not constructed")
        want = Merging(by_window(vectors)[r.balance_window], variants, MergeRules(tails="s2")).family if how == "converged" else {}
        assert {b: g for b, g in got.items() if b[0] == r.balance_window} == want
        assert r.groups == len(set(want.values()))


def test_no_boards(spark):
    rows, parts = frames(spark, {}, {})
    assert rf.leader_groups(rows).count() == 0
    found, log = rf.refine(rows, parts)
    assert found.count() == log.count() == 0
