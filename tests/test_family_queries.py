"""The family queries that loop, on the driver's smallest tables, against plain loops over the same boards."""

from collections import Counter, defaultdict

import pytest
from plain_families import Merging, leaders, numbered, refined
from pyspark.sql import functions as F
from test_merging import by_window
from test_oracles import SMALL

from boardloom.plans import all_queries
from boardloom.plans import families as pf
from boardloom.sources.binding import Boards

QUERIES = all_queries()


@pytest.fixture(scope="module")
def bound(spark):
    """board -> vector, for boards of three shapes or more."""
    out = defaultdict(dict)
    for r in pf._vectors(Boards(spark, SMALL)).collect():
        out[r.balance_window, r.match_id, r.participant_index][r.unit] = r.weight
    return {b: v for b, v in out.items() if len(v) >= 3}


def sizes(rows):
    return Counter((r.balance_window, r.boards) for r in rows)


def test_leaders(spark, bound):
    want = Counter()
    for w, own in by_window(bound).items():
        want.update((w, n) for n in Counter(leaders(own, 0.6).values()).values())
    assert sizes(QUERIES["c06_leader_seeding"](spark, SMALL).collect()) == want


def test_refinement(spark, bound):
    log, want = defaultdict(list), Counter()
    for r in QUERIES["c07_refine"](spark, SMALL).orderBy("pass").collect():
        log[r.balance_window].append((r.moved, r.status))
    for w, own in by_window(bound).items():
        start = numbered({b: "+".join(sorted(v)) for b, v in own.items()}, own)
        found, moves, status = refined(own, start, 0.6, 10)
        assert log[w] == [(m, None) for m in moves[:-1]] + [(moves[-1], status)]
        want.update((w, n) for n in Counter(found.values()).values())
    assert sizes(QUERIES["c07_refined_groups"](spark, SMALL).collect()) == want


@pytest.fixture(scope="module")
def loops(bound):
    out = {}
    for w, own in by_window(bound).items():
        variants = numbered({b: (tuple(sorted(v)), sum(x >= 2 for x in v.values())) for b, v in own.items()}, own)
        out[w] = {"s2": Merging(own, variants, pf.RULES), "all": Merging(own, variants, pf.CONTROL)}
    return out


def test_merges(spark, loops):
    for query, tails in (("c12_merge_variants", "s2"), ("c12_merge_control", "all")):
        want = Counter((w, n) for w, loop in loops.items() for n in Counter(loop[tails].family.values()).values())
        assert sizes(QUERIES[query](spark, SMALL).collect()) == want


def test_attempts_and_what_follows(spark, loops):
    found = defaultdict(list)
    for r in QUERIES["c14_merge_attempts"](spark, SMALL).orderBy("attempt").collect():
        found[r.balance_window].append((r.a, r.b, r.overlap, r.a_boards, r.b_boards, r.a_variants + r.b_variants, r.verdict, r.min_post))
    judged = {w: [(*a[:7], round(a[7], 6)) for a in loop["s2"].attempts if a[6] != "core"] for w, loop in loops.items()}
    assert found == {w: a for w, a in judged.items() if a}
    accepted = Counter({w: sum(a[6] == "accepted" for a in rows) for w, rows in judged.items()})
    shadow = QUERIES["c15_shadow_rules"](spark, SMALL).where("rule = 's2'").collect()
    assert {r.balance_window: (r.accepted, r.recovered, r.lost) for r in shadow} == {w: (n, 0, 0) for w, n in accepted.items() if found[w]}
    assert {r.balance_window: r.merges for r in QUERIES["c18_lock_in_counts"](spark, SMALL).collect()} == {w: n for w, n in accepted.items() if found[w]}
    entries = QUERIES["c18_tail_lock_in"](spark, SMALL).groupBy("balance_window").agg(F.sum("admitted").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    tails = {w: sum(x < pf.RULES.tau for verdict, _, _, post in loop["s2"].posts if verdict == "accepted" for x in post.values()) for w, loop in loops.items()}
    assert {r.balance_window: (r.n, r.rows) for r in entries} == {w: (tails[w], len(rows)) for w, rows in judged.items() if rows}
    merges = QUERIES["c17_merge_trajectory"](spark, SMALL).where("measure = 'min_post'").groupBy("balance_window").agg(F.sum("n").alias("n")).collect()
    assert {r.balance_window: r.n for r in merges} == {w: n for w, n in accepted.items() if n}
    buckets = QUERIES["c16_merge_histograms"](spark, SMALL).groupBy("balance_window", "measure").agg(F.sum("attempts").alias("n")).collect()
    assert all(r.n == len(judged[r.balance_window]) for r in buckets)
    lineage = QUERIES["c22_family_lineage"](spark, SMALL).collect()
    assert sizes(lineage) == Counter((w, n) for w, loop in loops.items() for n in Counter(loop["s2"].family.values()).values())


def test_orders(spark, loops):
    base = QUERIES["c13_tie_rules"](spark, SMALL).where("rule = '' and mode = 'baseline'").collect()
    for r in base:
        loop = loops[r.balance_window]["s2"]
        assert (r.groups, r.accepted) == (len(loop.members), sum(a[6] == "accepted" for a in loop.attempts))
    study = QUERIES["c26_stability_study"](spark, SMALL).collect()
    assert len(study) == len(base) * 16 and all(r.disagree == r.pairs_x + r.pairs_y - 2 * r.pairs_both for r in study)


def test_candidate(spark, bound):
    for r in QUERIES["c27_family_candidate"](spark, SMALL).collect():
        own = by_window(bound)[r.balance_window]
        variants, moves, status = refined(own, leaders(own, 0.6), 0.6, 20)
        assert (r.status, r.passes) == (status, len(moves))
        if status == "converged":
            loop = Merging(own, variants, pf.me.MergeRules(tails="s2"))
            assert (r.groups, r.boards, r.merges) == (len(loop.members), len(variants), sum(a[6] == "accepted" for a in loop.attempts))
