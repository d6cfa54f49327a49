"""One row a pair or a board of small partitions: audits, anchors and what a merge run says of itself."""

import random
from collections import Counter

import pytest
from plain_families import Merging, mean, ruzicka
from pyspark.sql import functions as F
from test_merging import frames

from boardloom.operators import families as fa
from boardloom.operators import merge_reports as mr
from boardloom.operators import merging as me
from boardloom.sources.shared import staged

RULES = me.MergeRules(tails="s2")


def tailed_families():
    """Large variants around one core, each with a board that merges may take in below the threshold."""
    rng = random.Random(12)
    vectors, variant = {}, {}
    core = "abcdef"
    for g in range(9):
        own = [*core, *("xyzuvwpqr"[g] if g % 3 else "")]
        large = g in (0, 4, 7)
        for i in range(rng.randint(130, 170) if large else rng.randint(14, 40)):
            vectors["w", f"{g}-{i:03d}", 0] = {u: 1.0 for u in own}
        for j in range(0 if large else rng.choice([1, 1, 2])):
            vectors["w", f"{g}-far{j}", 0] = {u: 1.0 for u in own[:4]} | {rng.choice("ABCDEFG"): 1.0}
        for b in list(vectors):
            variant.setdefault(b, g)
    return vectors, variant


def nearest(values, p):
    xs = sorted(values)
    return xs[min(len(xs) - 1, int(round(p * (len(xs) - 1))))]


def failures(larger, smaller, sizes, post, side, tau=0.6):
    below = {s: sum(post[b] < tau for b in post if side[b] == s) for s in "ab"}
    tests = {"larger_side_whole": below[larger] == 0, "smaller_side_tenth": 10 * below[smaller] <= sizes[smaller], "merged_hundredth": 100 * sum(below.values()) <= len(post), "floor": min(post.values()) >= tau - 0.1}
    return [name for name, ok in tests.items() if not ok]


def lock_in_by_hand(loop, vectors):
    """Entries of the plain loop's attempts, with provenance kept board by board."""
    since, out, admitted_events = {}, [], 0
    for at, (verdict, side, _, post) in enumerate(p for p in loop.posts if p[0] != "core"):
        sizes = Counter(side.values())
        larger = "a" if sizes["a"] >= sizes["b"] else "b"
        smaller = "a" if larger == "b" else "b"
        low = [b for b in post if side[b] == larger and post[b] < 0.6]
        old = {b for b in post if b in since}
        n_old = sum(b in old for b in low)
        why = mr.ATTRIBUTION[3] if not low else mr.ATTRIBUTION[0] if n_old == len(low) else mr.ATTRIBUTION[1] if n_old else mr.ATTRIBUTION[2]
        entry = {"verdict": verdict, "larger": larger, "historical_a": sum(side[b] == "a" for b in old), "historical_b": sum(side[b] == "b" for b in old), "attribution": why, "failed": failures(larger, smaller, sizes, post, side), "admitted": 0, "newly_admitted": 0, "passes": None}
        if verdict == "accepted":
            taken = [b for b in post if post[b] < 0.6]
            entry["admitted"], entry["newly_admitted"] = len(taken), sum(b not in since for b in taken)
            admitted_events += len(taken)
            for b in taken:
                since.setdefault(b, at)
        elif any(side[b] == larger for b in old):
            kept = [b for b in post if not (b in old and side[b] == larger)]
            if not any(side[b] == larger for b in kept):
                entry["passes"] = False
            else:
                profile = mean([vectors[b] for b in kept])
                left = Counter(side[b] for b in kept)
                now_larger = "a" if left["a"] >= left["b"] else "b"
                again = {b: ruzicka(vectors[b], profile) for b in kept}
                entry["passes"] = not failures(now_larger, "a" if now_larger == "b" else "b", left, again, side)
        out.append(entry)
    return out, admitted_events


@pytest.fixture(scope="module")
def tails(spark):
    vectors, variant = tailed_families()
    rows, parts = frames(spark, vectors, variant)
    rows = staged(rows)
    return rows, me.merge_in_order(rows, parts, rules=RULES), Merging(vectors, variant, RULES), vectors, variant


def test_lock_in(tails):
    rows, run, loop, vectors, _ = tails
    want, events = lock_in_by_hand(loop, vectors)
    admissions, entries = (staged(x) for x in mr.tail_lock_in(run, rules=RULES))
    found = entries.orderBy("attempt").collect()
    got = [{"verdict": r.verdict, "larger": r.larger, "historical_a": r.historical_a, "historical_b": r.historical_b, "attribution": r.attribution, "failed": r.failed, "admitted": r.admitted, "newly_admitted": r.newly_admitted, "passes": r.passes_without} for r in found]
    assert got == want
    assert admissions.agg(F.sum("boards")).first()[0] == events > 0
    assert any(e["historical_a"] + e["historical_b"] for e in want) and any(e["passes"] is not None for e in want)
    counts = mr.lock_in_counts(admissions, entries).first()
    assert counts.boards_admitted == sum(e["newly_admitted"] for e in want)
    assert counts.recovered == sum(bool(e["passes"]) for e in want)
    assert counts.refused == sum(e["verdict"] == "similarity" for e in want)


def test_attempts_in_full(tails):
    _, run, loop, _, _ = tails
    details = staged(mr.attempt_details(run, rules=RULES))
    posts = [p for p in loop.posts if p[0] != "core"]
    found = details.orderBy("attempt").collect()
    assert len(found) == len(posts)
    for r, (verdict, side, pre, post) in zip(found, posts, strict=True):
        low = [0.6 - x for x in post.values() if x < 0.6]
        assert r.verdict == verdict
        for prefix, values in (("post", list(post.values())), ("pre", list(pre.values())), ("pre_a", [pre[b] for b in pre if side[b] == "a"]), ("pre_b", [pre[b] for b in pre if side[b] == "b"])):
            assert [r[f"{prefix}_{k}"] for k in ("min", "p05", "p10", "median")] == [min(values), *[nearest(values, p) for p in (0.05, 0.1, 0.5)]]
        weakest = min(post, key=lambda b: (post[b], b))
        assert (r.weakest_match_id, r.weakest_after, r.weakest_before) == (weakest[1], post[weakest], pre[weakest])
        assert r.merged_below == len(low)
        assert (r.shortfall_max is None) == (not low)
        if low:
            assert r.shortfall_mean == pytest.approx(sum(low) / len(low))
    shadows = mr.shadow_rules(details, rules=RULES)
    said = {r.rule: r for r in mr.shadow_evaluation(shadows).collect()}
    accepted = sum(p[0] == "accepted" for p in posts)
    assert said["s2"].accepted == accepted and said["s2"].recovered == said["s2"].lost == 0
    assert said["s0"].accepted == sum(min(p[3].values()) >= 0.6 for p in posts)
    assert said["s0"].lost == sum(p[0] == "accepted" and min(p[3].values()) < 0.6 for p in posts)
    assert said["s1"].recovered == said["s1"].shared_s1 >= said["s2"].shared_s1
    bands = mr.merge_histograms(details).groupBy("measure").agg(F.sum("attempts").alias("n")).collect()
    assert {b.n for b in bands} == {len(posts)}
    steps = mr.merge_trajectory(details).where("measure = 'min_post'").collect()
    assert sum(s.merges for s in steps) == accepted and sum(s.n for s in steps) == accepted


def test_lineage(tails):
    rows, run, loop, vectors, variant = tails
    found = {r.group: r for r in mr.family_lineage(rows, run.families, rules=RULES).collect()}
    groups = {}
    for b, g in loop.family.items():
        groups.setdefault(g, []).append(b)
    assert found.keys() == groups.keys()
    for g, boards in groups.items():
        post = [ruzicka(vectors[b], mean([vectors[x] for x in boards])) for b in boards]
        n = Counter(variant[b] for b in boards)
        base = loop.core([b for b in boards if variant[b] == min(n, key=lambda v: (-n[v], v))])
        final = loop.core(boards)
        r = found[g]
        assert (r.boards, r.variants, r.below) == (len(boards), len(n), sum(x < 0.6 for x in post))
        assert (r.weakest, r["median"]) == (min(post), sorted(post)[(len(post) - 1) // 2])
        assert sorted(r.core) == sorted(final)
        assert r.drift == pytest.approx(1 - len(final & base) / len(final | base))


def test_anchors_and_audit(spark, tails):
    rows, run, _, _, _ = tails
    summaries = spark.createDataFrame([("w", "0", ["a", "b", "c"]), ("w", "1", ["a"]), ("v", "0", ["b"])], "balance_window string, `group` string, core array<string>")
    anchors = spark.createDataFrame([("ab", ["a", "b"]), ("aa", ["a", "a"]), ("none", []), ("q", ["q"])], "name string, units array<string>")
    found = fa.anchored_groups(summaries, anchors)
    assert {tuple(r) for r in found.collect()} == {("w", "ab", "0"), ("w", "aa", "0"), ("w", "aa", "1")}
    other = spark.createDataFrame([("w", "aa", "0"), ("w", "ab", "0"), ("w", "ab", "5"), ("w", "new", "1")], "balance_window string, anchor string, `group` string")
    changes = {r.anchor: r.change for r in fa.anchor_changes(found, other).collect()}
    assert changes == {"aa": "joined", "ab": "split", "new": "gained"}
    audit = fa.prune_audit(rows, run.families.drop("variant")).first()
    assert (audit.audited, audit.disagreements) == (300, 0)


def test_nearest_ranks(spark):
    rng = random.Random(2)
    rows = [(g, float(rng.randint(0, 9)), rng.randint(1, 5)) for g in "ab" for _ in range(40)]
    frame = spark.createDataFrame(rows, "g string, v double, n int")
    for r in mr.nearest_ranks(frame, ["g"], "v", weight=F.col("n")).collect():
        values = [v for g, v, n in rows if g == r.g for _ in range(n)]
        assert r.n == len(values)
        assert [r[k] for k in ("min", *mr.RANKS, "max")] == [min(values), *[nearest(values, p) for p in mr.RANKS.values()], max(values)]
