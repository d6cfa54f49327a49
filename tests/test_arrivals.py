"""Batches that repeat or break off, documents with gaps, and small ladders."""

import json

import pytest
from pyspark.sql import functions as F

from boardloom.operators import groups as gr
from boardloom.operators import sampling as sm
from boardloom.sources import documents as dc
from boardloom.sources.binding import ITEM_SETS
from boardloom.sources.shared import shared_folder
from boardloom.streaming import store as st


AT = "id long, at timestamp, v string"


def arrived(spark, folder, rows):
    """Rows of (id, day, v) as one file of a stream's source."""
    values = ", ".join(f"({i}, timestamp'2026-01-{day:02d} 12:00:00', '{v}')" for i, day, v in rows)
    spark.sql(f"SELECT * FROM VALUES {values} AS t(id, at, v)").select("id", "at", "v").selectExpr("CAST(id AS BIGINT) AS id", "at", "v").coalesce(1).write.mode("append").parquet(folder)


def test_streams_count_once(spark):
    source, path, checkpoint = (shared_folder(spark, x) for x in ("in", "out", "mark"))
    batches = [[(1, 1, "a"), (2, 2, "b"), (2, 2, "b")], [(2, 3, "x"), (3, 20, "c")], [(9, 1, "late"), (4, 21, "d")], [(5, 22, "e"), (4, 22, "again")]]
    for rows in batches:
        arrived(spark, source, rows)
        stream = spark.readStream.schema(AT).parquet(source)
        st.append_once(stream, path, checkpoint, key=["id"], at="at", delay="7 days")
    got = st.stored(spark, path, stream.schema).collect()
    assert sorted((r.id, r.v) for r in got) == [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")]
    st.append_once(spark.readStream.schema(AT).parquet(source), path, checkpoint, key=["id"], at="at")
    assert st.stored(spark, path, stream.schema).count() == 5


def test_late_rows_do_not_count(spark):
    source, path, checkpoint = (shared_folder(spark, x) for x in ("in", "out", "mark"))
    for rows in ([(1, 1, "a"), (2, 1, "a")], [(3, 1, "a"), (4, 20, "b")], [(5, 1, "a"), (6, 19, "b")], [(7, 20, "b")]):
        arrived(spark, source, rows)
        st.live_counts(spark.readStream.schema(AT).parquet(source), ["v"], path, checkpoint, at="at", delay="7 days")
    got = {(r.starts.day, r.v): r.n for r in st.newest_counts(spark, path, ["v"]).collect()}
    assert got == {(1, "a"): 3, (20, "b"): 2, (19, "b"): 1}


def test_state_stays_as_large_as_the_delay(spark):
    """A day at a time: the state holds the days of the delay, and rows behind it are counted apart."""
    source, path, checkpoint = (shared_folder(spark, x) for x in ("in", "out", "mark"))
    told = []
    for day in range(1, 13):
        rows = [(10 * day + i, day, v) for i, v in enumerate("abc")] + ([(999, 1, "a")] if day == 9 else [])
        arrived(spark, source, rows)
        told.append(st.live_counts(spark.readStream.schema(AT).parquet(source), ["v"], path, checkpoint, at="at", delay="2 days"))
    assert [t["late"] for t in told] == [0] * 8 + [1] + [0] * 3
    assert len({t["open"] for t in told[4:]}) == 1 and told[-1]["open"] <= 3 * 4
    assert {r.n for r in st.newest_counts(spark, path, ["v"]).collect()} == {1}


def test_links_and_matches_in_either_order(spark):
    folders = {x: shared_folder(spark, x) for x in ("links", "found", "out", "mark")}
    steps = [
        ([(1, 1, "p"), (1, 1, "q"), (2, 1, "p")], [(2, 1, "m")]),  # link 1 waits for its match, link 2 finds it
        ([(3, 3, "p"), (3, 3, "p")], [(1, 2, "m"), (1, 2, "m")]),  # the match of link 1; link 3 waits, twice the same
        ([(4, 4, "r")], [(3, 4, "m"), (5, 4, "m")]),  # match 5 waits for its link
        ([(5, 5, "s"), (6, 20, "t")], [(9, 20, "m")]),
        ([(7, 21, "u")], [(4, 4, "m"), (8, 21, "m")]),  # match 4 is far too late
        ([(8, 22, "v")], [(7, 22, "m")]),
    ]
    for links, matches in steps:
        arrived(spark, folders["links"], links)
        arrived(spark, folders["found"], matches)
        left, right = (spark.readStream.schema(AT).parquet(folders[x]) for x in ("links", "found"))
        st.append_matched(left, right.select("id", "at"), folders["out"], folders["mark"], key=["id"], at="at", columns=["id", "v"], delay="3 days")
    got = sorted((r.id, r.v) for r in spark.read.parquet(folders["out"]).collect())
    assert got == [(1, "p"), (1, "q"), (2, "p"), (3, "p"), (5, "s"), (7, "u"), (8, "v")]


def test_as_of(spark):
    """Times at, between, before and after marks, in more ranges than there are marks; overlap is refused."""
    import random

    from boardloom.operators import windows as wi
    from boardloom.operators.ranks import as_of, spread_running_sum

    rng = random.Random(3)
    starts = sorted(rng.sample(range(100, 2000), 40))
    times = [rng.randint(0, 2100) for _ in range(400)] + [starts[3]] * 200 + [None] * 3
    marks = spark.createDataFrame([(s, f"w{s}", t) for s, t in zip(starts, [*starts[1:], 2050], strict=True)], "starts_at long, label string, ends_at long")
    rows = spark.createDataFrame(list(enumerate(times)), "id int, at long")
    got = {r.id: r.label for r in as_of(rows, marks, "at", "starts_at").collect()}
    want = {i: None if t is None or t < starts[0] else f"w{max(s for s in starts if s <= t)}" for i, t in enumerate(times)}
    assert got == want
    gaps = marks.withColumn("ends_at", F.col("ends_at") - 5)
    ends = dict(zip(starts, [*starts[1:], 2050], strict=True))
    inside = lambda i: want[i] if want[i] and times[i] < ends[int(want[i][1:])] - 5 else None
    assert {r.id: r.label for r in wi.classify(rows, gaps, "at").collect()} == {i: inside(i) for i in want}
    assert "NestedLoop" not in wi.classify(rows, gaps, "at")._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="overlap"):
        wi.classify(rows, marks.withColumn("ends_at", F.col("ends_at") + 1), "at")
    sums = spread_running_sum(rows.where("at is not null"), [], [F.col("at"), F.col("id")], "at", "upto").collect()
    total = 0
    for r in sorted(sums, key=lambda r: (r["at"], r.id)):
        total += r["at"]
        assert r.upto == total


def test_documents_with_gaps(spark):
    path = shared_folder(spark, "docs")
    unit = {"character_id": "A", "tier": 0, "item_names": ["R_A"]}
    trait = [{"name": "X", "num_units": 1}, {"name": "X", "num_units": 3}, {"name": ""}]
    docs = [{"metadata": {"match_id": "m1"}, "info": {"queue_id": 1100, "participants": [{"units": [unit], "traits": trait}, {"level": 7}]}}, {"info": {"match_id": "m2"}}, {}]
    spark.createDataFrame([(json.dumps(d),) for d in docs], "value string").write.text(path)
    got = dc.read_matches(spark, path)
    assert sorted(r.match_id for r in got.collect()) == ["m1", "m2", "unknown"]
    assert sorted((r.participant_index, r.placement, r.level) for r in dc.participants(got).collect()) == [(0, 0, 0), (1, 0, 7)]
    assert [(r.unit_name, r.tier, r["items"]) for r in dc.units(got, ITEM_SETS).collect()] == [("A", 1, ["R_A"])]
    assert [(r.trait_name, r.num_units) for r in dc.traits(got).collect()] == [("X", 3)]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 20])
def test_midpoints(spark, n):
    rows = spark.range(1, n + 1).selectExpr("'c' AS cohort", "id AS rank")
    for k in {0, 1, 2, 3, n - 1, n, n + 5}:
        want = list(range(1, n + 1)) if k >= n else [(2 * i + 1) * n // (2 * k) + 1 for i in range(k)] if k > 0 else []
        assert sorted(r.rank for r in sm.evenly_spaced(rows, k).collect()) == want


@pytest.mark.parametrize(
    "total, room, weights, want",
    [
        (10, {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1, "c": 1}, {"a": 4, "b": 3, "c": 3}),
        (10, {"a": 2, "b": 100}, {"a": 8, "b": 2, "c": 5}, {"a": 2, "b": 8, "c": 0}),
        (50, {"a": 2, "b": 3}, {"a": 1, "b": 1}, {"a": 2, "b": 3, "c": 0}),
        (0, {"a": 2}, {"a": 1}, {"a": 0, "b": 0, "c": 0}),
    ],
)
def test_seats(spark, total, room, weights, want):
    ranked = spark.createDataFrame([(c, i) for c, n in room.items() for i in range(n)], "cohort string, player long")
    got = sm.cohort_seats(ranked, total, weights, ["a", "b", "c"])
    assert {r.cohort: r.k for r in got.collect()} == want
    with pytest.raises(ValueError):
        sm.cohort_seats(ranked, -1, weights, ["a"])


def test_empty_ladder(spark):
    empty = spark.createDataFrame([], "cohort string, player long, division int, points long")
    assert sm.ladder_rank(empty).count() == 0
    ranked = sm.ladder_rank(empty).selectExpr("*", "CAST(NULL AS BIGINT) AS last_sampled")
    assert sm.breadth_first_order(ranked, ["c"]).count() == 0


def test_disagreement_counts_pairs(spark):
    x = spark.createDataFrame([(1, i, g) for i, g in enumerate("aaabb")], "w int, board int, `group` string")
    y = spark.createDataFrame([(1, i, g) for i, g in enumerate("ppqqq")], "w int, board int, `group` string")
    got = gr.partition_disagreement(x, y, ["w", "board"], within=["w"]).first()
    assert (got.boards, got.pairs_both, got.pairs_x, got.pairs_y, got.disagree, got.either) == (5, 2, 4, 4, 4, 6)
