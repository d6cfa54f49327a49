"""What a query shuffles: steps whose work must not grow with the product of two inputs."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from boardloom.operators import evidence as ev
from boardloom.operators import groups as gr
from boardloom.operators import ideas as de
from boardloom.operators import quality as qu
from boardloom.plans import all_oracles, all_queries


def shuffled(spark, make):
    """(rows of ``make()``, records that its stages shuffled)."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def records():
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (stages.apply(i) for i in range(stages.size()))}

    before = records()
    rows = [tuple(r) for r in make().collect()]
    return rows, sum(n for key, n in records().items() if key not in before)


def test_ideas_do_not_repeat_boards(spark):
    champions = spark.createDataFrame([("A", "Ann"), ("B", "Bea"), ("C", "Cid")], "character_id string, name string")
    boards = spark.range(2000).select(F.lit("w").alias("balance_window"), F.lit("A").alias("character_id"), F.col("id").cast("string").alias("match_id"), F.lit(0).alias("participant_index"), (F.col("id") % 8 + 1).cast("int").alias("placement"))
    units = boards.select("match_id", "participant_index", F.explode(F.expr("if(cast(match_id as int) % 2 = 0, array('A', 'B', 'B'), array('A', 'B', 'C'))")).alias("character_id"))
    traits = boards.select("match_id", "participant_index", F.lit("T").alias("trait_name"), (F.col("placement") % 3).alias("num_units"), F.lit(1).alias("tier_current"))

    def evidence(n):
        ideas = spark.range(n).select(F.col("id").alias("idea_id"), F.lit("Ann").alias("carry_name"), F.lit(None).cast("string").alias("carry_character_id"), F.array(F.lit("Bea"), F.lit("C"), F.lit("A"), F.lit("Dan")).alias("core_units"), F.expr("array(struct('T' as name, 2 as breakpoint))").alias("target_traits"))
        return shuffled(spark, lambda: de.idea_evidence(ideas, champions, boards, units, traits))

    want = {"unit:Bea": (2000, 1000), "unit:C": (1000, 500), "together": (1000, 500), "trait:T@2": (750, 250)}
    few, few_records = evidence(3)
    many, many_records = evidence(300)
    for rows, n in ((few, 3), (many, 300)):
        assert len(rows) == 4 * n
        assert all(want[piece] == (count, top4) for _, _, piece, count, top4 in rows)
    assert many_records - few_records < 300 * 40


def _plain_similarity(v, p):
    low = sum(min(w, p.get(u, 0.0)) for u, w in v.items())
    return round(low / (sum(v.values()) + sum(p.values()) - low), 9)


def test_boards_that_are_alike_are_scored_once(spark):
    """20 groups, 3 kinds of boards, 900 boards: pairs of boards and groups are written, not shuffled; values as in plain loops."""
    key = ["balance_window", "match_id", "participant_index"]
    kinds = [{"a": 1.0, "b": 2.0}, {"a": 2.0, "b": 0.5, "c": 1.0}, {"c": 1.0}]
    rows = [("w", str(i), 0, u, w) for i in range(900) for u, w in kinds[i % 3].items()]
    vectors = spark.createDataFrame(rows, "balance_window string, match_id string, participant_index int, unit string, weight double")
    groups = {f"g{n:02}": {"a": 1.0 + n / 20, "b": 1.0, "c": n / 40} for n in range(20)}
    profiles = spark.createDataFrame([("w", g, u, w, 0.2 if u == "c" else 0.5) for g, p in groups.items() for u, w in p.items()], "balance_window string, group string, unit string, weight double, presence double")
    got, records = shuffled(spark, lambda: gr.similarities(vectors, profiles, key, within=["balance_window"], group="group"))
    want = {("w", str(i), 0, g, _plain_similarity(kinds[i % 3], p)) for i in range(900) for g, p in groups.items() if i % 3 < 2}
    assert len(got) == len(want) and set(got) == want
    assert records < 6000
    best = {tuple(r) for r in gr.nearest(vectors, profiles, key, within=["balance_window"], group="group", least=0.7).collect()}
    top = {i: max((_plain_similarity(kinds[i % 3], p), [-ord(c) for c in g], g) for g, p in groups.items()) for i in range(900) if i % 3 < 2}
    assert best == {("w", str(i), 0, g, s) for i, (s, _, g) in top.items() if s >= 0.7}


def test_fingerprint_sql_states_its_buckets(spark, duck, sf_dir, monkeypatch):
    """Windows of more ids than a bucket holds: the SQL deals them out as the query does."""
    assert str(qu.BUCKET_IDS) in all_oracles()["s19_population_fingerprint"]
    sql = all_oracles()["s19_population_fingerprint"].replace(str(qu.BUCKET_IDS), "100")
    monkeypatch.setattr(qu, "BUCKET_IDS", 100)
    got = {tuple(r) for r in all_queries()["s19_population_fingerprint"](spark, sf_dir).collect()}
    assert got == set(duck.execute(sql).fetchall()) and len(got) == 7


def test_units_are_shuffled_once_for_cores_of_both_sizes(spark, sf_dir):
    """60,000 lines: cores of three and four need one shuffle of them, and carries meet their mates without a row for each pair."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    got, records = shuffled(spark, lambda: all_queries()["u02_union_cores"](spark, sf_dir))
    assert {r[2] for r in got} == {3, 4}
    assert records < 8 * lines


def test_cores_keep_boards_without_mates(spark):
    carries = spark.createDataFrame([("w", "A", str(i), 0, 1 + i % 8) for i in range(6)], "balance_window string, character_id string, match_id string, participant_index int, placement int")
    units = spark.createDataFrame([(str(i), 0, c) for i in range(5) for c in ("A", "B", "B", "C", "D")[: 5 if i < 3 else 4 if i < 4 else 1]], "match_id string, participant_index int, character_id string")
    got = {(r["key"], r["games"], r["games_without"]) for r in ev.recurring_cores(carries, units, size=3, min_games=3).collect()}
    assert got == {("B+C", 4, 2), ("B+D", 3, 3), ("C+D", 3, 3)}


def test_patterns_broadcast_nothing_in_their_rounds(spark):
    """Line-ups of six units: rounds join no tables, so what the driver holds does not follow their number."""
    from boardloom.operators import lineups as lu

    plans, taken = [], lu._turns
    lineups = sorted({tuple(sorted(((i >> k) * 7 + k * k) % 6 for k in range(6))) for i in range(400)})
    rows = [("w", 7, [f"u{x}" for x in units], 3 + i % 5) for i, units in enumerate(lineups)]
    promoted = spark.createDataFrame(rows, "balance_window string, level int, lineup array<string>, boards long")

    def seen(live):
        out = taken(live)
        plans.append(out._jdf.queryExecution().optimizedPlan().toString())
        return out

    lu._turns = seen
    try:
        got = lu.board_patterns(promoted).collect()
    finally:
        lu._turns = taken
    assert len(got) == len(rows) and plans and not any("Join" in p for p in plans)
    assert all(r.shell is None or sorted([*r.shell, r.flex]) == list(r.lineup) for r in got)


def test_orphans_bring_each_side_in_once(spark):
    """A task sorts no keys and joins no tables for orphans; keys with a null part meet nothing, each key comes once."""
    key = "match_id string, participant_index int"
    children = spark.createDataFrame([("a", 0), ("a", 0), ("a", 1), ("b", 0), ("b", None), ("b", None), (None, 2)], key)
    parents = spark.createDataFrame([("a", 0), ("c", 1), ("c", 1), ("b", None), (None, None), ("a", 1)], key)
    got = qu.orphans(children, parents, ["match_id", "participant_index"])
    want = [("b", 0, "parent"), ("b", None, "parent"), (None, 2, "parent"), ("c", 1, "child"), ("b", None, "child"), (None, None, "child")]
    assert got.columns == ["match_id", "participant_index", "missing"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") == 2


def test_champion_pages_deal_units_out_once(spark, sf_dir):
    """60,000 lines: lists of evidence come from one row a board, so only lines, orders and counts are shuffled."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    for name in ("a37_champion_pages", "s25_publish_pages"):
        got, records = shuffled(spark, lambda name=name: all_queries()[name](spark, sf_dir))
        assert len(got) == 175
        assert records < 4.5 * lines


def test_rules_are_compared_in_one_pass(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    got, records = shuffled(spark, lambda: all_queries()["j13_rule_comparison"](spark, sf_dir))
    assert len(got) == 175
    assert records < 2.5 * lines


def test_documents_are_compressed_and_dealt_out_once(spark, sf_dir, tmp_path, monkeypatch):
    """Documents take less disk than twice their tables; their lists need no shuffle beyond that of lines and orders."""
    from boardloom.plans import arrivals

    monkeypatch.setattr(arrivals, "shared_folder", lambda *_: str(tmp_path / "documents"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    matches, records = shuffled(spark, lambda: arrivals._published(arrivals.Boards(spark, sf_dir)).select("match_id", F.size("boards")))
    size = sum(p.stat().st_size for p in (tmp_path / "documents").glob("part-*"))
    assert sum(n for _, n in matches) == spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert size < 2 * sum((Path(sf_dir) / f"{t}.parquet").stat().st_size for t in ("orders", "lineitem"))
    assert records < 3 * lines


def test_documents_of_boards_without_units(spark):
    """A board without units or traits keeps its place with nulls, a match without boards has none, lists keep their order."""
    from boardloom.sources import documents as dc

    matches = spark.createDataFrame([("m", "v", 1, 5), ("n", "v", 1, 6)], "match_id string, game_version string, queue_id int, game_datetime long")
    boards = spark.createDataFrame([("m", 2, 1, 7), ("m", 0, 2, 8)], "match_id string, participant_index int, placement int, level int")
    units = spark.createDataFrame([("m", 2, 1, "B", 2, 1, ["x"]), ("m", 2, 0, "A", 1, 3, [])], "match_id string, participant_index int, unit_index int, character_id string, cost int, tier int, items array<string>")
    traits = spark.createDataFrame([("m", 0, "T", 2, 1, 1)], "match_id string, participant_index int, trait_name string, num_units int, style int, tier_current int")
    docs = {r.metadata.match_id: r.info.participants for r in dc.nested(matches, boards, units, traits).collect()}
    assert docs["n"] is None
    first, second = docs["m"]
    assert (first.placement, first.units, [t.name for t in first.traits]) == (2, None, ["T"])
    assert (second.placement, second.traits) == (1, None)
    assert [(u.character_id, u.rarity, u.tier, u.itemNames) for u in second.units] == [("A", 0, 3, []), ("B", 1, 1, ["x"])]
