"""Registered queries: vectors, profiles and groups of boards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardloom.operators import groups as gr
from boardloom.plans.registry import query, rounded
from boardloom.sources.binding import BOARD, Boards
from boardloom.sources.shared import staged

KEY = ["balance_window", *BOARD]
#: Bound units have six shapes, so a group's units are common; two shared ones at 30% as in the operator.
LEAST = 0.6

GROUPS_SQL = """vectors AS MATERIALIZED (SELECT balance_window, match_id, participant_index, shape_id AS unit, max(CASE WHEN completed_item_count >= 2 THEN 2.0 WHEN cost >= 4 AND completed_item_count = 0 AND tier = 1 THEN 0.5 ELSE 1.0 END) AS weight
  FROM units JOIN matches USING (match_id) GROUP BY ALL),
members AS MATERIALIZED (SELECT balance_window, match_id, participant_index, min(character_id) AS grp FROM carries GROUP BY ALL),
profiles AS MATERIALIZED (SELECT balance_window, grp, unit, sum(weight) / any_value(n) AS weight, count(*) / any_value(n) AS presence FROM vectors JOIN members USING (balance_window, match_id, participant_index)
  JOIN (SELECT balance_window, grp, count(*) AS n FROM members GROUP BY ALL) USING (balance_window, grp) GROUP BY ALL),
scores AS MATERIALIZED (SELECT *, round(low / (a + g - low), 9) AS similarity FROM (SELECT balance_window, match_id, participant_index, grp, sum(least(v.weight, p.weight)) AS low, count(*) FILTER (presence >= 0.3) AS hits FROM vectors v JOIN profiles p USING (balance_window, unit) GROUP BY ALL HAVING count(*) FILTER (presence >= 0.3) >= 2)
  JOIN (SELECT match_id, participant_index, sum(weight) AS a FROM vectors GROUP BY ALL) USING (match_id, participant_index) JOIN (SELECT balance_window, grp, sum(weight) AS g FROM profiles GROUP BY ALL) USING (balance_window, grp)),
best AS (SELECT * FROM scores WHERE similarity >= 0.6 QUALIFY row_number() OVER (PARTITION BY match_id, participant_index ORDER BY similarity DESC, grp) = 1)"""


def _vectors(b: Boards) -> DataFrame:
    """Bound boards list three items a unit; the completed ones are taken as held."""
    held = F.when(F.col("completed_item_count") > 0, F.sequence(F.lit(1), F.col("completed_item_count"))).otherwise(F.array().cast("array<int>"))
    units = b.units.select(*BOARD, F.col("shape_id").alias("unit"), "cost", "tier", held.alias("items")).join(b.windows, "match_id")
    return gr.board_vectors(units, KEY)


def _members(b: Boards) -> DataFrame:
    """Boards with a committed unit, grouped by the first of them."""
    lead = b.units.where("committed").groupBy(*BOARD).agg(F.min("character_id").alias("group"))
    return lead.join(b.participants.select(*BOARD), BOARD).join(b.windows, "match_id")


def _profiles(b: Boards) -> DataFrame:
    return _with_profiles(b)[1]


def _with_profiles(b: Boards) -> tuple[DataFrame, DataFrame]:
    vectors = staged(_vectors(b))
    return vectors, gr.mean_profiles(vectors, _members(b), KEY, ["balance_window", "group"])


def _best(b: Boards) -> DataFrame:
    return gr.nearest(*_with_profiles(b), KEY, within=["balance_window"], group="group", least=LEAST)


@query("c01_board_vectors", f", {GROUPS_SQL} SELECT balance_window, match_id, participant_index, unit, CAST(weight AS DOUBLE) AS weight FROM vectors")
def board_vectors(b):
    return _vectors(b)


@query("c03_mean_profiles", f', {GROUPS_SQL} SELECT balance_window, grp AS "group", unit, round(weight, 6) AS weight, round(presence, 6) AS presence FROM profiles')
def mean_profiles(b):
    return rounded(_profiles(b))


@query("c02_similarities", f', {GROUPS_SQL} SELECT balance_window, match_id, participant_index, grp AS "group", round(similarity, 6) AS similarity FROM scores')
def similarities(b):
    return rounded(gr.similarities(*_with_profiles(b), KEY, within=["balance_window"], group="group"))


@query("c05_best_group", f', {GROUPS_SQL} SELECT balance_window, match_id, participant_index, grp AS "group", round(similarity, 6) AS similarity FROM best')
def best_group(b):
    return rounded(_best(b))


@query("c10_group_core", f', {GROUPS_SQL} SELECT balance_window, grp AS "group", unit, round(presence, 6) AS presence FROM profiles WHERE presence >= 0.75')
def group_core(b):
    return rounded(gr.group_core(_profiles(b)).select("balance_window", "group", "unit", "presence"))


@query("u05_partition_disagreement", f""", {GROUPS_SQL}, cells AS (SELECT m.balance_window, m.grp AS x, b.grp AS y, count(*) AS n FROM members m JOIN best b USING (match_id, participant_index) GROUP BY ALL),
px AS (SELECT balance_window, sum(n * (n - 1) // 2) AS pairs_x FROM (SELECT balance_window, x, sum(n) AS n FROM cells GROUP BY ALL) GROUP BY ALL), py AS (SELECT balance_window, sum(n * (n - 1) // 2) AS pairs_y FROM (SELECT balance_window, y, sum(n) AS n FROM cells GROUP BY ALL) GROUP BY ALL),
pb AS (SELECT balance_window, sum(n) AS boards, sum(n * (n - 1) // 2) AS pairs_both FROM cells GROUP BY ALL)
SELECT balance_window, CAST(boards AS BIGINT) AS boards, CAST(pairs_both AS BIGINT) AS pairs_both, CAST(pairs_x AS BIGINT) AS pairs_x, CAST(pairs_y AS BIGINT) AS pairs_y, CAST(pairs_x + pairs_y - 2 * pairs_both AS BIGINT) AS disagree, CAST(pairs_x + pairs_y - pairs_both AS BIGINT) AS either FROM pb JOIN px USING (balance_window) JOIN py USING (balance_window)""")
def partition_disagreement(b):
    """The first committed unit of a board against its most similar group."""
    return gr.partition_disagreement(_members(b), _best(b), KEY, within=["balance_window"])
