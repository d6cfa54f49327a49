"""Registered queries: choosing players from ladders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardloom.operators import sampling as sm
from boardloom.plans.registry import query
from boardloom.sources.binding import Boards

#: fixed values: the cohorts of the binding, highest first, and their weights
COHORTS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
WEIGHTS = dict(zip(COHORTS, (40, 25, 15, 12, 8)))
SLICES, SEATS = 20, 120

ENTRIES_SQL = """ladder AS (SELECT o_orderpriority AS cohort, o_custkey AS player, CAST(1 + o_orderkey % 4 AS INTEGER) AS division, CAST(floor(o_totalprice) AS BIGINT) AS points FROM orders),
top AS (SELECT player, min(cohort) AS cohort FROM ladder GROUP BY player),
best AS (SELECT cohort, player, min(struct_pack(d := division, p := -points)) AS s FROM ladder WHERE player IS NOT NULL GROUP BY ALL),
seen AS (SELECT o_custkey AS player, CAST(max(year(o_orderdate)) AS BIGINT) AS last_sampled FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL),
chosen AS (SELECT b.cohort, b.player, s.d AS division, -s.p AS points, row_number() OVER (PARTITION BY b.cohort ORDER BY s.d, s.p, b.player) AS rank, count(*) OVER (PARTITION BY b.cohort) AS n, coalesce(last_sampled, -1) AS last
  FROM best b JOIN top USING (player, cohort) LEFT JOIN seen USING (player))
"""


def _entries(b: Boards) -> DataFrame:
    return b.read("orders").select(
        F.col("o_orderpriority").alias("cohort"),
        F.col("o_custkey").alias("player"),
        (1 + F.col("o_orderkey") % 4).cast("int").alias("division"),
        F.floor("o_totalprice").cast("long").alias("points"),
    )


def _ranked(b: Boards) -> DataFrame:
    seen = b.read("orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("player")).agg(F.max(F.year("o_orderdate")).cast("long").alias("last_sampled"))
    return sm.ladder_rank(sm.highest_cohort(_entries(b), COHORTS)).join(seen, "player", "left")


@query("w04_ladder_rank", f"""WITH {ENTRIES_SQL} SELECT cohort, player, s.d AS division, -s.p AS points, row_number() OVER (PARTITION BY cohort ORDER BY s.d, s.p, player) AS rank FROM best""", raw=True)
def ladder_rank(b):
    return sm.ladder_rank(_entries(b))


@query("w05_highest_cohort", f"WITH {ENTRIES_SQL} SELECT cohort, player, division, points FROM ladder JOIN top USING (player, cohort)", raw=True)
def highest_cohort(b):
    return sm.highest_cohort(_entries(b), COHORTS).select("cohort", "player", "division", "points")


@query("w06_evenly_spaced", f"""WITH {ENTRIES_SQL}, spots AS (SELECT cohort, CAST(((2 * i + 1) * n) // (2 * {SLICES}) AS BIGINT) + 1 AS rank FROM (SELECT DISTINCT cohort, n FROM chosen WHERE n > {SLICES}), range({SLICES}) r(i))
SELECT cohort, player, rank FROM chosen WHERE n <= {SLICES} UNION ALL SELECT cohort, player, rank FROM chosen JOIN spots USING (cohort, rank)""", raw=True)
def evenly_spaced(b):
    return sm.evenly_spaced(_ranked(b), SLICES).select("cohort", "player", "rank")


@query("w07_seed_rotation", f"""WITH {ENTRIES_SQL}, grouped AS (SELECT cohort, last, count(*) AS g FROM chosen GROUP BY ALL),
due AS (SELECT *, {SEATS} - coalesce(sum(g) OVER (PARTITION BY cohort ORDER BY last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seats_left FROM grouped),
spots AS (SELECT cohort, last, ((2 * i + 1) * g) // (2 * seats_left) + 1 AS spot FROM (SELECT cohort, last, CAST(g AS BIGINT) AS g, CAST(seats_left AS BIGINT) AS seats_left FROM due WHERE seats_left > 0 AND g > seats_left), range({SEATS}) r(i) WHERE i < seats_left),
placed AS (SELECT *, row_number() OVER (PARTITION BY cohort, last ORDER BY rank) AS spot FROM chosen)
SELECT cohort, player, rank, last FROM placed JOIN due USING (cohort, last) WHERE seats_left > 0 AND g <= seats_left
UNION ALL SELECT cohort, player, rank, last FROM placed JOIN spots USING (cohort, last, spot)""", raw=True)
def seed_rotation(b):
    seats = b.spark.createDataFrame([(c, SEATS) for c in COHORTS], "cohort string, k long")
    return sm.rotate(_ranked(b), seats).select("cohort", "player", "rank", F.coalesce("last_sampled", F.lit(-1)).alias("last"))


def _seat_rounds() -> str:
    """The rounds of the allocation, one after the other; a sixth would change nothing."""
    named = ", ".join(f"({c!r}, {w})" for c, w in WEIGHTS.items())
    rounds = [f"r0 AS (SELECT v.cohort, coalesce(room, 0) AS room, weight, CAST(0 AS BIGINT) AS k FROM (VALUES {named}) v(cohort, weight) LEFT JOIN (SELECT cohort, count(*) AS room FROM chosen GROUP BY cohort) USING (cohort))"]
    for i in range(5):
        rounds.append(f"""a{i} AS (SELECT *, k < room AS able, least((SELECT sum(room) // 2 FROM r0), (SELECT sum(room) FROM r0)) - sum(k) OVER () AS seats_left FROM r{i}),
b{i} AS (SELECT *, CASE WHEN able THEN seats_left * weight END AS share, sum(CASE WHEN able THEN weight END) OVER () AS whole FROM a{i}),
c{i} AS (SELECT *, coalesce(share // whole, 0) AS given, share % whole AS rest FROM b{i}),
d{i} AS (SELECT *, row_number() OVER (ORDER BY rest DESC NULLS LAST, cohort) <= seats_left - sum(given) OVER () AS more FROM c{i}),
r{i + 1} AS (SELECT cohort, room, weight, CAST(least(room, k + given + CASE WHEN able AND more THEN 1 ELSE 0 END) AS BIGINT) AS k FROM d{i})""")
    return ", ".join(rounds)


@query("w08_seat_allocation", f"WITH {ENTRIES_SQL}, {_seat_rounds()} SELECT cohort, k FROM r5", raw=True)
def seat_allocation(b):
    """Half of all players as seats, so that small cohorts are full and the rest is split again."""
    ranked = _ranked(b)
    return sm.cohort_seats(ranked, ranked.count() // 2, WEIGHTS, COHORTS)


@query("w09_breadth_first_order", f"""WITH {ENTRIES_SQL}, sizes AS (SELECT DISTINCT cohort, CAST(n AS BIGINT) AS n FROM chosen),
first_step AS (SELECT cohort, n, CASE WHEN n <= 2 THEN 1 ELSE greatest(1, CAST(round(n * (sqrt(5) - 1) / 2) AS BIGINT)) END AS s FROM sizes),
steps AS (SELECT cohort, n, min(s + i) AS s FROM first_step, range(1000) r(i) WHERE gcd(s + i, n) = 1 OR n <= 2 GROUP BY ALL),
spots AS (SELECT cohort, i AS queue_position, (i * s) % n + 1 AS rank FROM steps, (SELECT unnest(range((SELECT max(n) FROM sizes))) AS i) WHERE i < n)
SELECT cohort, player, queue_position, last AS queue_last, CAST(substr(cohort, 1, 1) AS INTEGER) - 1 AS queue_cohort FROM chosen JOIN spots USING (cohort, rank)""", raw=True)
def breadth_first_order(b):
    return sm.breadth_first_order(_ranked(b), COHORTS).select("cohort", "player", "queue_position", "queue_last", "queue_cohort")
