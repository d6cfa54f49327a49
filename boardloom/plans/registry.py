"""Queries by name, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardloom.sources.binding import BINDING_SQL, Boards

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Common table expressions on top of the binding.
CARRY_SQL = """
champ AS (SELECT match_id, participant_index, character_id, max(cost) AS cost, bool_or(committed) AS committed, bool_or(committed AND tier >= 3) AS hit
  FROM units GROUP BY match_id, participant_index, character_id),
carries AS (SELECT m.balance_window, c.character_id, c.match_id, c.participant_index, c.cost, c.hit, p.placement, p.level
  FROM champ c JOIN participants p USING (match_id, participant_index) JOIN matches m USING (match_id) WHERE c.committed)
"""


def query(name: str, sql: str | None = None, *, raw: bool = False):
    """Register ``f(boards)``; ``sql`` may use the binding's tables and ``carries``."""

    def register(f: Callable[[Boards], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Boards(spark, sf_dir))
        if sql:
            ORACLES[name] = sql if raw else f"WITH {BINDING_SQL}, {CARRY_SQL}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, so that summation order does not show."""
    return df.select(*[(F.round(F.col(c), digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def association_sql(keyed: str, min_games: int, tail: str = "") -> str:
    """The association formulas over a ``keyed`` SELECT with a row a carry board and key."""
    return f""", keyed AS ({keyed}),
whole AS (SELECT balance_window, character_id, count(*) AS n, sum(placement) AS place, count(*) FILTER (placement <= 4) AS top4, count(*) FILTER (placement = 1) AS win FROM carries GROUP BY ALL),
part AS (SELECT balance_window, character_id, key, count(*) AS g, sum(placement) AS pw, count(*) FILTER (placement <= 4) AS tw, count(*) FILTER (placement = 1) AS ww FROM keyed GROUP BY ALL HAVING count(*) >= {min_games}),
assoc AS (SELECT balance_window, character_id, key, g AS games, g / n AS inclusion_rate, pw / g AS avg_placement, tw / g AS top4_rate, ww / g AS win_rate, n - g AS games_without,
  CASE WHEN n > g THEN (place - pw) / (n - g) END AS avg_placement_without, CASE WHEN n > g THEN (top4 - tw) / (n - g) END AS top4_rate_without, CASE WHEN n > g THEN (win - ww) / (n - g) END AS win_rate_without,
  CASE WHEN n > g THEN (tw + top4 / n * 20) / (g + 20) - (top4 - tw + top4 / n * 20) / (n - g + 20) END AS top4_delta,
  CASE WHEN n > g THEN (place - pw) / (n - g) - pw / g END AS avg_placement_delta,
  CASE WHEN n > g THEN least(g, n - g) / (least(g, n - g) + 20.0) ELSE g / (g + 20.0) END AS confidence
  FROM part JOIN whole USING (balance_window, character_id)),
scored AS (SELECT *, coalesce(top4_delta, 0) * confidence AS score FROM assoc)
{tail or ASSOCIATION_ROWS}"""


_RATES = ["inclusion_rate", "avg_placement", "top4_rate", "win_rate", "avg_placement_without", "top4_rate_without", "win_rate_without", "top4_delta", "avg_placement_delta", "confidence", "score"]
ASSOCIATION_ROWS = "SELECT balance_window, character_id, key, games, games_without, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _RATES) + " FROM scored"
