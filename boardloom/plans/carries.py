"""Registered queries: carries, evidence, discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardloom.operators import evidence as ev
from boardloom.plans.registry import association_sql, query, rounded
from boardloom.sources.binding import ITEM_SETS, Boards
from boardloom.sources.shared import staged


def _carries(b: Boards) -> DataFrame:
    return ev.carry_boards(b.participants, b.units, b.windows)


STATS_SQL = """, observed AS (SELECT balance_window, count(*) AS observable FROM participants JOIN matches USING (match_id)
  WHERE EXISTS (SELECT 1 FROM units u WHERE u.match_id = participants.match_id AND u.participant_index = participants.participant_index) GROUP BY 1),
counted AS (SELECT balance_window, character_id, cost, count(*) AS appearances, count(*) FILTER (committed) AS commitment_games,
  avg(placement) FILTER (committed) AS avg_place, count(*) FILTER (committed AND placement <= 4) AS top4s, count(*) FILTER (committed AND placement = 1) AS wins,
  count(*) FILTER (committed AND hit) AS hits, count(*) FILTER (committed AND hit AND placement <= 4) AS hit_top4s, avg(placement) FILTER (committed AND hit) AS avg_place_hit,
  count(*) FILTER (committed AND NOT hit) AS misses, count(*) FILTER (committed AND NOT hit AND placement <= 4) AS miss_top4s, avg(placement) FILTER (committed AND NOT hit) AS avg_place_miss
  FROM champ JOIN participants USING (match_id, participant_index) JOIN matches USING (match_id) WHERE cost BETWEEN {low} AND {high} GROUP BY ALL HAVING count(*) FILTER (committed) >= {least}),
rated AS (SELECT *, commitment_games / observable AS usage_rate, appearances / observable AS appearance_rate, commitment_games / appearances AS conversion_rate,
  top4s / commitment_games AS top4_rate, wins / commitment_games AS win_rate, hits / commitment_games AS hit_rate,
  (top4s + 30.0) / (commitment_games + 60.0) AS posterior_top4, commitment_games / (commitment_games + 60.0) AS confidence FROM counted JOIN observed USING (balance_window)),
stats AS (SELECT *, 100.0 * (0.45 * (0.5 + greatest(-0.5, least(0.5, posterior_top4 - 0.5))) + 0.20 * least(1.0, greatest(0.0, (wins + 7.5) / (commitment_games + 60.0) / 0.25))
  + 0.25 * least(1.0, greatest(0.0, 1.0 - usage_rate / 0.08)) + 0.10 * confidence) AS score FROM rated)
"""
_COUNTS = ["appearances", "commitment_games", "top4s", "wins", "hits", "hit_top4s", "misses", "miss_top4s", "observable"]
_RATES = ["avg_place", "avg_place_hit", "avg_place_miss", "usage_rate", "appearance_rate", "conversion_rate", "top4_rate", "win_rate", "hit_rate", "posterior_top4", "confidence", "score"]
_STATS_ROWS = "SELECT balance_window, character_id, cost, " + ", ".join(_COUNTS) + ", " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _RATES) + " FROM stats"


def _stats(b: Boards, **how) -> DataFrame:
    return ev.carry_stats(b.participants, b.units, b.windows, **how)


@query("a01_carry_stats", STATS_SQL.format(low=1, high=3, least=3) + _STATS_ROWS)
def carry_stats(b):
    return rounded(_stats(b))


@query("p08_cost_and_sample_filter", STATS_SQL.format(low=4, high=5, least=100) + _STATS_ROWS)
def cost_and_sample_filter(b):
    return rounded(_stats(b, min_cost=4, max_cost=5, min_samples=100))


@query(
    "t06_leaderboard",
    STATS_SQL.format(low=1, high=3, least=20) + "SELECT balance_window, character_id, cost, commitment_games, round(score, 6) AS score, row_number() OVER (PARTITION BY balance_window ORDER BY score DESC, character_id, cost) AS place FROM stats QUALIFY place <= 10",
)
def leaderboard(b):
    top = ev.leaderboard(_stats(b, min_samples=20), 10)
    return rounded(top.select("balance_window", "character_id", "cost", "commitment_games", "score", F.col("place").cast("long").alias("place")))


@query(
    "t01_recurrence_order",
    STATS_SQL.format(low=1, high=5, least=10) + "SELECT balance_window, character_id, cost, commitment_games, row_number() OVER (PARTITION BY balance_window ORDER BY commitment_games DESC, character_id, cost) AS place FROM stats",
)
def recurrence_order(b):
    rows = ev.recurrence_order(_stats(b, max_cost=5, min_samples=10))
    return rows.select("balance_window", "character_id", "cost", "commitment_games", F.col("place").cast("long").alias("place"))


@query("a02_carry_board_counts", "SELECT balance_window, character_id, count(*) AS boards FROM carries GROUP BY ALL")
def carry_board_counts(b):
    return _carries(b).groupBy(*ev.CARRY).agg(F.count(F.lit(1)).alias("boards"))


@query(
    "a03_carry_board_average",
    "SELECT balance_window, count(*) AS boards, round(avg(placement), 6) AS avg_placement, round(count(*) FILTER (placement <= 4) / count(*), 6) AS top4_rate, round(count(*) FILTER (placement = 1) / count(*), 6) AS win_rate "
    "FROM (SELECT DISTINCT balance_window, match_id, participant_index, placement FROM carries) GROUP BY ALL",
)
def carry_board_average(b):
    boards = _carries(b).select("balance_window", *ev.BOARD, "placement").distinct()
    n = F.count(F.lit(1))
    return rounded(boards.groupBy("balance_window").agg(n.alias("boards"), F.avg("placement").alias("avg_placement"), (F.count_if(F.col("placement") <= 4) / n).alias("top4_rate"), (F.count_if(F.col("placement") == 1) / n).alias("win_rate")))


@query("a04_window_list", "SELECT balance_window, count(*) AS matches, max(game_datetime) AS latest FROM matches GROUP BY ALL")
def window_list(b):
    return b.matches.groupBy("balance_window").agg(F.count(F.lit(1)).alias("matches"), F.max("game_datetime").alias("latest"))


@query("a20_appearances", "SELECT balance_window, character_id, count(*) AS boards FROM champ JOIN matches USING (match_id) GROUP BY ALL")
def appearances(b):
    return ev.champion_boards(b.units).join(b.windows, "match_id").groupBy(*ev.CARRY).agg(F.count(F.lit(1)).alias("boards"))


PARTNERS_SQL = "SELECT c.*, u.character_id AS key FROM carries c JOIN (SELECT DISTINCT match_id, participant_index, character_id FROM units) u ON c.match_id = u.match_id AND c.participant_index = u.participant_index AND c.character_id <> u.character_id"


@query("a06_partner_associations", association_sql(PARTNERS_SQL, 1))
def partner_associations(b):
    return rounded(ev.partner_associations(_carries(b), b.units))


@query(
    "j04_carry_partners",
    "SELECT c.balance_window, c.character_id, c.match_id, c.participant_index, u.character_id AS key FROM carries c LEFT JOIN (SELECT DISTINCT match_id, participant_index, character_id FROM units) u "
    "ON c.match_id = u.match_id AND c.participant_index = u.participant_index AND c.character_id <> u.character_id",
)
def carry_partners(b):
    return ev.carry_partners(_carries(b), b.units).select(*ev.CARRY, *ev.BOARD, "key")


CANONICAL_SQL = """canonical AS (SELECT * FROM units WHERE committed QUALIFY row_number() OVER (PARTITION BY match_id, participant_index, character_id ORDER BY completed_item_count DESC, tier DESC, unit_index) = 1),
games AS (SELECT c.*, list_sort(list_filter(u.items, lambda x: x NOT IN ('D_0','D_1','D_2','T_0','T_1'))) AS own_items FROM carries c JOIN canonical u USING (match_id, participant_index, character_id))"""
_SINGLES = f"WITH {CANONICAL_SQL} SELECT DISTINCT balance_window, character_id, match_id, participant_index, placement, unnest(own_items) AS key FROM games"
_PAIRS = f"""WITH {CANONICAL_SQL}, spread AS (SELECT balance_window, character_id, match_id, participant_index, placement, own_items, unnest(range(1, len(own_items) + 1)) AS i FROM games),
two AS (SELECT *, unnest(range(i + 1, len(own_items) + 1)) AS j FROM spread) SELECT DISTINCT balance_window, character_id, match_id, participant_index, placement, own_items[i] || '+' || own_items[j] AS key FROM two"""
_PACKAGES = f"WITH {CANONICAL_SQL} SELECT balance_window, character_id, match_id, participant_index, placement, array_to_string(own_items, '+') AS key FROM games WHERE len(own_items) = 3"


@query("w01_canonical_copy", f", {CANONICAL_SQL} SELECT match_id, participant_index, character_id, unit_index, tier, completed_item_count FROM canonical")
def canonical_copy(b):
    return ev.canonical_copies(b.units).select(*ev.BOARD, "character_id", "unit_index", "tier", "completed_item_count")


@query("a07_item_associations", association_sql(_SINGLES, 1))
def item_associations(b):
    return rounded(ev.item_associations(_carries(b), b.units, ITEM_SETS, 1, min_games=1))


@query("a07_item_pairs", association_sql(_PAIRS, 2))
def item_pairs(b):
    return rounded(ev.item_associations(_carries(b), b.units, ITEM_SETS, 2, min_games=2))


@query("a07_item_packages", association_sql(_PACKAGES, 2))
def item_packages(b):
    return rounded(ev.item_associations(_carries(b), b.units, ITEM_SETS, 3, min_games=2))


_TRAITS = "SELECT c.*, t.trait_name, t.num_units, t.trait_name || ':' || CAST(t.num_units AS VARCHAR) AS key FROM carries c JOIN traits t USING (match_id, participant_index) WHERE t.tier_current >= 1"


@query("j05_carry_traits", "SELECT c.balance_window, c.character_id, c.match_id, c.participant_index, coalesce(t.trait_name, '') AS trait_name, coalesce(t.num_units, 0) AS num_units FROM carries c LEFT JOIN traits t ON c.match_id = t.match_id AND c.participant_index = t.participant_index AND t.tier_current >= 1")
def carry_traits(b):
    return ev.carry_traits(_carries(b), b.traits).select(*ev.CARRY, *ev.BOARD, F.coalesce("trait_name", F.lit("")).alias("trait_name"), F.coalesce("num_units", F.lit(0)).alias("num_units"))


@query("a08_trait_counts", association_sql(_TRAITS, 2))
def trait_counts(b):
    return rounded(ev.trait_count_associations(_carries(b), b.traits))


@query("a09_trait_profile", association_sql(_TRAITS.replace("t.trait_name || ':' || CAST(t.num_units AS VARCHAR) AS key", "t.trait_name AS key"), 1))
def trait_profile(b):
    return rounded(ev.trait_profile(_carries(b), b.traits))


_MATES = """WITH pairs AS ({partners}), frequent AS (SELECT balance_window, character_id, key FROM pairs GROUP BY ALL HAVING count(*) >= 10),
kept AS (SELECT pairs.* FROM pairs JOIN frequent USING (balance_window, character_id, key))"""
_CORES3 = _MATES.format(partners=PARTNERS_SQL) + " SELECT a.balance_window, a.character_id, a.match_id, a.participant_index, a.placement, a.key || '+' || b.key AS key FROM kept a JOIN kept b USING (balance_window, character_id, match_id, participant_index) WHERE a.key < b.key"
_CORES4 = _MATES.format(partners=PARTNERS_SQL) + " SELECT a.balance_window, a.character_id, a.match_id, a.participant_index, a.placement, a.key || '+' || b.key || '+' || c.key AS key FROM kept a JOIN kept b USING (balance_window, character_id, match_id, participant_index) JOIN kept c USING (balance_window, character_id, match_id, participant_index) WHERE a.key < b.key AND b.key < c.key"


def _placed(b: Boards) -> tuple[DataFrame, DataFrame]:
    """Committed boards, and all champions of all boards; units are read once."""
    placed = staged(ev.placed_champions(b.participants, b.units, b.windows))
    return ev.committed_boards(placed), placed


@query("a10_cores_of_three", association_sql(_CORES3, 10))
def cores_of_three(b):
    return rounded(ev.recurring_cores(*_placed(b), size=3))


@query("a10_cores_of_four", association_sql(_CORES4, 3).replace(">= 10)", ">= 3)"))
def cores_of_four(b):
    return rounded(ev.recurring_cores(*_placed(b), size=4, min_games=3))


@query("t02_most_common_first", association_sql(PARTNERS_SQL, 1, "SELECT balance_window, character_id, key, games, row_number() OVER (PARTITION BY balance_window, character_id ORDER BY games DESC, key) AS place FROM scored QUALIFY place <= 6"))
def most_common_first(b):
    rows = ev.most_common_first(ev.partner_associations(_carries(b), b.units), 6)
    return rows.select(*ev.CARRY, "key", "games", F.col("place").cast("long").alias("place"))


@query("t03_score_order", association_sql(PARTNERS_SQL, 5, "SELECT balance_window, character_id, key, round(score, 6) + 0.0 AS score, rank() OVER (PARTITION BY balance_window, character_id ORDER BY round(score, 9) DESC, key) AS place FROM scored"))
def score_order(b):
    rows = ev.partner_associations(_carries(b), b.units, min_games=5).withColumn("s", F.round("score", 9))
    ranked = ev.top_by(rows, ev.CARRY, [F.desc("s"), "key"], 1 << 30)
    return rounded(ranked.select(*ev.CARRY, "key", "score", F.col("place").cast("long").alias("place")))


BASELINE_SQL = STATS_SQL.format(low=1, high=5, least=10) + ", base AS (SELECT balance_window, sum(posterior_top4 * commitment_games) / sum(commitment_games) AS baseline FROM stats GROUP BY 1)"


@query("a22_population_baseline", BASELINE_SQL + " SELECT balance_window, round(baseline, 6) AS baseline FROM base")
def population_baseline(b):
    return rounded(ev.population_baseline(_stats(b, max_cost=5, min_samples=10)))


@query("a23_item_flexibility", association_sql(_SINGLES, 1, "SELECT balance_window, character_id, round(least(1.0, count(*) FILTER (games >= 3 AND confidence >= 0.15 AND coalesce(top4_delta >= 0, true)) / 3), 6) AS item_flexibility FROM scored GROUP BY ALL"))
def item_flexibility(b):
    return rounded(ev.item_flexibility(ev.item_associations(_carries(b), b.units, ITEM_SETS, 1, min_games=1)))


@query("a18_simple_partners", f", pairs AS ({PARTNERS_SQL}), rates AS (SELECT balance_window, character_id, key, count(*) AS games, count(*) FILTER (placement <= 4) / count(*) AS top4_rate FROM pairs GROUP BY ALL HAVING count(*) >= 3) "
       "SELECT balance_window, character_id, key, games, round(top4_rate, 6) AS top4_rate FROM rates QUALIFY row_number() OVER (PARTITION BY balance_window, character_id ORDER BY round(top4_rate, 9) DESC, games DESC, key) <= 8")
def simple_partners(b):
    pairs = ev.carry_partners(_carries(b), b.units).where("key is not null")
    n = F.count(F.lit(1))
    rates = pairs.groupBy(*ev.CARRY, "key").agg(n.alias("games"), (F.count_if(F.col("placement") <= 4) / n).alias("top4_rate")).where("games >= 3")
    return rounded(ev.top_by(rates, ev.CARRY, [F.desc(F.round("top4_rate", 9)), F.desc("games"), "key"], 8).drop("place"))


@query("a19_item_sets", f", {CANONICAL_SQL}, sets AS (SELECT c.balance_window, c.character_id, array_to_string(list_sort(u.items), '+') AS item_set, count(*) AS games FROM carries c JOIN canonical u USING (match_id, participant_index, character_id) GROUP BY ALL) "
       "SELECT * FROM sets QUALIFY row_number() OVER (PARTITION BY balance_window, character_id ORDER BY games DESC, item_set) <= 5")
def item_sets(b):
    copies = ev.canonical_copies(b.units).select(*ev.BOARD, "character_id", F.array_join(F.array_sort("items"), "+").alias("item_set"))
    sets = _carries(b).join(copies, [*ev.BOARD, "character_id"]).groupBy(*ev.CARRY, "item_set").agg(F.count(F.lit(1)).alias("games"))
    return ev.top_by(sets, ev.CARRY, [F.desc("games"), "item_set"], 5).drop("place")


def _candidates(b: Boards) -> DataFrame:
    units = staged(b.units)
    placed = staged(ev.placed_champions(b.participants, units, b.windows))
    carries = ev.committed_boards(placed)
    items = ev.item_associations(carries, units, ITEM_SETS, 1, min_games=1)
    return ev.opportunity_scores(ev.stats_of(placed, max_cost=5, min_samples=10), ev.partner_associations(carries, placed), items)


_OPPORTUNITY = association_sql(PARTNERS_SQL, 1, "SELECT balance_window, character_id, max(score) AS best_partner FROM scored GROUP BY ALL")
_PIECES = ["relative_performance", "carry_rarity", "champion_rarity", "confidence_part", "floor_ceiling", "partner_shell", "flexibility", "cost_bias", "opportunity"]
_A24 = (
    BASELINE_SQL
    + f", best AS (SELECT * FROM (WITH dummy AS (SELECT 1) {_OPPORTUNITY})), flex AS (SELECT * FROM (WITH dummy AS (SELECT 1) "
    + association_sql(_SINGLES, 1, "SELECT balance_window, character_id, least(1.0, count(*) FILTER (games >= 3 AND confidence >= 0.15 AND coalesce(top4_delta >= 0, true)) / 3) AS f FROM scored GROUP BY ALL")
    + """)), joined AS (SELECT *, CASE WHEN baseline > 0 THEN baseline ELSE 0.5 END AS prior FROM stats JOIN base USING (balance_window) LEFT JOIN best USING (balance_window, character_id) LEFT JOIN flex USING (balance_window, character_id)),
pieces AS (SELECT balance_window, character_id, cost, least(1.0, greatest(0.0, posterior_top4 / (baseline * 2))) AS relative_performance, least(1.0, greatest(0.0, 1 - usage_rate / 0.08)) AS carry_rarity,
  least(1.0, greatest(0.0, 1 - appearance_rate / 0.2)) AS champion_rarity, confidence AS confidence_part,
  least(1.0, greatest(0.0, 0.5 * (CASE WHEN hits > 0 THEN (hit_top4s + prior * 10) / (hits + 10) ELSE top4_rate END) + 0.5 * (CASE WHEN misses > 0 THEN (miss_top4s + prior * 10) / (misses + 10) ELSE top4_rate END))) AS floor_ceiling,
  least(1.0, greatest(0.0, coalesce(best_partner, 0) / 0.15)) AS partner_shell, coalesce(f, 0) AS flexibility, CASE WHEN cost <= 3 THEN 1.0 ELSE 0.6 END AS cost_bias FROM joined),
summed AS (SELECT *, 100 * (0.25 * relative_performance + 0.12 * carry_rarity + 0.08 * champion_rarity + 0.10 * confidence_part + 0.20 * floor_ceiling + 0.10 * partner_shell + 0.05 * flexibility + 0.10 * cost_bias) AS opportunity FROM pieces)
SELECT balance_window, character_id, cost, """
    + ", ".join(f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in _PIECES)
    + " FROM summed"
)


@query("a24_opportunity_score", _A24)
def opportunity_score(b):
    return rounded(_candidates(b).select(*ev.CARRY, "cost", *_PIECES))


def _lists_sql() -> str:
    pick = "SELECT '{kind}' AS kind, balance_window, character_id, key, games, top4_rate, top4_delta, confidence, row_number() OVER (PARTITION BY balance_window, character_id ORDER BY games DESC, key) AS place FROM scored QUALIFY place <= 5"
    parts = (("partners", PARTNERS_SQL, 1), ("items", _SINGLES, 1), ("traits", _TRAITS, 2))
    return " UNION ALL ".join(f"SELECT * FROM (WITH dummy AS (SELECT 1) {association_sql(sql, least, pick.format(kind=kind))})" for kind, sql, least in parts)


@query("a25_discovery_candidates", _A24[: _A24.rindex("SELECT balance_window, character_id, cost,")].rstrip() + f", lists AS ({_lists_sql()}) SELECT s.balance_window, s.character_id, s.cost, round(CAST(s.opportunity AS DOUBLE), 6) + 0.0 AS opportunity, kind, place, key, games, round(top4_rate, 6) + 0.0 AS top4_rate, round(top4_delta, 6) + 0.0 AS top4_delta, round(confidence, 6) + 0.0 AS confidence FROM summed s JOIN lists l ON l.balance_window = s.balance_window AND l.character_id = s.character_id")
def discovery_candidates(b):
    """Candidates with their lists, a row for each entry of a list."""
    units = staged(b.units)
    placed = staged(ev.placed_champions(b.participants, units, b.windows))
    carries = staged(ev.committed_boards(placed))
    items = staged(ev.item_associations(carries, units, ITEM_SETS, 1, min_games=1))
    partners = staged(ev.partner_associations(carries, placed))
    traits = ev.trait_count_associations(carries, b.traits)
    out = staged(ev.discovery_candidates(ev.stats_of(placed, max_cost=5, min_samples=10), partners, items, traits))
    entries = None
    for kind in ("partners", "items", "traits"):
        rows = out.select(*ev.CARRY, "cost", "opportunity", F.lit(kind).alias("kind"), F.inline(f"top_{kind}"))
        entries = rows if entries is None else entries.unionByName(rows)
    return rounded(entries.withColumn("place", F.col("place").cast("long")))


@query("a05_associations", association_sql("SELECT c.*, CAST(level AS VARCHAR) AS key FROM carries c", 1))
def associations(b):
    """The formulas on their own: a carry's boards at one level against its other boards."""
    carries = _carries(b)
    return rounded(ev.associations(carries, carries.withColumn("key", F.col("level").cast("string")), min_games=1))
