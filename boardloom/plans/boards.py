"""Registered queries: line-ups, patterns, directories, store checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardloom.functions import rules
from boardloom.operators import evidence as ev
from boardloom.operators import lineups as lu
from boardloom.operators.ranks import spread_row_number
from boardloom.plans.carries import CANONICAL_SQL, _carries
from boardloom.plans.registry import query, rounded
from boardloom.sources.binding import ITEM_SETS, Boards

FLOOR = 3  # see FIXTURES.md: few line-ups of the test tables have more boards


def _lineups(b: Boards) -> DataFrame:
    return lu.board_lineups(b.participants, b.units, b.windows)


def _plus(*names: str) -> list:
    return [F.array_join(F.col(n), "+").alias(n) for n in names]


LINEUP_SQL = f"""lined AS (SELECT match_id, participant_index, string_agg(shape_id, '+' ORDER BY shape_id) AS lineup, max(tier) AS best_tier FROM units GROUP BY ALL),
boards AS (SELECT m.balance_window, p.*, l.lineup, l.best_tier FROM participants p JOIN lined l USING (match_id, participant_index) JOIN matches m USING (match_id) WHERE level BETWEEN 1 AND 10),
promoted AS (SELECT balance_window, level, lineup, count(*) AS boards, CAST(sum(placement) AS BIGINT) AS placement_sum, count(*) FILTER (placement <= 4) AS top4, count(*) FILTER (placement = 1) AS wins, count(*) FILTER (best_tier >= 3) AS three_star
  FROM boards GROUP BY ALL HAVING count(*) >= {FLOOR})"""


@query("a12_exact_lineups", f", {LINEUP_SQL} SELECT p.*, n.level_boards FROM promoted p JOIN (SELECT balance_window, level, count(*) AS level_boards FROM boards GROUP BY ALL) n USING (balance_window, level)")
def exact_lineups(b):
    rows = lu.exact_lineups(_lineups(b), min_boards=FLOOR)
    return rows.select(*lu.AT, *_plus("lineup"), "boards", "placement_sum", "top4", "wins", "three_star", "level_boards")


@query(
    "a12_level_summary",
    f", {LINEUP_SQL}, each AS (SELECT balance_window, level, lineup, count(*) AS n FROM boards GROUP BY ALL) SELECT balance_window, level, CAST(sum(n) AS BIGINT) AS boards, count(*) AS distinct_lineups, count(*) FILTER (n >= {FLOOR}) AS promoted, CAST(coalesce(sum(n) FILTER (n >= {FLOOR}), 0) AS BIGINT) AS boards_in_promoted FROM each GROUP BY ALL",
)
def level_summary(b):
    return lu.level_summary(_lineups(b), min_boards=FLOOR)


@query(
    "a13_window_lineups",
    f", {LINEUP_SQL}, kept AS (SELECT b.* FROM boards b JOIN promoted USING (balance_window, level, lineup)) SELECT k.balance_window, k.level, k.lineup, coalesce(c.character_id, '') AS carry, count(*) AS boards FROM kept k LEFT JOIN carries c USING (match_id, participant_index) GROUP BY ALL",
)
def window_lineups(b):
    boards = _lineups(b)
    rows = lu.lineup_carries(boards, lu.exact_lineups(boards, min_boards=FLOOR))
    return rows.select(*lu.AT, *_plus("lineup"), F.coalesce("carry", F.lit("")).alias("carry"), "boards")


_SHAPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
_COUNT = "len(list_filter({a}, lambda x: x = '{s}'))"
_DIFFS = ", ".join(f"{_COUNT.format(a='p.units', s=s)} - {_COUNT.format(a='q.units', s=s)} AS d{i}" for i, s in enumerate(_SHAPES))
_OUT = "CASE " + " ".join(f"WHEN d{i} = {{v}} THEN '{s}'" for i, s in enumerate(_SHAPES)) + " END"


@query(
    "j12_one_slot_alternatives",
    f", {LINEUP_SQL}, split AS (SELECT *, string_split(lineup, '+') AS units FROM promoted), pairs AS (SELECT p.balance_window, p.level, p.lineup, q.lineup AS other, q.boards AS other_boards, {_DIFFS} FROM split p JOIN split q ON p.balance_window = q.balance_window AND p.level = q.level AND p.lineup <> q.lineup AND len(p.units) = len(q.units)) "
    f"SELECT balance_window, level, lineup, {_OUT.format(v=1)} AS out_unit, {_OUT.format(v=-1)} AS in_unit, other, other_boards FROM pairs WHERE {' + '.join(f'abs(d{i})' for i in range(6))} = 2",
)
def one_slot_alternatives(b):
    rows = lu.one_slot_alternatives(lu.exact_lineups(_lineups(b), min_boards=FLOOR))
    return rows.select(*lu.AT, *_plus("lineup"), "out_unit", "in_unit", *_plus("other"), "other_boards")


def _shape(carry):
    """Bound line-ups hold six shapes, bound carries are 25 brands: a brand's number picks its shape."""
    return F.element_at(F.array(*map(F.lit, _SHAPES)), F.regexp_extract(carry, "([0-9]+)", 1).cast("int") % 6 + 1)


def _carry_lineups(b: Boards) -> DataFrame:
    """Line-ups on at least FLOOR boards of a carry's shape at one level of a window."""
    boards = _lineups(b).withColumn("carry", F.explode(F.array_distinct(F.transform("carries", _shape))))
    return lu.exact_lineups(boards, min_boards=FLOOR, extra=["carry"])


_SHAPE_SQL = "[" + ", ".join(f"'{s}'" for s in _SHAPES) + "][CAST(regexp_extract(character_id, '([0-9]+)', 1) AS INTEGER) % 6 + 1]"


@query(
    "j12_carry_alternatives",
    f", {LINEUP_SQL}, held AS (SELECT DISTINCT match_id, participant_index, {{shape}} AS carry FROM units WHERE committed), kept AS (SELECT balance_window, level, carry, lineup, count(*) AS boards FROM boards JOIN held USING (match_id, participant_index) GROUP BY ALL HAVING count(*) >= {FLOOR}), "
    f"split AS (SELECT *, string_split(lineup, '+') AS units FROM kept), pairs AS (SELECT p.balance_window, p.level, p.carry, p.lineup, q.lineup AS other, q.boards AS other_boards, {_DIFFS} FROM split p JOIN split q ON p.balance_window = q.balance_window AND p.level = q.level AND p.carry = q.carry AND p.lineup <> q.lineup AND len(p.units) = len(q.units)) "
    f"SELECT * FROM (SELECT balance_window, level, carry, lineup, {_OUT.format(v=1)} AS out_unit, {_OUT.format(v=-1)} AS in_unit, other, other_boards FROM pairs WHERE {' + '.join(f'abs(d{i})' for i in range(6))} = 2) WHERE out_unit <> carry AND in_unit <> carry".replace("{shape}", _SHAPE_SQL),
)
def carry_alternatives(b):
    """Alternatives among the line-ups of each carry; the shape that stands for the carry is never swapped."""
    rows = lu.one_slot_alternatives(_carry_lineups(b), "carry")
    return rows.select(*lu.AT, "carry", *_plus("lineup"), "out_unit", "in_unit", *_plus("other"), "other_boards")


@query("a14_board_patterns")
def board_patterns(b):
    """Patterns of each carry's line-ups, the shape that stands for the carry protected."""
    rows = lu.board_patterns(_carry_lineups(b), "carry")
    return rows.select(*lu.AT, "carry", "size", "pattern", *_plus("lineup"), F.coalesce(F.array_join("shell", "+"), F.lit("")).alias("shell"), F.coalesce("flex", F.lit("")).alias("flex"), "place", "boards")


def _comp_sums(b: Boards) -> DataFrame:
    boards = _lineups(b)
    promoted = lu.exact_lineups(boards, min_boards=FLOOR)
    return lu.pattern_sums(lu.board_patterns(promoted), lu.lineup_carries(boards, promoted))


@query("a15_comp_patterns")
def comp_patterns(b):
    return _comp_sums(b).select(*lu.AT, "size", "pattern", *_plus("anchor"), F.coalesce(F.array_join("shell", "+"), F.lit("")).alias("shell"), "members", "boards", F.coalesce("lead", F.lit("")).alias("lead"), "carries", "without_carry")


@query("t05_comp_filters")
def comp_filters(b):
    costs = b.units.groupBy("character_id").agg(F.max("cost").alias("cost"))
    rows = lu.comp_rows(_comp_sums(b), costs, level=7, lead_costs=[1, 2, 3], limit=20)
    return rows.select(*lu.AT, "place", *_plus("anchor"), "boards", F.coalesce("lead", F.lit("")).alias("lead"), "lead_cost")


@query("t04_lineup_order", f", {LINEUP_SQL} SELECT balance_window, level, lineup, boards, row_number() OVER (PARTITION BY balance_window, level ORDER BY boards DESC, string_split(lineup, '+')) AS place FROM promoted")
def lineup_order(b):
    rows = lu.exact_lineups(_lineups(b), min_boards=FLOOR)
    placed = spread_row_number(rows, lu.AT, [F.desc("boards"), F.col("lineup")], "place")
    return placed.select(*lu.AT, *_plus("lineup"), "boards", F.col("place").cast("long").alias("place"))


@query(
    "t08_preview_levels",
    f", {LINEUP_SQL}, busy AS (SELECT balance_window, level, count(*) AS n FROM boards GROUP BY balance_window, level QUALIFY row_number() OVER (PARTITION BY balance_window ORDER BY count(*) DESC, level) <= 2), "
    "top AS (SELECT balance_window, level, lineup, boards FROM promoted QUALIFY row_number() OVER (PARTITION BY balance_window, level ORDER BY boards DESC, string_split(lineup, '+')) = 1) SELECT t.*, n AS level_boards FROM top t JOIN busy USING (balance_window, level)",
)
def preview_levels(b):
    boards = _lineups(b)
    busy = ev.top_by(boards.groupBy(*lu.AT).agg(F.count(F.lit(1)).alias("level_boards")), ["balance_window"], [F.desc("level_boards"), "level"], 2).drop("place")
    top = ev.top_by(lu.exact_lineups(boards, min_boards=FLOOR).drop("level_boards"), lu.AT, [F.desc("boards"), "lineup"], 1)
    return top.join(busy, lu.AT).select(*lu.AT, *_plus("lineup"), "boards", "level_boards")


@query(
    "a11_distributions",
    ", v AS (SELECT balance_window, character_id, level AS value FROM carries), n AS (SELECT balance_window, character_id, value, count(*) AS boards FROM v GROUP BY ALL) SELECT balance_window, character_id, value, boards, round(boards / sum(boards) OVER (PARTITION BY balance_window, character_id), 6) AS share FROM n",
)
def distributions(b):
    return rounded(lu.distribution(_carries(b), ev.CARRY, F.col("level"), rules.valid_level(F.col("level"))))


@query(
    "u01_lineup_difference",
    f", {LINEUP_SQL}, split AS (SELECT *, string_split(lineup, '+') AS units FROM promoted), pairs AS (SELECT p.balance_window, p.level, p.lineup AS a, q.lineup AS b, {_DIFFS} FROM split p JOIN split q ON p.balance_window = q.balance_window AND p.level = q.level AND p.lineup <> q.lineup AND len(p.units) = len(q.units)) "
    f"SELECT balance_window, level, a, b, {_OUT.format(v=1)} AS difference FROM pairs WHERE {' + '.join(f'abs(d{i})' for i in range(6))} = 2",
)
def lineup_difference(b):
    rows = lu.one_slot_alternatives(lu.exact_lineups(_lineups(b), min_boards=FLOOR)).select(*lu.AT, F.col("lineup").alias("a"), F.col("other").alias("b"))
    return lu.lineup_difference(rows).select(*lu.AT, *_plus("a", "b", "difference"))


_NAMED_SQL = f""", {LINEUP_SQL}, dim AS (SELECT DISTINCT p_type AS id, 'Name ' || reverse(p_type) AS name, length(p_type) % 5 AS cost FROM part WHERE p_type <> 'PROMO'),
chosen AS (SELECT balance_window, level, lineup, string_split(lineup, '+') AS units FROM promoted), lead AS (SELECT *, units[1] AS lead FROM chosen),
copies AS (SELECT balance_window, level, lineup, lead, unit, count(*) AS n FROM (SELECT *, unnest(units) AS unit FROM lead) GROUP BY ALL),
ranked AS (SELECT *, coalesce(name, unit) AS text, row_number() OVER (PARTITION BY balance_window, level, lineup ORDER BY unit <> lead, -coalesce(cost, 0), lower(coalesce(name, unit)), unit) AS place FROM copies LEFT JOIN dim ON id = unit)
SELECT balance_window, level, lineup AS shown, string_agg(text || CASE WHEN n > 1 THEN ' ×' || n ELSE '' END, ' · ' ORDER BY place) FILTER (place <= 3) || CASE WHEN coalesce(sum(n) FILTER (place > 3), 0) > 0 THEN ' + ' || CAST(sum(n) FILTER (place > 3) AS BIGINT) ELSE '' END AS name FROM ranked GROUP BY ALL"""


@query("f12_comp_name", _NAMED_SQL)
def comp_name(b):
    kind = F.col("p_type")
    dim = b.read("part").where("p_type <> 'PROMO'").select(kind.alias("character_id"), F.concat(F.lit("Name "), F.reverse(kind)).alias("name"), (F.length(kind) % 5).alias("cost")).distinct()
    rows = lu.exact_lineups(_lineups(b), min_boards=FLOOR).select(*lu.AT, F.col("lineup").alias("units"), F.element_at("lineup", 1).alias("lead"))
    return lu.comp_name(rows, dim).select(*lu.AT, F.array_join("units", "+").alias("shown"), "name")


_DIRECTORY = ", " + CANONICAL_SQL + ", held AS (SELECT DISTINCT balance_window, character_id, match_id, participant_index, unnest(own_items) AS item FROM games)"


@query("a16_item_directory", _DIRECTORY + ", n AS (SELECT balance_window, item, character_id AS carry, count(*) AS boards FROM held GROUP BY ALL) SELECT *, CAST(sum(boards) OVER (PARTITION BY balance_window, item) AS BIGINT) AS item_boards FROM n QUALIFY row_number() OVER (PARTITION BY balance_window, item ORDER BY boards DESC, carry) <= 6")
def item_directory(b):
    held = ev.item_games(_carries(b), b.units, ITEM_SETS).select("balance_window", F.col("character_id").alias("carry"), F.explode(F.array_distinct("own_items")).alias("item"))
    n = held.groupBy("balance_window", "item", "carry").agg(F.count(F.lit(1)).alias("boards"))
    n = n.withColumn("item_boards", F.sum("boards").over(Window.partitionBy("balance_window", "item")))
    return ev.top_by(n, ["balance_window", "item"], [F.desc("boards"), "carry"], 6).drop("place")


@query("a17_trait_directory", "SELECT balance_window, trait_name, num_units, count(*) AS boards FROM traits JOIN matches USING (match_id) WHERE tier_current >= 1 GROUP BY ALL")
def trait_directory(b):
    return ev.active_traits(b.traits).join(b.windows, "match_id").groupBy("balance_window", "trait_name", "num_units").agg(F.count(F.lit(1)).alias("boards"))


@query("j15_trait_carries", "SELECT c.balance_window, t.trait_name, c.character_id, count(*) AS boards FROM traits t JOIN carries c USING (match_id, participant_index) WHERE t.tier_current >= 1 GROUP BY ALL")
def trait_carries(b):
    rows = ev.active_traits(b.traits).join(_carries(b), ev.BOARD)
    return rows.groupBy("balance_window", "trait_name", "character_id").agg(F.count(F.lit(1)).alias("boards"))


@query("a21_champion_directory", ", n AS (SELECT character_id, count(*) AS boards FROM carries GROUP BY ALL) SELECT p_brand AS character_id, min(1 + CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) % 5) AS cost, coalesce(max(boards), 0) AS boards FROM part LEFT JOIN n ON p_brand = character_id GROUP BY ALL")
def champion_directory(b):
    dim = b.read("part").select(F.col("p_brand").alias("character_id")).distinct().withColumn("cost", 1 + F.regexp_extract("character_id", "([0-9]+)", 1).cast("int") % 5)
    n = _carries(b).groupBy("character_id").agg(F.count(F.lit(1)).alias("boards"))
    return dim.join(n, "character_id", "left").select("character_id", "cost", F.coalesce("boards", F.lit(0)).alias("boards"))


@query("p02_completed_items", "SELECT match_id, participant_index, unit_index, completed_item_count FROM units")
def completed_items(b):
    return b.units.select(*ev.BOARD, "unit_index", "completed_item_count")


@query("p03_itemization", "SELECT match_id, participant_index, unit_index, CASE WHEN list_contains(items, 'T_8') THEN 'T_8' ELSE array_to_string(list_sort(list_filter(items, lambda x: x NOT IN ('D_0','D_1','D_2','T_0','T_1'))), '+') END AS equipped, CASE WHEN list_contains(items, 'T_8') THEN array_to_string(list_filter(items, lambda x: x <> 'T_8'), '+') ELSE '' END AS generated FROM units")
def itemization(b):
    items = F.col("items")
    return b.units.select(*ev.BOARD, "unit_index", F.array_join(rules.completed_list(items, ITEM_SETS), "+").alias("equipped"), F.array_join(rules.generated_items(items, ITEM_SETS), "+").alias("generated"))


@query("p04_item_intent", "SELECT item, count(*) AS n, CASE WHEN item IN ('R_A','D_8','D_9','D_10') THEN 'damage' WHEN item IN ('R_N','R_R','T_2','T_3','T_4','D_3','D_4') THEN 'tank' ELSE 'unknown' END AS intent FROM (SELECT unnest(items) AS item FROM units) GROUP BY ALL")
def item_intent(b):
    said = [(i, "damage") for i in ITEM_SETS.corroborating] + [(i, "tank") for i in ITEM_SETS.no_evidence]
    dim = b.spark.createDataFrame(said, "item string, intent string")
    rows = b.units.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(dim, "item", "left").select("item", "n", F.coalesce("intent", F.lit("unknown")).alias("intent"))


@query("p06_is_commitment", "SELECT balance_window, character_id, count(*) AS units, count(*) FILTER (committed) AS committed FROM units JOIN matches USING (match_id) GROUP BY ALL")
def commitment(b):
    return b.units.join(b.windows, "match_id").groupBy(*ev.CARRY).agg(F.count(F.lit(1)).alias("units"), F.count_if("committed").alias("committed"))


@query("p07_window_scope", "SELECT u.match_id, u.participant_index, u.unit_index, u.character_id FROM units u JOIN matches USING (match_id) WHERE balance_window = '1997'")
def window_scope(b):
    return b.units.join(b.windows.where("balance_window = '1997'"), "match_id", "left_semi").select(*ev.BOARD, "unit_index", "character_id")


@query("p09_valid_level", "SELECT level, level BETWEEN 1 AND 8 AS low, count(*) AS boards FROM participants GROUP BY ALL")
def levels(b):
    return b.participants.where(rules.valid_level(F.col("level"))).groupBy("level", F.col("level").between(1, 8).alias("low")).agg(F.count(F.lit(1)).alias("boards"))


@query("p13_active_trait", "SELECT match_id, participant_index, trait_name, num_units FROM traits WHERE tier_current >= 1")
def active_trait(b):
    return ev.active_traits(b.traits).select(*ev.BOARD, "trait_name", "num_units")


@query("p18_board_floor", "SELECT balance_window, character_id, count(*) AS boards FROM carries GROUP BY ALL HAVING count(*) >= 220")
def board_floor(b):
    return _carries(b).groupBy(*ev.CARRY).agg(F.count(F.lit(1)).alias("boards")).where("boards >= 220")


@query("p20_patch_order", "SELECT DISTINCT regexp_extract(game_version, '(\\d+)\\.(\\d+)', 0) AS patch, CAST(regexp_extract(game_version, '(\\d+)\\.(\\d+)', 1) AS INTEGER) AS major, CAST(regexp_extract(game_version, '(\\d+)\\.(\\d+)', 2) AS INTEGER) AS minor FROM matches")
def patch_order(b):
    patch = b.matches.select(rules.client_patch(F.col("game_version")).alias("patch")).distinct()
    key = rules.patch_order(F.col("patch"))
    return patch.select("patch", key["major"].alias("major"), key["minor"].alias("minor"))


@query("f01_client_patch", "SELECT match_id, regexp_extract(game_version, '(\\d+)\\.(\\d+)', 0) AS patch FROM matches")
def client_patch(b):
    return b.matches.select("match_id", rules.client_patch(F.col("game_version")).alias("patch"))


@query("f02_balance_window", ", c AS (SELECT match_id, balance_window, game_datetime, epoch_ms(make_timestamp(CAST(balance_window AS INTEGER), 4, 1, 0, 0, 0)) AS c1, epoch_ms(make_timestamp(CAST(balance_window AS INTEGER), 9, 1, 0, 0, 0)) AS c2 FROM matches) SELECT match_id, balance_window || chr(97 + CAST(game_datetime >= c1 AS INTEGER) + CAST(game_datetime >= c2 AS INTEGER)) AS labelled FROM c")
def balance_window(b):
    day = lambda m: F.datediff(F.make_date(F.col("balance_window").cast("int"), F.lit(m), F.lit(1)), F.lit("1970-01-01")).cast("long") * 86_400_000
    return b.matches.select("match_id", rules.window_suffix(F.col("balance_window"), F.col("game_datetime"), F.array(day(4), day(9))).alias("labelled"))


@query("f03_name_key", "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key FROM part")
def name_key(b):
    return b.read("part").select("p_partkey", rules.name_key(F.col("p_name")).alias("key"))


@query("f05_trait_count_key", "SELECT DISTINCT trait_name || ':' || CAST(num_units AS VARCHAR) AS key, trait_name AS trait, num_units AS n FROM traits")
def trait_count_key(b):
    keys = b.traits.select(rules.trait_count_key(F.col("trait_name"), F.col("num_units")).alias("key")).distinct()
    trait, n = rules.split_trait_count_key(F.col("key"))
    return keys.select("key", trait.alias("trait"), n.alias("n"))


@query("f09_evidence_band", "SELECT balance_window, character_id, count(*) AS boards, CASE WHEN count(*) >= 60 THEN 'A' WHEN count(*) >= 30 THEN 'B' WHEN count(*) >= 10 THEN 'C' ELSE 'D' END AS band FROM carries GROUP BY ALL")
def evidence_band(b):
    n = _carries(b).groupBy(*ev.CARRY).agg(F.count(F.lit(1)).alias("boards"))
    return n.withColumn("band", rules.evidence_band(F.col("boards")))


@query("j01_star_join", "SELECT balance_window, count(*) AS units, CAST(sum(tier) AS BIGINT) AS tiers FROM units JOIN matches USING (match_id) GROUP BY ALL")
def star_join(b):
    return b.units.join(b.windows, "match_id").groupBy("balance_window").agg(F.count(F.lit(1)).alias("units"), F.sum("tier").alias("tiers"))


@query("j02_unit_observable", "SELECT match_id, participant_index, placement FROM participants p WHERE EXISTS (SELECT 1 FROM units u WHERE u.match_id = p.match_id AND u.participant_index = p.participant_index)")
def unit_observable(b):
    return ev.observable_boards(b.participants, b.units).select(*ev.BOARD, "placement")


@query("j03_participants_without_units", "SELECT match_id, participant_index, placement FROM participants p WHERE NOT EXISTS (SELECT 1 FROM units u WHERE u.match_id = p.match_id AND u.participant_index = p.participant_index)")
def without_units(b):
    return ev.boards_without_units(b.participants, b.units).select(*ev.BOARD, "placement")


@query("j06_committed_boards", "SELECT g.character_id AS carry, g.match_id, g.participant_index, g.star, u.unit_index, u.character_id FROM (SELECT match_id, participant_index, character_id, max(tier) AS star FROM units WHERE committed GROUP BY ALL) g JOIN units u USING (match_id, participant_index) WHERE g.character_id = 'Brand#7'")
def committed_boards(b):
    best = b.units.where("committed and character_id = 'Brand#7'").groupBy(*ev.BOARD, F.col("character_id").alias("carry")).agg(F.max("tier").alias("star"))
    return best.join(b.units.select(*ev.BOARD, "unit_index", "character_id"), ev.BOARD)


@query("j07_window_boards", "SELECT p.match_id, p.participant_index, p.placement, coalesce(u.n, 0) AS units, coalesce(u.c, 0) AS committed FROM participants p LEFT JOIN (SELECT match_id, participant_index, count(*) AS n, count(*) FILTER (committed) AS c FROM units GROUP BY ALL) u USING (match_id, participant_index)")
def window_boards(b):
    n = b.units.groupBy(*ev.BOARD).agg(F.count(F.lit(1)).alias("units"), F.count_if("committed").alias("committed"))
    return b.participants.join(n, ev.BOARD, "left").select(*ev.BOARD, "placement", F.coalesce("units", F.lit(0)).alias("units"), F.coalesce("committed", F.lit(0)).alias("committed"))


@query("j08_classification_interval", ", w AS (SELECT CAST(y AS VARCHAR) AS label, epoch_ms(make_timestamp(y, 1, 15, 0, 0, 0)) AS starts_at, epoch_ms(make_timestamp(y, 11, 1, 0, 0, 0)) AS ends_at FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders)) SELECT match_id, game_datetime, coalesce(label, '') AS label FROM matches LEFT JOIN w ON game_datetime >= starts_at AND game_datetime < ends_at")
def classification_interval(b):
    from boardloom.operators.windows import classify

    day = lambda m, d: F.datediff(F.make_date(F.col("label").cast("int"), F.lit(m), F.lit(d)), F.lit("1970-01-01")).cast("long") * 86_400_000
    registry = b.matches.select(F.col("balance_window").alias("label")).distinct().withColumns({"starts_at": day(1, 15), "ends_at": day(11, 1)})
    return classify(b.matches, registry).select("match_id", "game_datetime", F.coalesce("label", F.lit("")).alias("label"))


@query("a38_outcome_summary", ", oc AS (SELECT balance_window, level, count(*) AS n, count(DISTINCT match_id) AS matches, avg(placement) AS mean, count(*) FILTER (placement <= 4) AS s, count(*) FILTER (placement = 1) AS w FROM participants JOIN matches USING (match_id) GROUP BY ALL), x AS (SELECT *, s / n AS p, 1.96 * 1.96 AS zz FROM oc) SELECT balance_window, level, n AS boards, matches, round(mean, 6) AS mean, round(p, 6) AS top4_rate, round(w / n, 6) AS win_rate, round(greatest(0, least(1, (p + zz / (2 * n)) / (1 + zz / n) - 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n))), 6) + 0.0 AS low, round(greatest(0, least(1, (p + zz / (2 * n)) / (1 + zz / n) + 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n))), 6) + 0.0 AS high FROM x")
def outcome_summary(b):
    rows = b.participants.join(b.windows, "match_id").groupBy("balance_window", "level").agg(F.count(F.lit(1)).alias("boards"), F.count_distinct("match_id").alias("matches"), F.avg("placement").alias("mean"), F.count_if(F.col("placement") <= 4).alias("s"), F.count_if(F.col("placement") == 1).alias("w"))
    low, high = rules.wilson(F.col("s"), F.col("boards"))
    return rounded(rows.select("balance_window", "level", "boards", "matches", "mean", (F.col("s") / F.col("boards")).alias("top4_rate"), (F.col("w") / F.col("boards")).alias("win_rate"), low.alias("low"), high.alias("high")))
