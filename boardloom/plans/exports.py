"""Registered queries: exports and their checks, ledgers, ideas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardloom.operators import exports as ex
from boardloom.operators import ideas as de
from boardloom.operators import quality as qu
from boardloom.plans.arrivals import _published
from boardloom.plans.carries import _carries
from boardloom.plans.dimensions import meta_query
from boardloom.plans.registry import query
from boardloom.sources.binding import BINDING_SQL, BOARD, Boards

# Ledgers: a run a year; even years broke off. A board's player discovers its match.
_LEDGER_SQL = "samples AS (SELECT o_custkey AS player, year(o_orderdate) AS run_id, epoch_ms(o_orderdate) AS sampled_at, CAST(o_orderkey // 8 AS VARCHAR) AS match_id FROM orders), runs AS (SELECT DISTINCT run_id, CASE WHEN run_id % 2 = 1 THEN 'completed' ELSE 'failed' END AS status FROM samples)"


def _samples(b: Boards) -> DataFrame:
    from boardloom.sources.binding import epoch_ms

    return b.read("orders").select(F.col("o_custkey").alias("player"), F.year("o_orderdate").alias("run_id"), epoch_ms(F.col("o_orderdate")).alias("sampled_at"), F.expr("o_orderkey div 8").cast("string").alias("match_id"))


def _runs(b: Boards) -> DataFrame:
    return _samples(b).select("run_id").distinct().withColumn("status", F.when(F.col("run_id") % 2 == 1, "completed").otherwise("failed"))


@query("j09_completed_runs", f"WITH {_LEDGER_SQL} SELECT player, max(sampled_at) AS last_sampled FROM samples JOIN runs USING (run_id) WHERE status = 'completed' GROUP BY player", raw=True)
def completed_runs(b):
    return ex.completed_samples(_samples(b), _runs(b))


_LOST = "(participant_index = 3 AND CAST(match_id AS BIGINT) % 5 = 0) OR (participant_index = 5 AND unit_index = 0)"


@query("j10_raw_vs_stored", f", raw AS (SELECT p.match_id, p.participant_index, count(u.match_id) AS raw_units FROM participants p LEFT JOIN units u ON u.match_id = p.match_id AND u.participant_index = p.participant_index GROUP BY ALL), stored AS (SELECT match_id, participant_index, count(*) AS stored_units FROM units WHERE NOT ({_LOST}) GROUP BY ALL) "
       "SELECT *, CASE WHEN raw_units = 0 AND stored_units = 0 THEN 'source_empty' WHEN stored_units = 0 THEN 'lost' WHEN raw_units <> stored_units THEN 'differs' ELSE 'same' END AS verdict FROM (SELECT r.match_id, r.participant_index, raw_units, coalesce(stored_units, 0) AS stored_units FROM raw r LEFT JOIN stored s ON s.match_id = r.match_id AND s.participant_index = r.participant_index)")
def raw_vs_stored(b):
    """The documents against a store that lost a board's units in some matches and one unit in others."""
    raw = _published(b).select("match_id", F.posexplode("boards").alias("participant_index", "p")).select(*BOARD, F.greatest(F.lit(0), F.coalesce(F.size("p.units"), F.lit(0))).cast("long").alias("units"))
    stored = b.units.where(f"not ({_LOST.replace('CAST(match_id AS BIGINT)', 'cast(match_id as bigint)')})").groupBy(*BOARD).agg(F.count(F.lit(1)).alias("units"))
    return qu.raw_versus_stored(raw, stored)


@query("j11_parents_and_children", ", kept AS (SELECT * FROM participants WHERE participant_index <> 6) SELECT DISTINCT match_id, participant_index, 'parent' AS missing FROM units u WHERE NOT EXISTS (SELECT 1 FROM kept p WHERE p.match_id = u.match_id AND p.participant_index = u.participant_index) UNION ALL SELECT match_id, participant_index, 'child' FROM kept p WHERE NOT EXISTS (SELECT 1 FROM units u WHERE u.match_id = p.match_id AND u.participant_index = p.participant_index)")
def parents_and_children(b):
    """Both directions: boards with index 6 are gone, their units stayed."""
    return qu.orphans(b.units, b.participants.where("participant_index <> 6"), BOARD)


_CHOSEN = ("1993", "1995")
_EXPORT_SQL = "ids AS (SELECT match_id AS source_id, 'S' || lpad(CAST(row_number() OVER (ORDER BY game_datetime, match_id) AS VARCHAR), 7, '0') AS opaque_id FROM matches WHERE balance_window IN ('1993', '1995'))"


def _chosen(b: Boards) -> DataFrame:
    return b.matches.where(F.col("balance_window").isin(*_CHOSEN))


@query("s15_opaque_ids", f", {_EXPORT_SQL} SELECT source_id AS match_id, opaque_id FROM ids")
def opaque_ids(b):
    return ex.opaque_ids(_chosen(b))


@query("s14_sanitized_export", f", {_EXPORT_SQL} SELECT opaque_id AS match_id, participant_index, placement, level, 'private' AS player, '[]' AS augments FROM participants JOIN ids ON match_id = source_id")
def sanitized_export(b):
    """Boards of the chosen windows under opaque ids, player and augments replaced by fixed values."""
    boards = b.participants.withColumns({"player": F.concat(F.lit("p"), "match_id"), "augments": F.lit("[1]")})
    out = qu.sanitized(boards, {"player": "private", "augments": "[]"})
    return ex.with_opaque_ids(out, ex.opaque_ids(_chosen(b)))


@query(
    "s16_export_failures",
    f", {_LEDGER_SQL}, linked AS (SELECT DISTINCT match_id FROM samples JOIN runs USING (run_id) WHERE status = 'completed'), "
    "docs AS (SELECT CASE WHEN CAST(match_id AS BIGINT) % 3 = 0 THEN match_id ELSE 'EUW1_' || match_id END AS id, match_id, queue_id, CAST(match_id AS BIGINT) AS k, game_version FROM matches), "
    "f AS (SELECT 'not linked to a completed run' AS reason FROM docs WHERE match_id NOT IN (SELECT match_id FROM linked) UNION ALL SELECT 'queue is not ranked' FROM docs WHERE queue_id <> 1100 UNION ALL SELECT 'id is not regional' FROM docs WHERE k % 3 = 0 UNION ALL SELECT 'patch is not numeric' FROM docs WHERE k % 11 = 0 "
    "UNION ALL SELECT 'payload is missing or unreadable' FROM docs WHERE k % 7 = 0 UNION ALL SELECT 'payload id differs' FROM docs WHERE k % 7 <> 0 AND k % 13 = 0 UNION ALL SELECT 'payload has no version' FROM docs WHERE k % 7 <> 0 AND k % 17 = 0 UNION ALL SELECT 'payload players differ from boards' FROM docs WHERE k % 7 <> 0 AND k % 5 = 0 UNION ALL SELECT 'payload queue is not ranked' FROM docs WHERE k % 7 <> 0 AND queue_id <> 1100) "
    "SELECT reason, count(*) AS matches FROM f GROUP BY reason",
)
def export_failures(b):
    """Documents with planted faults, by the match's number."""
    k = F.col("match_id").cast("long")
    regional = F.when(k % 3 == 0, F.col("match_id")).otherwise(F.concat(F.lit("EUW1_"), "match_id"))
    counts = b.participants.groupBy("match_id").agg(F.count(F.lit(1)).alias("n"))
    players = F.transform(F.sequence(F.lit(1), F.when(k % 5 == 0, F.col("n") - 1).otherwise(F.col("n")).cast("int")), lambda i: F.concat(F.lit("p"), i.cast("string")))
    meta = F.struct(F.when(k % 13 == 0, "X_1").otherwise(regional).alias("match_id"), F.when(k % 17 != 0, "6").alias("data_version"), players.alias("participants"))
    payload = F.when(k % 7 == 0, "not json").otherwise(F.to_json(F.struct(meta.alias("metadata"), F.struct("queue_id").alias("info"))))
    docs = b.matches.join(counts, "match_id").select(regional.alias("match_id"), "queue_id", F.when(k % 11 == 0, "demo").otherwise("14.6").alias("patch"), payload.alias("payload"))
    named = lambda df: df.withColumn("match_id", regional)
    return ex.export_failures(docs, named(b.participants), named(_samples(b)), _runs(b))


@query(
    "s17_export_verify",
    ", kept AS (SELECT * FROM participants WHERE CAST(match_id AS BIGINT) % 50 <> 0), m AS (SELECT * FROM matches WHERE CAST(match_id AS BIGINT) % 40 <> 0) SELECT 'boards without a match' AS \"check\", (SELECT count(DISTINCT match_id) FROM kept WHERE match_id NOT IN (SELECT match_id FROM m)) AS failures "
    "UNION ALL SELECT 'units without a board', (SELECT count(*) FROM (SELECT DISTINCT match_id, participant_index FROM units WHERE CAST(match_id AS BIGINT) % 50 = 0)) UNION ALL SELECT 'matches without boards', (SELECT count(*) FROM m WHERE match_id NOT IN (SELECT match_id FROM kept)) "
    "UNION ALL SELECT 'ids that are not opaque', (SELECT count(*) FROM m) UNION ALL SELECT 'windows not asked for', (SELECT count(*) FROM m WHERE balance_window <> '1993') UNION ALL SELECT 'levels out of range', (SELECT count(*) FROM kept WHERE level > 8)",
)
def export_verify(b):
    """An export that lost matches and boards, kept its source ids and took too many windows."""
    k = F.col("match_id").cast("long")
    return ex.verify_export(b.matches.where(k % 40 != 0), b.participants.where(k % 50 != 0), b.units, ["1993"], most_level=8)


@query(
    "s18_leak_scan",
    ", t AS (SELECT match_id, game_version || CASE WHEN CAST(match_id AS BIGINT) % 9 = 0 THEN ' key=RGAPI-1' ELSE '' END AS game_version, CASE WHEN CAST(match_id AS BIGINT) % 8 = 0 THEN repeat('a', 78) ELSE balance_window END AS balance_window FROM matches), v AS (SELECT 'match_id' AS col, match_id AS x FROM t UNION ALL SELECT 'game_version', game_version FROM t UNION ALL SELECT 'balance_window', balance_window FROM t) "
    "SELECT col AS \"column\", count(*) FILTER (contains(x, 'RGAPI-')) AS secrets, count(*) FILTER (len(x) = 78) AS players, count(*) FILTER (x IN (SELECT match_id FROM matches WHERE balance_window = '1994')) AS source_ids FROM v GROUP BY col",
)
def leak_scan(b):
    """Matches with a planted key, player ids and, for one window, their source ids."""
    k = F.col("match_id").cast("long")
    table = b.matches.select("match_id", F.concat("game_version", F.when(k % 9 == 0, " key=RGAPI-1").otherwise("")).alias("game_version"), F.when(k % 8 == 0, F.repeat(F.lit("a"), 78)).otherwise(F.col("balance_window")).alias("balance_window"))
    return qu.leak_counts(table, ["RGAPI-"], b.matches.where("balance_window = '1994'"))


#: crc32 over a table of 256 remainders, a byte at a time.
_FINGERPRINT_SQL = f"""WITH RECURSIVE {BINDING_SQL}, bits AS (SELECT b, b AS c, 0 AS k FROM range(256) t(b) UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
remainders AS (SELECT list(c ORDER BY b) AS r FROM bits WHERE k = 8),
ids AS (SELECT balance_window, match_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h), 2), lambda i: ('0x' || h[i:i + 1])::BIGINT)), lambda c, b: xor(c // 256, r[xor(c % 256, b) + 1]))) AS crc FROM (SELECT *, hex(encode(match_id)) AS h FROM matches), remainders),
dealt AS (SELECT *, crc % (max(n) OVER () // {qu.BUCKET_IDS} + 1) AS bucket FROM (SELECT *, count(*) OVER (PARTITION BY balance_window) AS n FROM ids)),
digests AS (SELECT balance_window, bucket, sha256(string_agg(match_id, chr(10) ORDER BY match_id)) AS d FROM dealt GROUP BY ALL)
SELECT balance_window, sha256(string_agg(d, chr(10) ORDER BY bucket)) AS fingerprint FROM digests GROUP BY balance_window"""


@query("s19_population_fingerprint", _FINGERPRINT_SQL, raw=True)
def population_fingerprint(b):
    """A digest of the digests of sorted ids, bucket by bucket: as many buckets by crc32 as the largest window needs at BUCKET_IDS ids each."""
    return qu.population_fingerprint(b.matches)


_IDEAS_SQL = """ideas AS (SELECT s_suppkey AS idea_id, s_suppkey % 25 + 1 AS n, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE (SELECT upper(name) FROM champions c WHERE c.n2 = s_suppkey % 25 + 1) END AS carry_name, CASE WHEN s_suppkey % 3 = 0 THEN 'Brand#' || (s_suppkey % 25 + 1) END AS carry_character_id,
  ['UNTESTED', 'TESTING', 'PROVEN', 'REJECTED'][s_suppkey % 4 + 1] AS status, ['draft', 'active', 'closed'][s_suppkey % 3 + 1] AS lifecycle, ['t' || (s_suppkey % 5), 'all'] AS tags, ['Brand#' || (s_suppkey % 25 + 1), 'Brand#' || ((s_suppkey + 3) % 25 + 1), 'Brand#' || ((s_suppkey + 7) % 25 + 1)] AS core,
  CASE WHEN s_suppkey % 2 = 0 THEN 'manual' ELSE 'import' END AS origin FROM supplier)"""


def _ideas(m) -> DataFrame:
    """Suppliers as ideas: a carry by name or id, three core units, a trait target."""
    k = F.col("s_suppkey")
    brand = lambda shift: F.concat(F.lit("Brand#"), ((k + shift) % 25 + 1).cast("string"))
    names = m.champions.select(F.col("character_id").alias("__id"), F.upper("name").alias("__name"))
    rows = m.read("supplier").withColumn("__id", brand(0)).join(names, "__id", "left")
    regions = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    target = F.struct(F.element_at(F.array(*map(F.lit, regions)), (k % 5 + 1).cast("int")).alias("name"), (k % 3).cast("int").alias("breakpoint"))
    return rows.select(
        k.alias("idea_id"),
        F.when(k % 3 != 0, F.col("__name")).alias("carry_name"),
        F.when(k % 3 == 0, F.col("__id")).alias("carry_character_id"),
        F.element_at(F.array(*map(F.lit, ["UNTESTED", "TESTING", "PROVEN", "REJECTED"])), (k % 4 + 1).cast("int")).alias("status"),
        F.element_at(F.array(*map(F.lit, ["draft", "active", "closed"])), (k % 3 + 1).cast("int")).alias("lifecycle"),
        F.array(F.concat(F.lit("t"), (k % 5).cast("string")), F.lit("all")).alias("tags"),
        F.array(brand(0), brand(3), brand(7)).alias("core_units"),
        F.array(target).alias("target_traits"),
        F.array(F.lit("TFT_Item_PROMO16"), F.lit("DA_LARGE31"), F.lit("TFT_Item_PROMO20")).alias("carry_items"),
        F.when(k % 2 == 0, "manual").otherwise("import").alias("origin"),
    )


_NUMBERED = "numbered AS (SELECT *, CAST(regexp_extract(character_id, '([0-9]+)', 1) AS INTEGER) AS n2 FROM champions)"
_IDEAS = f", {_NUMBERED}, {_IDEAS_SQL.replace('FROM champions c', 'FROM numbered c')}"
_REGIONS = "['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'][idea_id % 5 + 1]"


@meta_query("p21_idea_filters", f"{_IDEAS} SELECT idea_id FROM ideas WHERE status = 'PROVEN' AND lifecycle = 'active' AND list_contains(tags, 't3') AND (lower(carry_name) = lower((SELECT name FROM numbered WHERE n2 = 24)) OR lower(carry_character_id) = lower((SELECT name FROM numbered WHERE n2 = 24))) UNION ALL SELECT idea_id + 1000000 FROM ideas WHERE lower(carry_character_id) = 'brand#4'")
def idea_filters(m):
    """Two filters: all four conditions by the name of one champion, and an id in another case."""
    wanted = m.champions.where("character_id = 'Brand#24'").select("name").first()
    one = de.idea_filters(_ideas(m), status="proven", lifecycle="Active", carry=wanted["name"] if wanted else "nobody", tag="#T3")
    two = de.idea_filters(_ideas(m), carry="BRAND#4")
    return one.select("idea_id").unionByName(two.select((F.col("idea_id") + 1_000_000).alias("idea_id")))


@meta_query("s27_owner_notes", f"{_IDEAS} SELECT idea_id FROM ideas WHERE idea_id % 2 = 0")
def owner_notes(m):
    ideas = _ideas(m)
    _, notes = ex.owner_notes(ideas, ideas.select("idea_id", F.lit("seen").alias("note")))
    return notes.select("idea_id")


@query("s27_provenance", "SELECT (SELECT count(*) FROM matches) AS matches, (SELECT string_agg(w, ',' ORDER BY w) FROM (SELECT DISTINCT balance_window AS w FROM matches)) AS windows, (SELECT count(*) FROM participants) AS boards, 'preserved' AS participant_level")
def provenance(b):
    return ex.provenance(b.matches, b.participants, levels_kept=True)


@query("p23_level_capability", "SELECT match_id, participant_index, level, 'kept' AS source FROM participants")
def level_capability(b):
    """Levels of a source that keeps them, and none of one that does not."""
    rows = None
    for name, kept in (("kept", True), ("lost", False)):
        own = ex.level_rows(b.participants, ex.provenance(b.matches, b.participants, kept)).select(*BOARD, "level", F.lit(name).alias("source"))
        rows = own if rows is None else rows.unionByName(own)
    return rows


_KEY = "regexp_replace(lower(strip_accents({})), '[^a-z0-9]', '', 'g')"


@meta_query("f14_idea_signatures", f"{_IDEAS} SELECT idea_id, 'carry=' || {_KEY.format('coalesce(carry_name, carry_character_id)')} || ';core=' || array_to_string(list_sort(list_transform(core, lambda x: {_KEY.format('x')})), ',') || ';traits=' || {_KEY.format(_REGIONS)} || CASE WHEN idea_id % 3 > 0 THEN '@' || (idea_id % 3) ELSE '' END || ';items=large,promo' AS signature FROM ideas")
def idea_signatures(m):
    return de.signatures(_ideas(m))


_IDEA_CARRY = f"{_IDEAS}, meant AS (SELECT i.idea_id, c.character_id FROM ideas i JOIN numbered c ON {_KEY.format('coalesce(i.carry_character_id, i.carry_name)')} IN ({_KEY.format('c.name')}, {_KEY.format('c.character_id')})), idea_boards AS (SELECT balance_window, character_id, count(*) AS boards FROM carries GROUP BY ALL), picked AS (SELECT idea_id, balance_window, character_id, boards FROM meant JOIN idea_boards USING (character_id) QUALIFY row_number() OVER (PARTITION BY idea_id, balance_window ORDER BY boards DESC, character_id) = 1)"


@meta_query("j14_idea_carries", f"{_IDEA_CARRY} SELECT * FROM picked", boards=True)
def idea_carries(m, b):
    return de.idea_carries(_ideas(m), m.champions, _carries(b)).select("idea_id", "balance_window", "character_id", "boards")


@meta_query(
    "a32_idea_evidence",
    f"""{_IDEA_CARRY}, idea_games AS (SELECT p.idea_id, p.balance_window, p.character_id, c.match_id, c.participant_index, c.placement FROM picked p JOIN carries c ON c.balance_window = p.balance_window AND c.character_id = p.character_id),
pieces AS (SELECT p.idea_id, p.balance_window, u.name FROM picked p JOIN (SELECT idea_id, unnest(core) AS name FROM ideas) u USING (idea_id) WHERE u.name <> p.character_id), wanted AS (SELECT idea_id, balance_window, count(*) AS wanted FROM pieces GROUP BY ALL),
held AS (SELECT DISTINCT g.idea_id, g.balance_window, g.match_id, g.participant_index, g.placement, s.name FROM idea_games g JOIN pieces s ON s.idea_id = g.idea_id AND s.balance_window = g.balance_window JOIN units u ON u.match_id = g.match_id AND u.participant_index = g.participant_index AND u.character_id = s.name),
whole AS (SELECT h.idea_id, h.balance_window, match_id, participant_index, placement FROM held h JOIN wanted w ON w.idea_id = h.idea_id AND w.balance_window = h.balance_window WHERE wanted > 1 GROUP BY ALL HAVING count(*) = any_value(wanted)),
reached AS (SELECT g.* FROM idea_games g JOIN traits t ON t.match_id = g.match_id AND t.participant_index = g.participant_index WHERE t.tier_current >= 1 AND t.trait_name = ['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'][g.idea_id % 5 + 1] AND t.num_units >= g.idea_id % 3),
found AS (SELECT idea_id, balance_window, 'unit:' || name AS piece, count(*) AS boards, count(*) FILTER (placement <= 4) AS top4 FROM held GROUP BY ALL UNION ALL SELECT idea_id, balance_window, 'together', count(*), count(*) FILTER (placement <= 4) FROM whole GROUP BY ALL UNION ALL SELECT idea_id, balance_window, 'trait:' || ['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'][idea_id % 5 + 1] || '@' || (idea_id % 3), count(*), count(*) FILTER (placement <= 4) FROM reached GROUP BY ALL),
listed AS (SELECT idea_id, balance_window, 'unit:' || name AS piece FROM pieces UNION SELECT idea_id, balance_window, 'together' FROM wanted WHERE wanted > 1 UNION SELECT idea_id, balance_window, 'trait:' || ['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'][idea_id % 5 + 1] || '@' || (idea_id % 3) FROM picked)
SELECT l.idea_id, l.balance_window, l.piece, coalesce(boards, 0) AS boards, coalesce(top4, 0) AS top4 FROM listed l LEFT JOIN found f ON f.idea_id = l.idea_id AND f.balance_window = l.balance_window AND f.piece = l.piece""",
    boards=True,
)
def idea_evidence(m, b):
    return de.idea_evidence(_ideas(m), m.champions, _carries(b), b.units, b.traits)
