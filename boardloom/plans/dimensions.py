"""Registered queries: set metadata to dimensions, and ids to names."""

from __future__ import annotations

from pyspark.sql import functions as F

from boardloom.functions import rules
from boardloom.operators import dimensions as dm
from boardloom.operators import evidence as ev
from boardloom.plans.carries import STATS_SQL, _carries, _stats
from boardloom.plans.registry import CARRY_SQL, ORACLES, QUERIES, query
from boardloom.sources.binding import BINDING_SQL, Boards
from boardloom.sources.metadata import METADATA_SQL, Metadata

OWN, SHARED = "startswith(item_id, 'DA_')", "startswith(item_id, 'TFT_Item_')"
PREFIXES = ("DA_", "TFT14_", "TFT_Item_")


def meta_query(name: str, sql: str, *, boards: bool = False):
    """Register ``f(metadata)`` or, with ``boards``, ``f(metadata, boards)``."""

    def register(f):
        QUERIES[name] = (lambda spark, sf_dir: f(Metadata(spark, sf_dir), Boards(spark, sf_dir))) if boards else (lambda spark, sf_dir: f(Metadata(spark, sf_dir)))
        ORACLES[name] = f"WITH {METADATA_SQL}{', ' + BINDING_SQL + ', ' + CARRY_SQL if boards else ''} {sql}"
        return f

    return register


def _joined(*names: str) -> list:
    return [F.coalesce(F.array_join(n, "+"), F.lit("")).alias(n) for n in names]


def _links(m: Metadata):
    return dm.champion_traits(m.champions, m.traits)


@meta_query("s06_roster_dims", "SELECT character_id, trait_name, coalesce(trait_id, '') AS trait_id FROM champion_links")
def roster_dims(m):
    return _links(m).select("character_id", "trait_name", F.coalesce("trait_id", F.lit("")).alias("trait_id"))


@meta_query("s07_item_dims", "SELECT item_id, name, item_id IN (SELECT item_id FROM components) AS component, CASE WHEN len(composition) = 2 THEN array_to_string(composition, '+') ELSE '' END AS recipe FROM items")
def item_dims(m):
    return dm.item_dimension(m.items).select("item_id", "name", "component", *_joined("recipe"))


@meta_query(
    "s08_item_aliases",
    ", one AS (SELECT item_id, array_to_string(list_sort(list(DISTINCT other)), '+') AS alias_of, any_value(effects) AS e, any_value(tags) AS t FROM bridge GROUP BY item_id HAVING count(DISTINCT effects || tags) = 1) "
    "SELECT item_id, coalesce(alias_of, '') AS alias_of, array_to_string(list_sort(list_distinct(i.effects || coalesce(e, []))), '+') AS effects, array_to_string(list_sort(list_distinct(i.tags || coalesce(t, []))), '+') AS tags FROM items i LEFT JOIN one USING (item_id) WHERE item_id LIKE 'DA!_%' ESCAPE '!'",
)
def item_aliases(m):
    return dm.item_aliases(m.items, OWN, SHARED).select("item_id", *_joined("alias_of", "effects", "tags"))


@meta_query("s09_item_intents", "SELECT item_id, array_to_string(riot_items, '+') AS riot_items, array_to_string(tank_roles, '+') AS tank_roles, array_to_string(other_roles, '+') AS other_roles, in_domain, intent FROM intents")
def item_intents(m):
    return dm.item_intents(m.items, OWN, SHARED, m.roles, m.item_tags).select("item_id", *_joined("riot_items", "tank_roles", "other_roles"), "in_domain", "intent")


@meta_query("s10_trait_items", "SELECT trait_id, item_id FROM item_links")
def trait_items(m):
    return dm.trait_items(m.items, m.traits)


@meta_query("s10_unresolved_emblems", "SELECT item_id, name FROM lost")
def unresolved_emblems(m):
    return dm.unresolved_emblems(m.items, dm.trait_items(m.items, m.traits), PREFIXES)


@meta_query(
    "s11_trait_breakpoints",
    ", lagged AS (SELECT *, lag(low) OVER (PARTITION BY trait_id ORDER BY pos) AS before FROM effects), faults AS (SELECT *, CASE WHEN low IS NULL OR low < 1 THEN 'an effect has no integer minimum' WHEN high IS NULL OR high < low THEN 'an effect has no valid maximum' WHEN low <= before THEN 'minima do not strictly increase' END AS why FROM lagged) "
    "SELECT trait_id, CASE WHEN count(why) = 0 THEN string_agg(CAST(low AS VARCHAR), '+' ORDER BY pos) ELSE '' END AS breakpoints, coalesce(min_by(why, (CASE WHEN why LIKE 'minima%' THEN 1000 ELSE 0 END) + pos) FILTER (why IS NOT NULL), '') AS rejected FROM faults GROUP BY trait_id",
)
def breakpoints(m):
    rows = dm.trait_breakpoints(m.effects)
    return rows.select("trait_id", F.coalesce(F.array_join(F.transform("breakpoints", lambda x: x.cast("string")), "+"), F.lit("")).alias("breakpoints"), F.coalesce("rejected", F.lit("")).alias("rejected"))


@meta_query("s12_role_coverage", "SELECT count(*) AS shop_champions, count(*) FILTER (role <> '') AS with_role, count(*) FILTER (r.character_id IS NULL) AS missing_record FROM shop LEFT JOIN records r USING (character_id)")
def role_coverage(m):
    return dm.role_coverage(m.champions, m.records)


@meta_query("p05_intent_sets", "SELECT 'no_evidence' AS kind, item_id FROM intents WHERE intent IN ('tank', 'known_unlisted') UNION ALL SELECT 'adaptive', item_id FROM intents WHERE item_id = 'TFT_Item_PROMO16' OR list_contains(riot_items, 'TFT_Item_PROMO16') UNION ALL SELECT 'corroborating', item_id FROM intents WHERE item_id <> 'TFT_Item_PROMO16' AND NOT list_contains(riot_items, 'TFT_Item_PROMO16') AND intent IN ('damage', 'mixed')")
def intent_sets(m):
    return dm.intent_sets(dm.item_intents(m.items, OWN, SHARED, m.roles, m.item_tags), "TFT_Item_PROMO16")


@meta_query("p10_shop_champions", "SELECT character_id, cost BETWEEN 1 AND 5 AND len(traits) > 0 AS shop FROM champions")
def shop_champions(m):
    return m.champions.select("character_id", dm.is_shop_champion(F.col("cost"), F.col("traits")).alias("shop"))


@meta_query(
    "p11_shop_identity",
    ", raw AS (SELECT character_id AS unit_id FROM champions UNION SELECT name FROM champions UNION SELECT 'TFT14_' || upper(replace(name, '''', '')) || '_AD' FROM champions), "
    "keyed AS (SELECT unit_id, regexp_replace(lower(strip_accents(CASE WHEN unit_id LIKE 'TFT14!_%' ESCAPE '!' THEN replace(replace(unit_id, 'TFT14_', ''), '_AD', '') ELSE regexp_replace(unit_id, '[0-9]+$', '') END)), '[^a-z0-9]', '', 'g') AS key FROM raw), "
    "keys AS (SELECT DISTINCT character_id, regexp_replace(lower(strip_accents(name)), '[^a-z0-9]', '', 'g') AS key FROM shop UNION SELECT character_id, 'brand' FROM shop), once AS (SELECT key, min(character_id) AS character_id FROM keys GROUP BY key HAVING count(DISTINCT character_id) = 1) "
    "SELECT unit_id, coalesce(s.character_id, o.character_id, '') AS character_id FROM keyed k LEFT JOIN shop s ON s.character_id = unit_id LEFT JOIN once o ON o.key = k.key",
)
def shop_identity(m):
    c = m.champions
    raw = c.select(F.col("character_id").alias("unit_id")).union(c.select("name")).union(c.select(F.concat(F.lit("TFT14_"), F.upper(F.translate("name", "'", "")), F.lit("_AD"))))
    return dm.shop_identity(raw, c).select("unit_id", F.coalesce("character_id", F.lit("")).alias("character_id"))


@meta_query("p12_identity_units", "SELECT u.match_id, u.participant_index, u.unit_index, coalesce(c.cost BETWEEN 1 AND 5 AND len(c.traits) > 0, u.cost BETWEEN 1 AND 5) AS identity FROM units u LEFT JOIN (SELECT * FROM champions WHERE cost <> 7) c ON c.character_id = u.character_id", boards=True)
def identity_units(m, b):
    return dm.identity_units(b.units, m.champions.where("cost <> 7")).select(*ev.BOARD, "unit_index", "identity")


@meta_query("p15_singleton_traits", "SELECT character_id, trait_id FROM singles")
def singleton_traits(m):
    return dm.singleton_provider_traits(m.champions, _links(m))


@meta_query("p16_intrinsic_traits", "SELECT character_id, trait_id FROM singles WHERE trait_id NOT IN (SELECT trait_id FROM item_links)")
def intrinsic_traits(m):
    """Over the items without emblem-like names that no trait claims; with them nothing is intrinsic."""
    items = m.items.where(~F.col("name").contains("Emblem") | F.col("name").startswith("Clan"))
    items = items.where("name <> 'Clan 6 Emblem'")
    links = dm.trait_items(items, m.traits)
    return dm.intrinsic_traits(dm.singleton_provider_traits(m.champions, _links(m)), links, dm.unresolved_emblems(items, links, PREFIXES))


_BASELINE = "own AS (SELECT DISTINCT character_id, trait_name FROM carries JOIN traits USING (match_id, participant_index) WHERE tier_current >= 1 AND (len(trait_name) + CAST(regexp_extract(character_id, '([0-9]+)', 1) AS INTEGER)) % 3 = 0)"


@query("p14_baseline_traits", f", {_BASELINE}, held AS (SELECT match_id, participant_index, trait_name, num_units, 1 + num_units % 2 AS shown FROM traits WHERE tier_current >= 1) SELECT c.balance_window, c.character_id, c.match_id, c.participant_index, h.trait_name, h.shown AS num_units FROM carries c JOIN held h USING (match_id, participant_index) LEFT JOIN own o ON o.character_id = c.character_id AND o.trait_name = h.trait_name WHERE o.trait_name IS NULL OR h.shown > 1")
def baseline_traits(b):
    """A carry's own traits at one unit go, those above stay; bound counts start at two, so they are folded to one and two."""
    carries, own = _carries(b), F.length("trait_name") + F.regexp_extract("character_id", "([0-9]+)", 1).cast("int")
    shown = b.traits.withColumn("num_units", 1 + F.col("num_units") % 2)
    baseline = ev.active_traits(shown).join(carries, ev.BOARD).where(own % 3 == 0).select("character_id", "trait_name").distinct()
    return ev.carry_traits(carries, shown, baseline).where("trait_name is not null").select(*ev.CARRY, *ev.BOARD, "trait_name", "num_units")


@meta_query("p01_unit_cost", "SELECT u.match_id, u.participant_index, u.unit_index, coalesce(c.cost, CASE WHEN tier + participant_index - 2 BETWEEN 0 AND 4 THEN tier + participant_index - 1 END, -1) AS cost FROM units u LEFT JOIN (SELECT * FROM champions WHERE cost <= 3) c ON c.character_id = u.character_id", boards=True)
def unit_cost(m, b):
    known = m.champions.where("cost <= 3").select("character_id", F.col("cost").alias("known"))
    rows = b.units.drop("cost").join(known, "character_id", "left")
    cost = rules.unit_cost(F.col("known"), F.col("tier") + F.col("participant_index") - 2)
    return rows.select(*ev.BOARD, "unit_index", F.coalesce(cost, F.lit(-1)).alias("cost"))


@meta_query("u04_unknown_ids", "SELECT DISTINCT character_id FROM units WHERE character_id NOT IN (SELECT character_id FROM champions WHERE cost <= 4)", boards=True)
def unknown_ids(m, b):
    from boardloom.operators.quality import unknown_ids as unknown

    return unknown(b.units, m.champions.where("cost <= 4"), "character_id")


_SLUGS = "slugged AS (SELECT *, regexp_replace(lower(strip_accents(name)), '[^a-z0-9]', '', 'g') AS raw FROM champions), paged AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY raw ORDER BY cost, character_id) = 1 THEN raw ELSE regexp_replace(lower(character_id), '[^a-z0-9]', '', 'g') END AS slug FROM slugged)"


@meta_query("j16_champion_directory", f", {_SLUGS} SELECT p.character_id, name, p.cost, slug, coalesce(n, 0) AS carry_games FROM paged p LEFT JOIN (SELECT character_id, count(*) AS n FROM carries GROUP BY ALL) USING (character_id)", boards=True)
def champion_directory(m, b):
    n = _carries(b).groupBy("character_id").agg(F.count(F.lit(1)).alias("n"))
    return dm.slugs(m.champions).join(n, "character_id", "left").select("character_id", "name", "cost", "slug", F.coalesce("n", F.lit(0)).alias("carry_games"))


@meta_query("j16_find_champion", f", {_SLUGS}, asked AS (SELECT upper(name) AS key FROM champions UNION SELECT character_id FROM champions UNION SELECT 'nobody'), named AS (SELECT wanted, min(character_id) AS character_id FROM (SELECT character_id, slug AS wanted FROM paged UNION SELECT character_id, raw FROM paged) GROUP BY wanted) "
            "SELECT key, coalesce(p.character_id, n.character_id, '') AS character_id FROM asked LEFT JOIN paged p ON p.character_id = key LEFT JOIN named n ON n.wanted = regexp_replace(lower(strip_accents(key)), '[^a-z0-9]', '', 'g')")
def find_champion(m):
    keys = m.champions.select(F.upper("name").alias("key")).union(m.champions.select("character_id")).union(m.champions.select(F.lit("nobody")).limit(1))
    return dm.find_champion(dm.slugs(m.champions), keys).select("key", F.coalesce("character_id", F.lit("")).alias("character_id"))


@meta_query("f08_package_labels", "SELECT array_to_string(composition, '+') || '+X' AS key, string_agg(name, ' + ' ORDER BY pos) AS label, string_agg(kind, '+' ORDER BY pos) AS kinds FROM (SELECT DISTINCT q.composition, pos, coalesce(p.name, member) AS name, coalesce(p.tags[1], '') AS kind FROM (SELECT DISTINCT composition, unnest(composition || ['X']) AS member, unnest(range(1, len(composition) + 2)) AS pos FROM items WHERE len(composition) = 2) q LEFT JOIN items p ON p.item_id = member) GROUP BY composition")
def package_labels(m):
    keys = m.items.where(F.size("composition") == 2).select(F.concat(F.array_join("composition", "+"), F.lit("+X")).alias("key")).distinct()
    dim = m.items.select("item_id", "name", F.element_at("tags", 1).alias("kind"))
    rows = dm.with_names(keys, dim, key="key", id_col="item_id", extra=["kind"])
    return rows.select("key", "label", F.array_join(F.transform("kinds", lambda k: F.coalesce(k, F.lit(""))), "+").alias("kinds"))


@meta_query("j17_enriched_names", "SELECT c.balance_window, c.character_id, ch.name, t.trait_name, coalesce(st.name, t.trait_name) AS trait_label, count(*) AS boards FROM carries c JOIN traits t USING (match_id, participant_index) JOIN champions ch ON ch.character_id = c.character_id LEFT JOIN set_traits st ON st.trait_id = t.trait_name GROUP BY ALL", boards=True)
def enriched_names(m, b):
    rows = _carries(b).join(b.traits, ev.BOARD).groupBy(*ev.CARRY, "trait_name").agg(F.count(F.lit(1)).alias("boards"))
    named = dm.with_names(rows, m.champions, key="character_id", id_col="character_id").withColumnRenamed("label", "name")
    out = dm.with_names(named, m.traits, key="trait_name", id_col="trait_id")
    return out.select(*ev.CARRY, "name", "trait_name", F.col("label").alias("trait_label"), "boards")


@meta_query("x01_label_and_cost", "SELECT c.balance_window, c.character_id, u.character_id AS key, coalesce(ch.name, u.character_id) AS label, ch.cost, count(*) AS games FROM carries c JOIN (SELECT DISTINCT match_id, participant_index, character_id FROM units) u ON c.match_id = u.match_id AND c.participant_index = u.participant_index AND c.character_id <> u.character_id LEFT JOIN champions ch ON ch.character_id = u.character_id GROUP BY ALL", boards=True)
def label_and_cost(m, b):
    rows = ev.carry_partners(_carries(b), b.units).where("key is not null").groupBy(*ev.CARRY, "key").agg(F.count(F.lit(1)).alias("games"))
    return dm.with_names(rows, m.champions, key="key", id_col="character_id", extra=["cost"]).select(*ev.CARRY, "key", "label", F.element_at("costs", 1).alias("cost"), "games")


@meta_query("f06_item_kinds", ", named AS (SELECT item_id, CASE size % 6 WHEN 0 THEN item_id || '_Artifact' WHEN 1 THEN item_id || 'Radiant' WHEN 2 THEN 'Emblem' || item_id ELSE item_id END AS shown FROM items) SELECT shown AS item, CASE WHEN shown LIKE '%!_Artifact' ESCAPE '!' THEN 'artifact' WHEN shown LIKE '%Radiant' THEN 'radiant' WHEN shown LIKE '%Emblem%' THEN 'emblem' WHEN item_id IN (SELECT item_id FROM components) THEN 'component' WHEN item_id LIKE '%PROMO%' THEN 'unknown' ELSE 'standard' END AS kind FROM named")
def item_kinds(m):
    dim = dm.item_dimension(m.items).join(m.items.select("item_id", "size"), "item_id")
    k, i = F.col("size") % 6, F.col("item_id")
    shown = F.when(k == 0, F.concat(i, F.lit("_Artifact"))).when(k == 1, F.concat(i, F.lit("Radiant"))).when(k == 2, F.concat(F.lit("Emblem"), i)).otherwise(i)
    return dim.select(shown.alias("item"), rules.item_kind(shown, F.col("component"), ~i.contains("PROMO")).alias("kind"))


@meta_query("f07_readable_ids", "SELECT item_id, CASE WHEN item_id LIKE 'TFT!_Item!_%' ESCAPE '!' THEN replace(item_id, 'TFT_Item_', '') ELSE replace(item_id, 'DA_', '') END || ' of the Edge' AS shown FROM items")
def readable_ids(m):
    return m.items.select("item_id", rules.readable_id(F.concat("item_id", F.lit("OfTheEdgeRadiant"))).alias("shown"))


@meta_query("f04_id_keys", "SELECT item_id, regexp_replace(regexp_replace(regexp_replace(lower(item_id), '^tft_item_|^da_', ''), '[0-9]+$', ''), '[^a-z0-9]', '', 'g') AS key FROM items")
def id_keys(m):
    return m.items.select("item_id", rules.id_key(F.concat("item_id", F.lit("_AP"))).alias("key"))


@meta_query(
    "t01_recurrence_by_name",
    STATS_SQL.format(low=1, high=5, least=10)
    + "SELECT s.balance_window, character_id, s.cost, commitment_games, row_number() OVER (PARTITION BY s.balance_window ORDER BY commitment_games DESC, coalesce(name, character_id), character_id, s.cost) AS place, "
    "row_number() OVER (PARTITION BY s.balance_window ORDER BY commitment_games, coalesce(name, character_id), character_id, s.cost) AS place_from_fewest FROM stats s LEFT JOIN champions USING (character_id)",
    boards=True,
)
def recurrence_by_name(m, b):
    """Carries in both orders of recurrence; equal counts go by name."""
    stats = _stats(b, max_cost=5, min_samples=10).select(*ev.CARRY, "cost", "commitment_games")
    most, fewest = (ev.recurrence_order(stats, up, m.champions) for up in (False, True))
    both = most.join(fewest.withColumnRenamed("place", "place_from_fewest"), stats.columns)
    return both.withColumns({c: F.col(c).cast("long") for c in ("place", "place_from_fewest")})
