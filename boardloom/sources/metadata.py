"""Set metadata as seen through the generic tables: brands as champions, part types and sizes as items.

Like the binding of boards, this only gives operators inputs that exercise their rules: names that
clash, recipes that disagree, lists that are out of order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXTS = "array<string>"


def _texts(*parts: tuple[Column, Column]) -> Column:
    """The values whose condition holds, as an array."""
    return F.filter(F.array(*[F.when(when, value) for when, value in parts]), lambda x: x.isNotNull())


def _letters(n: Column) -> Column:
    return F.translate(n.cast("string"), "0123456789", "abcdefghij")


@dataclass(frozen=True)
class Metadata:
    spark: SparkSession
    sf_dir: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def _brands(self) -> DataFrame:
        return self.read("part").select(F.col("p_brand").alias("character_id")).distinct().withColumn("n", F.regexp_extract("character_id", "([0-9]+)", 1).cast("int"))

    @cached_property
    def champions(self) -> DataFrame:
        n = F.col("n")
        traits = _texts((F.lit(True), F.concat(F.lit("Clan "), n % 6)), (n % 4 == 0, F.concat(F.lit("Solo "), n)), (n % 9 == 0, F.lit("Twin")))
        traits = F.when(n == 25, F.array().cast(TEXTS)).otherwise(traits)
        return self._brands.select("character_id", F.concat(F.lit("Brä'"), F.when(n % 10 == 5, F.lit("same")).otherwise(_letters(n))).alias("name"), (1 + n % 7).alias("cost"), traits.alias("traits"))

    @cached_property
    def traits(self) -> DataFrame:
        named = self.champions.select(F.explode("traits").alias("name")).distinct().where("name <> 'Twin'")
        twins = self._brands.where("n in (11, 12)").select(F.concat(F.lit("T_Twin"), "n").alias("trait_id"), F.lit("Twin").alias("name"))
        return named.select(F.concat(F.lit("T_"), F.translate("name", " ", "")).alias("trait_id"), "name").unionByName(twins)

    @cached_property
    def items(self) -> DataFrame:
        k, kind = F.col("p_size"), F.col("p_type")
        part = lambda i: F.concat(F.lit("TFT_Item_"), kind, i)
        recipe = F.when((k <= 4) | ((k > 25) & (k % 5 == 0)), F.array().cast(TEXTS)).when(k <= 25, F.array(part(1 + k % 4), part(1 + k % 3))).otherwise(F.array(part(1 + k % 4), part(1 + F.floor(k / 2).cast("int") % 3)))
        name = F.when(k <= 4, F.concat(kind, F.lit(" part "), k)).when(k % 10 == 7, F.concat(F.lit("Clan "), k % 7, F.lit(" Emblem"))).when(k % 10 == 9, F.concat(kind, F.lit(" Emblem"))).otherwise(F.concat(kind, F.lit(" "), k % 8))
        rows = self.read("part").select("p_type", "p_size").distinct()
        return rows.select(
            F.concat(F.when(k <= 25, F.lit("TFT_Item_")).otherwise(F.lit("DA_")), kind, k).alias("item_id"),
            name.alias("name"),
            recipe.alias("composition"),
            F.array(F.concat(F.lit("E"), k % 2)).alias("effects"),
            F.array(F.concat(F.lit("G"), k % 3)).alias("tags"),
            _texts((k % 11 == 0, F.concat(F.lit("T_Clan"), k % 6)), (k % 13 == 0, F.concat(F.lit("Clan "), k % 5))).alias("associated"),
            k.alias("size"),
        )

    @cached_property
    def effects(self) -> DataFrame:
        region, pos = F.col("n_regionkey"), F.floor(F.col("n_nationkey") / 5).cast("int")
        low = F.when((region == 3) & (pos == 2), None).when((region == 2) & (pos == 3), 4).otherwise(2 * pos + 1)
        return self.read("nation").select(F.concat(F.lit("T_"), region).alias("trait_id"), pos.alias("pos"), low.alias("low"), F.when((region == 4) & (pos == 1), 0).otherwise(99).alias("high"))

    @cached_property
    def roles(self) -> DataFrame:
        rec = self.items.where("size between 5 and 22 and size % 5 <> 0 and size % 10 not in (3, 4)")
        k8, k4 = F.col("size") % 8, F.col("size") % 4
        eight = rec.select(F.concat(F.lit("Role"), k8).alias("role"), F.element_at(F.array(F.lit("tank"), F.lit("fighter"), F.lit(None)), k8 % 3 + 1).alias("family"), "item_id")
        four = rec.where("size > 12").select(F.concat(F.lit("Duo"), k4).alias("role"), F.element_at(F.array(F.lit("tank"), F.lit("caster")), k4 % 2 + 1).alias("family"), "item_id")
        return eight.unionByName(four).groupBy("role", "family").agg(F.collect_list("item_id").alias("items"))

    @cached_property
    def item_tags(self) -> DataFrame:
        k = F.col("size")
        return self.items.select("item_id", _texts((k % 10 != 3, F.lit("ordinary")), (F.lit(True), F.concat(F.lit("x"), k % 3)), (k % 10 == 4, F.lit("TraitItem"))).alias("tags"))

    @cached_property
    def records(self) -> DataFrame:
        n = F.col("n")
        return self._brands.where("n % 5 <> 0").select("character_id", F.when(n % 3 == 0, "").otherwise("Role1").alias("role"))


METADATA_SQL = """
brands AS (SELECT DISTINCT p_brand AS character_id, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS n FROM part),
champions AS (SELECT character_id, 'Brä''' || CASE WHEN n % 10 = 5 THEN 'same' ELSE translate(CAST(n AS VARCHAR), '0123456789', 'abcdefghij') END AS name, 1 + n % 7 AS cost,
  CASE WHEN n = 25 THEN [] ELSE list_filter(['Clan ' || (n % 6), CASE WHEN n % 4 = 0 THEN 'Solo ' || n END, CASE WHEN n % 9 = 0 THEN 'Twin' END], lambda x: x IS NOT NULL) END AS traits FROM brands),
set_traits AS (SELECT 'T_' || replace(name, ' ', '') AS trait_id, name FROM (SELECT DISTINCT unnest(traits) AS name FROM champions) WHERE name <> 'Twin' UNION ALL SELECT 'T_Twin' || n, 'Twin' FROM brands WHERE n IN (11, 12)),
items AS (SELECT CASE WHEN k <= 25 THEN 'TFT_Item_' ELSE 'DA_' END || t || k AS item_id,
  CASE WHEN k <= 4 THEN t || ' part ' || k WHEN k % 10 = 7 THEN 'Clan ' || (k % 7) || ' Emblem' WHEN k % 10 = 9 THEN t || ' Emblem' ELSE t || ' ' || (k % 8) END AS name,
  CASE WHEN k <= 4 OR (k > 25 AND k % 5 = 0) THEN [] WHEN k <= 25 THEN ['TFT_Item_' || t || (1 + k % 4), 'TFT_Item_' || t || (1 + k % 3)] ELSE ['TFT_Item_' || t || (1 + k % 4), 'TFT_Item_' || t || (1 + (k // 2) % 3)] END AS composition,
  ['E' || (k % 2)] AS effects, ['G' || (k % 3)] AS tags, list_filter([CASE WHEN k % 11 = 0 THEN 'T_Clan' || (k % 6) END, CASE WHEN k % 13 = 0 THEN 'Clan ' || (k % 5) END], lambda x: x IS NOT NULL) AS associated, k AS size
  FROM (SELECT DISTINCT p_type AS t, p_size AS k FROM part)),
effects AS (SELECT 'T_' || n_regionkey AS trait_id, n_nationkey // 5 AS pos, CASE WHEN n_regionkey = 3 AND n_nationkey // 5 = 2 THEN NULL WHEN n_regionkey = 2 AND n_nationkey // 5 = 3 THEN 4 ELSE 2 * (n_nationkey // 5) + 1 END AS low,
  CASE WHEN n_regionkey = 4 AND n_nationkey // 5 = 1 THEN 0 ELSE 99 END AS high FROM nation),
rec AS (SELECT * FROM items WHERE size BETWEEN 5 AND 22 AND size % 5 <> 0 AND size % 10 NOT IN (3, 4)),
role_items AS (SELECT 'Role' || (size % 8) AS role, ['tank', 'fighter', NULL][size % 8 % 3 + 1] AS family, item_id FROM rec UNION ALL SELECT 'Duo' || (size % 4), ['tank', 'caster'][size % 4 % 2 + 1], item_id FROM rec WHERE size > 12),
item_tags AS (SELECT item_id, unnest(list_filter([CASE WHEN size % 10 <> 3 THEN 'ordinary' END, 'x' || (size % 3), CASE WHEN size % 10 = 4 THEN 'TraitItem' END], lambda x: x IS NOT NULL)) AS tag FROM items),
records AS (SELECT character_id, CASE WHEN n % 3 = 0 THEN '' ELSE 'Role1' END AS role FROM brands WHERE n % 5 <> 0),
name_once AS (SELECT name, min(trait_id) AS trait_id FROM set_traits GROUP BY name HAVING count(*) = 1),
champion_links AS (SELECT DISTINCT c.character_id, t.name AS trait_name, o.trait_id FROM champions c, unnest(c.traits) AS t(name) LEFT JOIN name_once o ON o.name = t.name),
shop AS (SELECT * FROM champions WHERE cost BETWEEN 1 AND 5 AND len(traits) > 0),
singles AS (SELECT min(character_id) AS character_id, trait_id FROM champion_links JOIN shop USING (character_id) WHERE trait_id IS NOT NULL GROUP BY trait_id HAVING count(*) = 1),
refs AS (SELECT item_id, unnest(associated) AS ref FROM items UNION SELECT item_id, left(name, len(name) - 7) FROM items WHERE name LIKE '% Emblem'),
item_links AS (SELECT trait_id, item_id FROM refs JOIN set_traits ON ref = trait_id UNION SELECT o.trait_id, item_id FROM refs JOIN name_once o ON ref = o.name WHERE ref NOT IN (SELECT trait_id FROM set_traits)),
lost AS (SELECT item_id, name FROM items WHERE (item_id LIKE 'DA!_%' ESCAPE '!' OR item_id LIKE 'TFT!_Item!_%' ESCAPE '!') AND (lower(item_id) LIKE '%emblem%' OR lower(name) LIKE '%emblem%') AND item_id NOT IN (SELECT item_id FROM item_links)),
parts AS (SELECT i.item_id, list_sort(list(lower(coalesce(p.name, c.part)))) AS parts FROM items i, unnest(i.composition) AS c(part) LEFT JOIN items p ON p.item_id = c.part GROUP BY i.item_id),
full_items AS (SELECT i.*, coalesce(parts, []) AS parts FROM items i LEFT JOIN parts USING (item_id)),
components AS (SELECT DISTINCT unnest(composition) AS item_id FROM items),
bridge AS (SELECT a.item_id, b.item_id AS other, b.effects, b.tags FROM full_items a JOIN full_items b ON lower(a.name) = lower(b.name) AND a.item_id LIKE 'DA!_%' ESCAPE '!' AND b.item_id LIKE 'TFT!_Item!_%' ESCAPE '!' AND (len(a.parts) = 0 OR len(b.parts) = 0 OR a.parts = b.parts)),
needed AS (SELECT tag FROM item_tags WHERE item_id IN (SELECT item_id FROM role_items WHERE family IS NOT NULL) GROUP BY tag HAVING count(DISTINCT item_id) = (SELECT count(DISTINCT item_id) FROM role_items WHERE family IS NOT NULL)),
allowed AS (SELECT DISTINCT tag FROM item_tags WHERE item_id IN (SELECT item_id FROM role_items WHERE family IS NOT NULL)),
domain AS (SELECT item_id FROM item_tags GROUP BY item_id HAVING count(*) FILTER (tag NOT IN (SELECT tag FROM allowed)) = 0 AND count(*) FILTER (tag IN (SELECT tag FROM needed)) = (SELECT count(*) FROM needed)),
resolved AS (SELECT item_id, other FROM bridge UNION SELECT item_id, item_id FROM items WHERE item_id LIKE 'TFT!_Item!_%' ESCAPE '!'),
said AS (SELECT r.item_id, list_sort(list(DISTINCT r.other)) AS riot_items, list_sort(coalesce(list(DISTINCT role) FILTER (family = 'tank'), [])) AS tank_roles, list_sort(coalesce(list(DISTINCT role) FILTER (family <> 'tank'), [])) AS other_roles
  FROM resolved r LEFT JOIN role_items i ON i.item_id = r.other GROUP BY r.item_id),
intents AS (SELECT *, CASE WHEN len(riot_items) = 0 THEN 'unknown' WHEN len(tank_roles) > 0 AND len(other_roles) > 0 THEN 'mixed' WHEN len(tank_roles) > 0 THEN 'tank' WHEN len(other_roles) > 0 THEN 'damage' WHEN in_domain THEN 'known_unlisted' ELSE 'unknown' END AS intent
  FROM (SELECT i.item_id, coalesce(riot_items, []) AS riot_items, coalesce(tank_roles, []) AS tank_roles, coalesce(other_roles, []) AS other_roles, i.item_id IN (SELECT item_id FROM domain) AS in_domain FROM items i LEFT JOIN said USING (item_id) WHERE i.item_id NOT IN (SELECT item_id FROM components)))
"""
