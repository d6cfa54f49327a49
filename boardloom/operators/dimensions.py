"""Dimensions from set metadata: roster, traits, items, intents, and the ids that join to them.

Metadata tables are small but never assumed to be: everything is joins and grouped passes, and
whether a side is broadcast is left to the measured size.

Inputs: champions (character_id, name, cost, traits as display names), traits (trait_id, name),
items (item_id, name, composition, effects, tags, associated), effects (trait_id, pos, low, high),
roles (role, family, items), item_tags (item_id, tags).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardloom.functions.rules import id_key, name_key

TEXTS = "array<string>"


def missing_columns(tables: dict[str, DataFrame], required: dict[str, dict[str, str]]) -> list[tuple[str, str, str]]:
    """(table, column, what is wrong) for every required column that is absent or of another type."""
    gaps = []
    for table, columns in sorted(required.items()):
        have = dict(tables[table].dtypes) if table in tables else {}
        for column, kind in columns.items():
            if column not in have:
                gaps.append((table, column, "missing"))
            elif have[column] != kind:
                gaps.append((table, column, f"{have[column]} is not {kind}"))
    return gaps


def schema_gate(tables: dict[str, DataFrame], required: dict[str, dict[str, str]]) -> None:
    """Raise before any query runs when a required column is missing; only schemas are looked at."""
    gaps = missing_columns(tables, required)
    if gaps:
        raise ValueError("; ".join(f"{t}.{c}: {why}" for t, c, why in gaps))


def _by_name(dim: DataFrame, id_col: str, key: Column) -> DataFrame:
    """(key, id) for keys that name exactly one id."""
    return dim.where(key != "").groupBy(key.alias("key")).agg(F.count_distinct(id_col).alias("n"), F.min(id_col).alias("id")).where("n = 1").drop("n")


def champion_traits(champions: DataFrame, traits: DataFrame) -> DataFrame:
    """(character_id, trait_id, provider_trait): display names to ids; a name of several traits gives null."""
    rows = champions.select("character_id", F.explode("traits").alias("key")).distinct()
    return rows.join(_by_name(traits, "trait_id", F.col("name")), "key", "left").select("character_id", F.col("key").alias("trait_name"), F.col("id").alias("trait_id"))


def is_shop_champion(cost: Column, traits: Column) -> Column:
    """Cost 1 to 5 and at least one trait."""
    return F.coalesce(cost.between(1, 5) & (F.size(traits) > 0), F.lit(False))


def singleton_provider_traits(champions: DataFrame, links: DataFrame) -> DataFrame:
    """(character_id, trait_id) of traits that just one shop champion has."""
    shop = champions.where(is_shop_champion(F.col("cost"), F.col("traits"))).select("character_id")
    counted = links.where("trait_id is not null").join(shop, "character_id").groupBy("trait_id")
    return counted.agg(F.count_distinct("character_id").alias("n"), F.min("character_id").alias("character_id")).where("n = 1").select("character_id", "trait_id")


def trait_items(items: DataFrame, traits: DataFrame) -> DataFrame:
    """(trait_id, item_id): items that name a trait in their associations or as ``<trait> Emblem``.

    A reference is an id, or a display name of just one trait.
    """
    emblem = F.when(F.col("name").endswith(" Emblem"), F.array(F.expr("left(name, length(name) - 7)"))).otherwise(F.array().cast(TEXTS))
    refs = items.select("item_id", F.explode(F.array_distinct(F.concat(F.coalesce("associated", F.array().cast(TEXTS)), emblem))).alias("key"))
    as_id = refs.join(traits.select(F.col("trait_id").alias("key"), "trait_id").distinct(), "key")
    as_name = refs.join(traits.select(F.col("trait_id").alias("key")), "key", "left_anti").join(_by_name(traits, "trait_id", F.col("name")), "key").withColumnRenamed("id", "trait_id")
    return as_id.select("trait_id", "item_id").unionByName(as_name.select("trait_id", "item_id")).distinct()


def unresolved_emblems(items: DataFrame, links: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """Emblem-like items of the set's namespaces that name none of its traits."""
    ours = F.lit(False)
    for prefix in prefixes:
        ours = ours | F.col("item_id").startswith(prefix)
    says = F.lower("item_id").contains("emblem") | F.lower("name").contains("emblem")
    return items.where(ours & says).join(links.select("item_id"), "item_id", "left_anti").select("item_id", "name")


def intrinsic_traits(singletons: DataFrame, links: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Singleton-provider traits that no item adds; none at all while an emblem is unresolved."""
    open_ = unresolved.agg((F.count(F.lit(1)) > 0).alias("open"))  # one row
    free = singletons.join(links.select("trait_id").distinct(), "trait_id", "left_anti")
    return free.crossJoin(open_).where("not open").select("character_id", "trait_id")


def trait_breakpoints(effects: DataFrame) -> DataFrame:
    """(trait_id, breakpoints, rejected): the minima in order, or the reason why there are none."""
    low, high = F.col("low"), F.col("high")
    before = F.lag("low").over(Window.partitionBy("trait_id").orderBy("pos"))
    fault = lambda rank, why: F.struct(F.lit(rank).alias("rank"), F.lit(why).alias("why"))
    reason = F.when(F.col("pos").isNull(), fault(0, "no effects listed"))
    reason = reason.when(low.isNull() | (low < 1), fault(1, "an effect has no integer minimum"))
    reason = reason.when(high.isNull() | (high < low), fault(1, "an effect has no valid maximum"))
    reason = reason.when(low <= before, fault(2, "minima do not strictly increase"))
    # faults of an effect come before faults of the order, the earlier effect first
    first = F.when(F.col("fault").isNotNull(), F.struct(F.col("fault.rank").alias("rank"), F.col("pos").alias("pos"), F.col("fault.why").alias("why")))
    got = effects.withColumn("fault", reason).groupBy("trait_id").agg(F.array_sort(F.collect_list(F.struct("pos", "low"))).alias("list"), F.min(first).alias("first"))
    return got.select("trait_id", F.when(F.col("first").isNull(), F.transform("list", lambda x: x["low"])).alias("breakpoints"), F.col("first.why").alias("rejected"))


def item_dimension(items: DataFrame) -> DataFrame:
    """(item_id, name, component, recipe): an item that some recipe uses is a component."""
    used = items.select(F.explode("composition").alias("item_id")).distinct().withColumn("used", F.lit(True))
    component = F.coalesce("used", F.lit(False)) | F.array_contains(F.coalesce("tags", F.array().cast(TEXTS)), "component")
    return items.join(used, "item_id", "left").select("item_id", "name", component.alias("component"), F.when(F.size("composition") == 2, F.col("composition")).alias("recipe"))


def _component_names(items: DataFrame, key) -> DataFrame:
    """(item_id, parts): sorted keys of an item's component names; empty without a recipe."""
    parts = items.select("item_id", F.posexplode("composition").alias("i", "part"))
    named = parts.join(items.select(F.col("item_id").alias("part"), F.col("name").alias("part_name")), "part", "left")
    got = named.groupBy("item_id").agg(F.array_sort(F.collect_list(key(F.coalesce("part_name", "part")))).alias("parts"))
    return items.select("item_id").join(got, "item_id", "left").select("item_id", F.coalesce("parts", F.array().cast(TEXTS)).alias("parts"))


def _bridges(items: DataFrame, own: str, shared: str, key) -> DataFrame:
    """(item_id, other): ``own`` items and the ``shared`` ones of their name whose components agree."""
    parts = _component_names(items, key)
    full = items.join(parts, "item_id").withColumn("key", key(F.col("name")))
    left = full.where(own).select("item_id", "key", "parts")
    right = full.where(shared).select(F.col("item_id").alias("other"), "key", F.col("parts").alias("other_parts"))
    agree = (F.size("parts") == 0) | (F.size("other_parts") == 0) | (F.col("parts") == F.col("other_parts"))
    return left.join(right, "key").where(agree).select("item_id", "other")


def item_aliases(items: DataFrame, own: str, shared: str) -> DataFrame:
    """(item_id, alias_of, effects, tags): a set's own items with what their shared namesakes say.

    ``own`` and ``shared`` are SQL conditions. Only where all namesakes with agreeing components have one stat signature.
    """
    says = items.select(F.col("item_id").alias("other"), F.struct(F.array_sort("effects").alias("effects"), F.array_sort("tags").alias("tags")).alias("signature"))
    met = _bridges(items, own, shared, lambda c: F.lower(c)).join(says, "other").groupBy("item_id")
    one = met.agg(F.array_sort(F.collect_set("other")).alias("alias"), F.count_distinct("signature").alias("n"), F.first("signature").alias("s")).where("n = 1")
    none = F.array().cast(TEXTS)
    rows = items.where(own).join(one, "item_id", "left")
    union = lambda c: F.array_sort(F.array_union(c, F.coalesce(F.col(f"s.{c}"), none)))
    return rows.select("item_id", F.coalesce("alias", none).alias("alias_of"), union("effects").alias("effects"), union("tags").alias("tags"))


def intent(resolved: Column, tank: Column, other: Column, in_domain: Column) -> Column:
    """What recommendations say: mixed, tank, damage, known_unlisted or unknown."""
    said = F.when(~resolved, "unknown").when(tank & other, "mixed").when(tank, "tank").when(other, "damage")
    return said.when(in_domain, "known_unlisted").otherwise("unknown")


def item_intents(items: DataFrame, own: str, shared: str, roles: DataFrame, item_tags: DataFrame) -> DataFrame:
    """(item_id, riot_items, tank_roles, other_roles, in_domain, intent) of every completed item.

    Roles list shared items. An item is in the domain of recommendations when it has all tags that
    every recommended item has and none that no recommended item has.
    """
    lists = roles.where("family is not null").select("role", "family", F.explode("items").alias("other")).distinct()
    recommended = lists.select(F.col("other").alias("item_id")).distinct()
    tags = item_tags.select("item_id", F.explode("tags").alias("tag")).distinct()
    total = recommended.agg(F.count(F.lit(1)).alias("total"))
    allowed = tags.join(recommended, "item_id", "left_semi").groupBy("tag").agg(F.count(F.lit(1)).alias("n")).crossJoin(total)
    allowed = allowed.select("tag", (F.col("n") == F.col("total")).alias("needed"))
    needs = allowed.agg(F.count_if("needed").alias("needs"))
    fit = tags.join(allowed, "tag", "left").groupBy("item_id").agg(F.count_if(F.col("needed").isNull()).alias("strange"), F.count_if(F.coalesce("needed", F.lit(False))).alias("held"))
    domain = fit.crossJoin(needs).where("strange = 0 and held = needs and needs > 0").select("item_id", F.lit(True).alias("in_domain"))

    done = items.join(item_dimension(items).where("not component").select("item_id"), "item_id", "left_semi")
    resolved = _bridges(items, own, shared, name_key).unionByName(items.where(shared).select("item_id", F.col("item_id").alias("other"))).distinct()
    resolved = resolved.join(done.select("item_id"), "item_id", "left_semi")
    role_set = lambda family: F.array_sort(F.collect_set(F.when(family, F.col("role"))))
    said = resolved.join(lists, "other", "left").groupBy("item_id").agg(
        F.array_sort(F.collect_set("other")).alias("riot_items"), role_set(F.col("family") == "tank").alias("tank_roles"), role_set(F.col("family") != "tank").alias("other_roles")
    )
    none = F.array().cast(TEXTS)
    rows = done.join(said, "item_id", "left").join(domain, "item_id", "left").select(
        "item_id", *[F.coalesce(c, none).alias(c) for c in ("riot_items", "tank_roles", "other_roles")], F.coalesce("in_domain", F.lit(False)).alias("in_domain")
    )
    return rows.withColumn("intent", intent(F.size("riot_items") > 0, F.size("tank_roles") > 0, F.size("other_roles") > 0, F.col("in_domain")))


def intent_sets(intents: DataFrame, adaptive: str) -> DataFrame:
    """(kind, item_id): no_evidence, adaptive and corroborating items of the commitment rule."""
    is_adaptive = (F.col("item_id") == adaptive) | F.array_contains("riot_items", adaptive)
    mute = intents.where(F.col("intent").isin("tank", "known_unlisted")).select(F.lit("no_evidence").alias("kind"), "item_id")
    helm = intents.where(is_adaptive).select(F.lit("adaptive").alias("kind"), "item_id")
    backing = intents.where(~is_adaptive & F.col("intent").isin("damage", "mixed")).select(F.lit("corroborating").alias("kind"), "item_id")
    return mute.unionByName(helm).unionByName(backing)


def role_coverage(champions: DataFrame, records: DataFrame) -> DataFrame:
    """One row: shop champions, those with a role, those without a record."""
    shop = champions.where(is_shop_champion(F.col("cost"), F.col("traits"))).select("character_id")
    marked = shop.join(records.select("character_id", F.lit(True).alias("there"), "role"), "character_id", "left")
    return marked.agg(F.count(F.lit(1)).alias("shop_champions"), F.count_if(F.coalesce(F.col("role") != "", F.lit(False))).alias("with_role"), F.count_if(F.col("there").isNull()).alias("missing_record"))


def shop_identity(observed: DataFrame, champions: DataFrame) -> DataFrame:
    """(unit_id, character_id): a raw id is a shop id itself, or the one shop id with its key; else null."""
    shop = champions.where(is_shop_champion(F.col("cost"), F.col("traits")))
    exact = shop.select(F.col("character_id").alias("unit_id"), F.col("character_id").alias("same"))
    keys = shop.select("character_id", F.explode(F.array(name_key(F.col("name")), id_key(F.col("character_id")))).alias("key")).distinct()
    unique = _by_name(keys, "character_id", F.col("key"))
    rows = observed.select("unit_id").distinct().withColumn("key", id_key(F.col("unit_id")))
    return rows.join(exact, "unit_id", "left").join(unique, "key", "left").select("unit_id", F.coalesce("same", "id").alias("character_id"))


def identity_units(units: DataFrame, champions: DataFrame) -> DataFrame:
    """``units`` with ``identity``: a known unit counts if it is a shop champion, an unknown one by its stored cost."""
    known = champions.select("character_id", is_shop_champion(F.col("cost"), F.col("traits")).alias("__shop"))
    own = F.coalesce("__shop", F.coalesce(F.col("cost").between(1, 5), F.lit(False)))
    return units.join(known, "character_id", "left").withColumn("identity", own).drop("__shop")


def slugs(champions: DataFrame) -> DataFrame:
    """``champions`` with a page key: the name's key, and the id's for all but the first champion of a name."""
    slug = F.when(name_key(F.col("name")) != "", name_key(F.col("name"))).otherwise(id_key(F.col("character_id")))
    keyed = champions.withColumn("slug", slug)
    first = F.row_number().over(Window.partitionBy("slug").orderBy("cost", name_key(F.col("name")), "character_id"))
    return keyed.withColumn("slug", F.when(first == 1, F.col("slug")).otherwise(name_key(F.col("character_id"))))


def find_champion(directory: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, character_id): by exact id, else by slug or name; null when nothing fits."""
    exact = directory.select(F.col("character_id").alias("key"), F.col("character_id").alias("same"))
    names = directory.select("character_id", F.explode(F.array("slug", name_key(F.col("name")))).alias("wanted")).where("wanted <> ''")
    names = names.groupBy("wanted").agg(F.min("character_id").alias("named"))
    rows = keys.select("key").distinct().withColumn("wanted", name_key(F.col("key")))
    return rows.join(exact, "key", "left").join(names, "wanted", "left").select("key", F.coalesce("same", "named").alias("character_id"))


def with_names(rows: DataFrame, dim: DataFrame, *, key: str, id_col: str, extra: list[str] | None = None) -> DataFrame:
    """``rows`` with the names of a ``+``-joined key's members in order; an unknown id shows as it is."""
    cols = ["name", *(extra or [])]
    keys = rows.select(F.col(key).alias("__key")).distinct()
    parts = keys.select("__key", F.posexplode(F.split("__key", "\\+")).alias("i", "__id"))
    named = parts.join(dim.select(F.col(id_col).alias("__id"), *cols), "__id", "left")
    entry = F.struct("i", F.coalesce("name", "__id").alias("name"), *(extra or []))
    lists = named.groupBy("__key").agg(F.array_sort(F.collect_list(entry)).alias("__e"))
    out = rows.join(lists, F.col(key) == F.col("__key"), "left").withColumn("label", F.array_join(F.transform("__e", lambda e: e["name"]), " + "))
    return out.select(*rows.columns, "label", *[F.expr(f"transform(__e, e -> e.{c})").alias(f"{c}s") for c in extra or []])
