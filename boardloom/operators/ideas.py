"""Notebook ideas next to the evidence: filters, signatures, and boards that hold an idea's pieces.

An idea is (idea_id, carry_name, carry_character_id, core_units, target_traits, carry_items, status,
lifecycle, tags, updated_at); core_units and carry_items are names or ids, target_traits are
(name, breakpoint) structs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardloom.functions.rules import id_key, idea_signature, name_key
from boardloom.operators.evidence import BOARD, CARRY, top_by
from boardloom.sources.shared import staged


def idea_filters(ideas: DataFrame, *, status: str | None = None, lifecycle: str | None = None, carry: str | None = None, tag: str | None = None) -> DataFrame:
    """Ideas by status, lifecycle, carry (id or name in any case) and tag."""
    rows = ideas
    if status:
        rows = rows.where(F.col("status") == status.upper())
    if lifecycle:
        rows = rows.where(F.col("lifecycle") == lifecycle.lower())
    if carry:
        rows = rows.where((F.lower("carry_character_id") == carry.lower()) | (F.lower("carry_name") == carry.lower()))
    if tag:
        rows = rows.where(F.array_contains("tags", tag.lower().lstrip("#")))
    return rows


def key_of(text: Column) -> Column:
    """The key of a unit named by display name or id."""
    return F.when(id_key(text) != "", id_key(text)).otherwise(name_key(text))


def signatures(ideas: DataFrame) -> DataFrame:
    """(idea_id, signature): what an idea says, in an order of its own parts."""
    keys = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), name_key)
    carry = F.filter(F.array(name_key(F.coalesce("carry_name", "carry_character_id"))), lambda k: k != "")
    traits = F.transform("target_traits", lambda t: F.when(t["breakpoint"] > 0, F.concat(name_key(t["name"]), F.lit("@"), t["breakpoint"].cast("string"))).otherwise(name_key(t["name"])))
    items = F.filter(F.transform("carry_items", key_of), lambda k: k != "")
    return ideas.select("idea_id", idea_signature(("carry", carry), ("core", keys(F.col("core_units"))), ("traits", traits), ("items", items)).alias("signature"))


def ids_of_names(names: DataFrame, champions: DataFrame) -> DataFrame:
    """(name, character_id): every champion that a name or id may mean."""
    keys = champions.select("character_id", F.explode(F.array(name_key(F.col("name")), name_key(F.col("character_id")))).alias("key")).distinct()
    return names.select("name").distinct().withColumn("key", name_key(F.col("name"))).join(keys, "key").select("name", "character_id").distinct()


def idea_carries(ideas: DataFrame, champions: DataFrame, carries: DataFrame) -> DataFrame:
    """(idea_id, window, character_id, boards): the id with most committed boards that an idea's carry may mean."""
    named = ideas.select("idea_id", F.coalesce("carry_character_id", "carry_name").alias("name"))
    meant = named.join(ids_of_names(named, champions), "name")
    boards = carries.groupBy(*CARRY).agg(F.count(F.lit(1)).alias("boards"))
    return top_by(meant.join(boards, "character_id"), ["idea_id", "balance_window"], [F.desc("boards"), "character_id"], 1).select("idea_id", *CARRY, "boards")


def idea_evidence(ideas: DataFrame, champions: DataFrame, carries: DataFrame, units: DataFrame, traits: DataFrame) -> DataFrame:
    """(idea_id, window, piece, boards, top4): boards of the idea's carry with each core unit, all of them together, and each trait target.

    ``piece`` is ``unit:<name>``, ``together`` or ``trait:<name>@<breakpoint>``; pieces without a board
    count 0. A core unit that is the carry itself is left out. Boards are counted once for each carry and
    set of names on them, or count of a trait, so no board is repeated for the ideas that ask for it.
    """
    chosen = staged(idea_carries(ideas, champions, carries).select("idea_id", *CARRY))
    core = ideas.select("idea_id", F.explode(F.array_distinct("core_units")).alias("name"))
    meant = ids_of_names(core, champions).withColumnRenamed("character_id", "unit_id")
    pieces = staged(chosen.join(core, "idea_id").join(meant, "name").where(F.col("unit_id") != F.col("character_id")))
    wanted = staged(pieces.groupBy("idea_id", *CARRY).agg(F.array_sort(F.collect_set("name")).alias("names")).where(F.size("names") > 1))
    targets = ideas.select("idea_id", F.inline("target_traits")).withColumn("need", F.coalesce("breakpoint", F.lit(1)))
    target = F.concat(F.lit("trait:"), F.col("name"), F.lit("@"), F.col("need").cast("string"))
    aims = staged(chosen.join(targets, "idea_id").select("idea_id", *CARRY, "name", "need"))

    own = carries.select(*CARRY, *BOARD, "placement").join(chosen.select(*CARRY).distinct(), CARRY, "left_semi")
    asked = pieces.select(*CARRY, "name", "unit_id").distinct()
    held = own.join(units.select(*BOARD, F.col("character_id").alias("unit_id")), BOARD).join(asked, [*CARRY, "unit_id"])
    named = held.groupBy(*CARRY, *BOARD, "placement").agg(F.array_sort(F.collect_set("name")).alias("on_board"))
    boards, top4 = F.count(F.lit(1)).alias("boards"), F.count_if(F.col("placement") <= 4).alias("top4")
    counts = staged(named.groupBy(*CARRY, "on_board").agg(boards, top4))
    sums = [F.sum("boards").alias("boards"), F.sum("top4").alias("top4")]
    nothing = F.array().cast("array<string>")
    each = counts.select(*CARRY, F.explode("on_board").alias("name"), "boards", "top4").groupBy(*CARRY, F.concat(F.lit("unit:"), "name").alias("piece"), nothing.alias("names")).agg(*sums)
    sets = wanted.select(*CARRY, "names").distinct()
    met = counts.select("*", F.explode("on_board").alias("name")).join(sets.select("*", F.explode("names").alias("name")), [*CARRY, "name"])
    whole = met.groupBy(*CARRY, "on_board", "names", "boards", "top4").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == F.size("names"))
    together = whole.groupBy(*CARRY, F.lit("together").alias("piece"), "names").agg(*sums)

    active = traits.where("tier_current >= 1").select(*BOARD, F.col("trait_name").alias("name"), "num_units")
    levels = own.join(active, BOARD).groupBy(*CARRY, "name", "num_units").agg(boards, top4)
    reached = levels.join(aims.select(*CARRY, "name", "need").distinct(), [*CARRY, "name"]).where(F.col("num_units") >= F.col("need"))
    by_trait = reached.groupBy(*CARRY, target.alias("piece"), nothing.alias("names")).agg(*sums)

    all_pieces = (
        pieces.select("idea_id", *CARRY, F.concat(F.lit("unit:"), "name").alias("piece"), nothing.alias("names"))
        .unionByName(wanted.select("idea_id", *CARRY, F.lit("together").alias("piece"), "names"))
        .unionByName(aims.select("idea_id", *CARRY, target.alias("piece"), nothing.alias("names")))
        .distinct()
    )
    found = each.unionByName(together).unionByName(by_trait)
    return all_pieces.join(found, [*CARRY, "piece", "names"], "left").fillna(0, ["boards", "top4"]).select("idea_id", "balance_window", "piece", "boards", "top4")
