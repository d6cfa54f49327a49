"""Match documents (nested JSON) to typed tables, and tables to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardloom.functions.rules import ItemSets, completed_items

BOARD = ["match_id", "participant_index"]

#: fixed values: field names and types of a match document
MATCH_SCHEMA = """
metadata STRUCT<match_id: STRING, data_version: STRING, participants: ARRAY<STRING>>,
info STRUCT<match_id: STRING, game_version: STRING, tft_game_type: STRING, queue_id: INT, tft_set_number: INT, tft_set_core_name: STRING, game_datetime: BIGINT,
  participants: ARRAY<STRUCT<placement: INT, level: INT, augments: ARRAY<STRING>,
    units: ARRAY<STRUCT<character_id: STRING, name: STRING, rarity: INT, tier: INT, itemNames: ARRAY<STRING>, item_names: ARRAY<STRING>>>,
    traits: ARRAY<STRUCT<name: STRING, num_units: INT, style: INT, tier_current: INT, tier_total: INT>>>>>
"""


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """Documents under ``path``, one JSON object a line, with one typed row each.

    The id comes from the metadata, else from the info, else it is ``unknown``. A line that is no
    JSON gives a row of nulls and so the id ``unknown`` without boards.
    """
    return typed(spark.read.schema(MATCH_SCHEMA).json(path))


def typed(docs: DataFrame) -> DataFrame:
    """Documents in MATCH_SCHEMA as (match_id, match fields, boards); works on streams as well."""
    info = F.col("info")
    names = ["game_version", "queue_id", "game_datetime"]
    own_id = F.coalesce(F.when(F.col("metadata.match_id") != "", F.col("metadata.match_id")), F.when(info.match_id != "", info.match_id), F.lit("unknown"))
    return docs.select(
        own_id.alias("match_id"),
        *[info[n].alias(n) for n in names],
        info.tft_game_type.alias("game_type"),
        info.tft_set_number.alias("set_number"),
        info.tft_set_core_name.alias("set_core_name"),
        info.participants.alias("boards"),
    )


def participants(matches: DataFrame) -> DataFrame:
    """One row a board; its place in the list is the index, missing numbers are 0."""
    rows = matches.select("match_id", F.posexplode("boards").alias("participant_index", "p"))
    return rows.select(*BOARD, *[F.coalesce(F.col(f"p.{n}"), F.lit(0)).alias(n) for n in ("placement", "level")], F.coalesce("p.augments", F.array().cast("array<string>")).alias("augments"))


def units(matches: DataFrame, sets: ItemSets) -> DataFrame:
    """One row a unit; a missing or zero tier is 1, missing items an empty list, a missing name the id."""
    boards = matches.select("match_id", F.posexplode("boards").alias("participant_index", "p"))
    rows = boards.select(*BOARD, F.posexplode("p.units").alias("unit_index", "u"))
    character = F.coalesce("u.character_id", F.lit(""))
    first = F.when(F.size("u.itemNames") > 0, F.col("u.itemNames"))
    items = F.coalesce(first, F.col("u.item_names"), F.array().cast("array<string>"))
    out = rows.select(
        *BOARD,
        "unit_index",
        character.alias("character_id"),
        F.coalesce(F.when(F.col("u.name") != "", F.col("u.name")), character).alias("unit_name"),
        F.col("u.rarity").alias("rarity"),
        F.when(F.col("u.tier") != 0, F.col("u.tier")).otherwise(1).alias("tier"),
        items.alias("items"),
    )
    return out.withColumn("completed_item_count", completed_items(F.col("items"), sets))


def traits(matches: DataFrame) -> DataFrame:
    """One row for each trait name of a board; a name that repeats keeps its last entry."""
    boards = matches.select("match_id", F.posexplode("boards").alias("participant_index", "p"))
    rows = boards.select(*BOARD, F.posexplode("p.traits").alias("at", "t")).where("coalesce(t.name, '') <> ''")
    last = rows.groupBy(*BOARD, F.col("t.name").alias("trait_name")).agg(F.max_by("t", "at").alias("t"))
    return last.select(*BOARD, "trait_name", F.coalesce("t.num_units", F.lit(0)).alias("num_units"), F.col("t.style").alias("style"), F.col("t.tier_current").alias("tier_current"), F.col("t.tier_total").alias("tier_total"))


def nested(matches: DataFrame, boards: DataFrame, own_units: DataFrame, own_traits: DataFrame) -> DataFrame:
    """The four tables as documents in the shape that :func:`read_matches` takes.

    Units, traits and boards are grouped by match, each on its own, so that tables which are dealt out by
    match are not dealt out again; lists hold what a match holds, so their length is bounded by the game.
    """

    def lists(rows: DataFrame, entry: Column, name: str) -> DataFrame:
        by_board = rows.where("participant_index is not null").groupBy(*BOARD).agg(F.array_sort(F.collect_list(entry)).alias("x"))
        return by_board.groupBy("match_id").agg(F.map_from_entries(F.collect_list(F.struct("participant_index", "x"))).alias(name))

    u = F.struct("unit_index", "character_id", (F.col("cost") - 1).alias("rarity"), "tier", F.col("items").alias("itemNames"))
    t = F.struct(F.col("trait_name").alias("name"), "num_units", "style", "tier_current")
    seats = boards.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("participant_index", "placement", "level"))).alias("boards"))
    rows = seats.join(lists(own_units, u, "units"), "match_id", "left").join(lists(own_traits, t, "traits"), "match_id", "left")

    def whole(board: Column) -> Column:
        own = lambda name: F.try_element_at(F.col(name), board["participant_index"])
        return F.struct(board["placement"].alias("placement"), board["level"].alias("level"), F.transform(own("units"), lambda x: x.dropFields("unit_index")).alias("units"), own("traits").alias("traits"))

    told = rows.select("match_id", F.transform("boards", whole).alias("participants"))
    info = F.struct("game_version", "queue_id", "game_datetime", "participants")
    return matches.join(told, "match_id", "left").select(F.struct("match_id").alias("metadata"), info.alias("info"))


def write_matches(docs: DataFrame, path: str) -> None:
    """Documents as compressed text, one JSON object a line; :func:`read_matches` reads them as they are."""
    docs.write.option("compression", "gzip").json(path)
