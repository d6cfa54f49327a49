"""Registered queries: documents and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardloom.plans.registry import query
from boardloom.sources import documents as dc
from boardloom.sources.binding import ITEM_SETS, Boards, epoch_ms
from boardloom.sources.shared import shared_folder
from boardloom.streaming import store as st

RANKED = "click"


def _published(b: Boards) -> DataFrame:
    """The bound tables as documents, written as JSON and read again."""
    path = shared_folder(b.spark, "matches")
    dc.write_matches(dc.nested(b.matches, b.participants, b.units, b.traits), path)
    return dc.read_matches(b.spark, path)


@query("s01_read_matches", "SELECT match_id, game_datetime, game_version, queue_id, CAST(n AS INTEGER) AS boards FROM matches JOIN (SELECT match_id, count(*) AS n FROM participants GROUP BY ALL) USING (match_id)")
def read_matches(b):
    return _published(b).select("match_id", "game_datetime", "game_version", "queue_id", F.size("boards").alias("boards"))


@query("s02_flatten_units", "SELECT match_id, participant_index, unit_index, character_id, cost, tier, array_to_string(items, ',') AS items, completed_item_count FROM units")
def flatten_units(b):
    out = dc.units(_published(b), ITEM_SETS)
    return out.select("match_id", "participant_index", "unit_index", "character_id", (F.col("rarity") + 1).alias("cost"), "tier", F.array_join("items", ",").alias("items"), "completed_item_count")


@query("s02_flatten_participants", "SELECT match_id, participant_index, placement, level FROM participants")
def flatten_participants(b):
    return dc.participants(_published(b)).select("match_id", "participant_index", "placement", "level")


@query("s04_trait_rows", "SELECT match_id, participant_index, trait_name, num_units, tier_current FROM traits")
def trait_rows(b):
    return dc.traits(_published(b)).select("match_id", "participant_index", "trait_name", "num_units", "tier_current")


def _events(b: Boards) -> DataFrame:
    # a pattern, since the stream source takes a plain path for a directory
    schema = b.read("events").schema
    rows = b.spark.readStream.schema(schema).parquet(f"{b.sf_dir}/event[s].parquet")
    return rows.select("event_id", F.timestamp_millis(epoch_ms(F.col("ts"))).alias("at"), F.col("event_type").alias("cohort"), F.col("user_id").alias("player"))


def _once(b: Boards, rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``rows`` through a stream that keeps one of each ``key``, and the table it leaves."""
    path, kept = shared_folder(b.spark, "arrived"), rows.select(*columns, "at")
    st.append_once(kept, path, shared_folder(b.spark, "stream"), key=key, at="at")
    return st.stored(b.spark, path, kept.schema)


def _stored(b: Boards) -> DataFrame:
    return _once(b, _events(b).where(F.col("cohort") != RANKED), ["event_id"], ["event_id", "cohort", "player"])


@query("g01_stream_matches", f"SELECT DISTINCT event_id, event_type AS cohort, user_id AS player FROM events WHERE event_type <> '{RANKED}'", raw=True)
def stream_matches(b):
    return _stored(b).select("event_id", "cohort", "player")


@query("s03_idempotent_append", f"SELECT DISTINCT event_id, event_type AS cohort, user_id AS player FROM events WHERE event_type <> '{RANKED}'", raw=True)
def idempotent_append(b):
    """Two runs of one stream: the second finds nothing that is new."""
    path, checkpoint = shared_folder(b.spark, "arrived"), shared_folder(b.spark, "stream")
    rows = _events(b).where(F.col("cohort") != RANKED)
    for _ in range(2):
        st.append_once(rows, path, checkpoint, key=["event_id"], at="at")
    return st.stored(b.spark, path, rows.schema).select("event_id", "cohort", "player")


@query("g03_provenance_stream", f"SELECT DISTINCT event_id, user_id AS player FROM events WHERE event_id IN (SELECT event_id FROM events WHERE event_type <> '{RANKED}')", raw=True)
def provenance_stream(b):
    """Links of players to matches and the matches themselves, as two streams that may arrive in either order."""
    matches = _events(b).where(F.col("cohort") != RANKED).select("event_id", "at")
    path, schema = shared_folder(b.spark, "linked"), "event_id long, player long, at timestamp"
    st.append_matched(_events(b), matches, path, shared_folder(b.spark, "stream"), key=["event_id"], at="at", columns=["event_id", "player"])
    return b.spark.read.schema(schema).parquet(path).select("event_id", "player")


@query("g06_live_counts", "SELECT epoch(date_trunc('day', ts))::BIGINT AS starts, event_type AS cohort, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL", raw=True)
def live_counts(b):
    path = shared_folder(b.spark, "counts")
    st.live_counts(_events(b), ["cohort"], path, shared_folder(b.spark, "stream"), at="at")
    return st.newest_counts(b.spark, path, ["cohort"]).select(F.unix_seconds("starts").alias("starts"), "cohort", "n")


@query("g06_live_carries", "SELECT epoch(date_trunc('day', make_timestamp(game_datetime * 1000)))::BIGINT AS starts, c.balance_window, c.character_id, count(*) AS n FROM carries c JOIN matches USING (match_id) GROUP BY ALL")
def live_carries(b):
    """Match documents as they arrive: committed carries of each day and window."""
    source, path = shared_folder(b.spark, "matches"), shared_folder(b.spark, "counts")
    dc.nested(b.matches, b.participants, b.units, b.traits).write.json(source)
    arriving = dc.typed(b.spark.readStream.schema(dc.MATCH_SCHEMA).json(source))
    at = F.timestamp_millis("game_datetime")
    rows = arriving.select(at.alias("at"), F.year(at).cast("string").alias("balance_window"), F.explode(st.committed_units(F.col("boards"), ITEM_SETS)).alias("character_id"))
    # all documents are there at the start, so one batch takes them in, and its state closes seven days behind the newest
    st.live_counts(rows, ["balance_window", "character_id"], path, shared_folder(b.spark, "stream"), at="at")
    return st.newest_counts(b.spark, path, ["balance_window", "character_id"]).select(F.unix_seconds("starts").alias("starts"), "balance_window", "character_id", "n")


_TABLES = ("matches", "participants", "units", "traits")
#: What every query needs; names and types of the logical schema.
REQUIRED = {
    "matches": {"match_id": "string", "game_datetime": "bigint", "balance_window": "string", "queue_id": "int"},
    "participants": {"match_id": "string", "participant_index": "int", "placement": "int", "level": "int"},
    "units": {"match_id": "string", "participant_index": "int", "character_id": "string", "tier": "int", "items": "array<string>"},
    "traits": {"match_id": "string", "participant_index": "int", "trait_name": "string", "tier_current": "int"},
}


@query("s05_schema_gate", "SELECT 'matches' AS tbl, count(*) AS n FROM matches UNION ALL SELECT 'participants', count(*) FROM participants UNION ALL SELECT 'units', count(*) FROM units UNION ALL SELECT 'traits', count(*) FROM traits")
def schema_gate(b):
    """Row counts of the store, once its schema has passed the gate."""
    from boardloom.operators.dimensions import schema_gate as gate

    tables = {name: getattr(b, name) for name in _TABLES}
    gate(tables, REQUIRED)
    rows = None
    for name, table in tables.items():
        own = table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "n")
        rows = own if rows is None else rows.unionByName(own)
    return rows
