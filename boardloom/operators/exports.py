"""Exports of chosen windows: provenance checks, opaque ids, fixed values in private columns, leak scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardloom.operators.quality import BOARD, orphans
from boardloom.operators.ranks import spread_row_number

REGIONAL = "^[A-Z0-9]+_[0-9]+$"
OPAQUE = "^S[0-9]{7,}$"
NUMERIC_PATCH = "^[0-9]{1,3}\\.[0-9]{1,3}$"


def completed_samples(samples: DataFrame, runs: DataFrame) -> DataFrame:
    """(player, last_sampled): the latest time of each player in completed runs alone."""
    done = runs.where("status = 'completed'").select("run_id")
    return samples.join(done, "run_id").groupBy("player").agg(F.max("sampled_at").alias("last_sampled"))


def unlinked_matches(matches: DataFrame, discoveries: DataFrame, runs: DataFrame) -> DataFrame:
    """Ids of matches that no completed run discovered."""
    linked = discoveries.join(runs.where("status = 'completed'").select("run_id"), "run_id").select("match_id")
    return matches.select("match_id").join(linked, "match_id", "left_anti")


def export_failures(matches: DataFrame, participants: DataFrame, discoveries: DataFrame, runs: DataFrame, *, ranked_queue: int = 1100) -> DataFrame:
    """(reason, matches): how many matches fail each check of an export.

    ``matches`` has match_id, queue_id, patch and payload (JSON of the document).
    """
    counts = participants.groupBy("match_id").agg(F.count(F.lit(1)).alias("boards"))
    unlinked = unlinked_matches(matches, discoveries, runs).distinct().withColumn("unlinked", F.lit(True))
    rows = matches.join(counts, "match_id", "left").join(unlinked, "match_id", "left")
    part = lambda path: F.get_json_object("payload", path)
    players = F.from_json(part("$.metadata.participants"), "array<string>")
    readable = part("$.metadata").isNotNull()
    listed = F.coalesce((F.size(players) > 0) & (F.size(players) == F.col("boards")) & F.forall(players, lambda p: p != ""), F.lit(False))
    checks = {
        "not linked to a completed run": F.coalesce("unlinked", F.lit(False)),
        "queue is not ranked": ~F.coalesce(F.col("queue_id") == ranked_queue, F.lit(False)),
        "id is not regional": ~F.col("match_id").rlike(REGIONAL),
        "patch is not numeric": ~F.coalesce(F.col("patch").rlike(NUMERIC_PATCH), F.lit(False)),
        "payload is missing or unreadable": ~readable,
        "payload id differs": readable & ~F.coalesce(part("$.metadata.match_id") == F.col("match_id"), F.lit(False)),
        "payload has no version": readable & (F.coalesce(part("$.metadata.data_version"), F.lit("")) == ""),
        "payload players differ from boards": readable & ~listed,
        "payload queue is not ranked": readable & ~F.coalesce(part("$.info.queue_id") == str(ranked_queue), F.lit(False)),
    }
    failed = F.filter(F.array(*[F.when(c, name) for name, c in checks.items()]), lambda x: x.isNotNull())
    return rows.select("match_id", F.explode(failed).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("matches"))


def export_gate(failures: DataFrame) -> None:
    """Refuse the export when any check failed; there are no more rows than checks."""
    found = failures.orderBy("reason").collect()
    if found:
        raise ValueError("; ".join(f"{r['reason']}: {r['matches']}" for r in found))


def opaque_ids(matches: DataFrame) -> DataFrame:
    """(match_id, opaque_id): ``S0000001`` and on, by time and id."""
    numbered = spread_row_number(matches.select("match_id", "game_datetime"), [], [F.col("game_datetime"), F.col("match_id")], "n")
    digits = F.col("n").cast("string")
    return numbered.select("match_id", F.concat(F.lit("S"), F.lpad(digits, F.greatest(F.lit(7), F.length(digits)), F.lit("0"))).alias("opaque_id"))


def with_opaque_ids(table: DataFrame, mapping: DataFrame) -> DataFrame:
    """``table`` under opaque ids; rows of matches outside the mapping stay behind."""
    return table.join(mapping, "match_id").withColumn("match_id", F.col("opaque_id")).select(*table.columns)


def verify_export(matches: DataFrame, participants: DataFrame, units: DataFrame, windows: list[str], *, most_level: int = 10) -> DataFrame:
    """(check, failures): orphans, ids that are not opaque, windows that were not asked for, levels out of range."""

    def count(name: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(name).alias("check"), "failures")

    missing = lambda child, parent, keys: orphans(child, parent, keys).where("missing = 'parent'")
    parts = [
        count("boards without a match", missing(participants, matches, ["match_id"])),
        count("units without a board", missing(units, participants, BOARD)),
        count("matches without boards", matches.select("match_id").join(participants.select("match_id"), "match_id", "left_anti")),
        count("ids that are not opaque", matches.where(~F.col("match_id").rlike(OPAQUE))),
        count("windows not asked for", matches.where(~F.coalesce(F.col("balance_window").isin(windows), F.lit(False)))),
        count("levels out of range", participants.where(~F.coalesce(F.col("level").between(0, most_level), F.lit(False)))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def owner_notes(ideas: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ideas that the owner wrote, and the notes on them."""
    own = ideas.where("origin = 'manual'")
    return own, notes.join(own.select("idea_id"), "idea_id", "left_semi")


def provenance(matches: DataFrame, participants: DataFrame, levels_kept: bool) -> DataFrame:
    """One row that a reader verifies: counts, windows and whether levels are real."""
    m = matches.agg(F.count(F.lit(1)).alias("matches"), F.array_join(F.array_sort(F.collect_set("balance_window")), ",").alias("windows"))
    p = participants.agg(F.count(F.lit(1)).alias("boards"))
    return m.crossJoin(p).withColumn("participant_level", F.lit("preserved" if levels_kept else "not preserved"))


def level_rows(participants: DataFrame, record: DataFrame) -> DataFrame:
    """``participants`` when the source's record says that levels are real, else none. The record has one row."""
    kept = record.where("participant_level = 'preserved'").select(F.lit(True).alias("__kept")).limit(1)
    return participants.crossJoin(kept).drop("__kept")

