"""Store checks: integrity, distributions, orphans, exports."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOARD = ["match_id", "participant_index"]


def integrity_report(matches: DataFrame, participants: DataFrame, units: DataFrame, known_champions: DataFrame, *, ranked_queue: int = 1100) -> DataFrame:
    """One row of counts and a severity; each part is one aggregate or anti join."""
    m = matches.agg(
        F.count(F.lit(1)).alias("matches"),
        F.count_distinct("match_id").alias("distinct_matches"),
        F.count_if(F.col("queue_id") == ranked_queue).alias("ranked_matches"),
        F.count_if(F.col("balance_window").isNull()).alias("without_window"),
    )
    p = participants.agg(F.count(F.lit(1)).alias("participants"), F.count_if(~F.coalesce(F.col("placement").between(1, 8), F.lit(False))).alias("bad_placements"))
    u = units.agg(F.count(F.lit(1)).alias("units"), F.count_if(F.col("cost").isNotNull()).alias("units_with_cost"))
    empty = participants.join(units.select(*BOARD), BOARD, "left_anti").agg(F.count(F.lit(1)).alias("boards_without_units"))
    unknown = units.select("character_id").distinct().join(known_champions, "character_id", "left_anti").agg(F.count(F.lit(1)).alias("unknown_champions"))
    lobbies = broken_lobbies(participants).agg(F.count(F.lit(1)).alias("broken_lobbies"))
    out = m.crossJoin(p).crossJoin(u).crossJoin(empty).crossJoin(unknown).crossJoin(lobbies)  # one row each
    bad = (F.col("distinct_matches") < F.col("matches")) | (F.col("bad_placements") > 0)
    odd = (F.col("unknown_champions") > 0) | (F.col("broken_lobbies") > 0) | (F.col("boards_without_units") > 0)
    return out.withColumn("severity", F.when(bad, "error").when(odd, "warning").otherwise("ok"))


def broken_lobbies(participants: DataFrame) -> DataFrame:
    """Matches that lack eight distinct placements."""
    got = participants.groupBy("match_id").agg(F.count(F.lit(1)).alias("boards"), F.count_distinct("placement").alias("placements"))
    return got.where((F.col("boards") != 8) | (F.col("placements") != F.col("boards")))


def orphans(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of child rows without a parent, and of parents without a child, each once; a key with a null part meets nothing.

    Both sides are brought in once and grouped together, so a task holds one table of its keys and
    sorts none. Parents hardly repeat a key: they are dealt out first, since a group of them where
    they are read would hold all keys of a file's part.
    """
    n = int(parents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    child, parent = [F.lit(True), F.lit(False)], [F.lit(False), F.lit(True)]
    side = lambda df, flags: df.select(*keys, *[f.alias(x) for f, x in zip(flags, ("__child", "__parent"))])
    both = side(children, child).unionByName(side(parents.select(*keys).repartition(n, *keys), parent))
    seen = both.groupBy(*keys).agg(F.max("__child").alias("__child"), F.max("__parent").alias("__parent"))
    alone = F.lit(False)
    for k in keys:
        alone = alone | F.col(k).isNull()
    lost = F.array(F.when(F.col("__child") & (~F.col("__parent") | alone), "parent"), F.when(F.col("__parent") & (~F.col("__child") | alone), "child"))
    return seen.select(*keys, F.explode(F.filter(lost, lambda x: x.isNotNull())).alias("missing"))


def unknown_ids(observed: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return observed.select(key).distinct().join(known.select(key), key, "left_anti")


def raw_versus_stored(raw: DataFrame, stored: DataFrame) -> DataFrame:
    """Unit counts of the document next to those stored, with a verdict for each board."""
    both = raw.withColumnRenamed("units", "raw_units").join(stored.withColumnRenamed("units", "stored_units"), BOARD, "full_outer")
    r, s = F.coalesce("raw_units", F.lit(0)), F.coalesce("stored_units", F.lit(0))
    verdict = F.when((r == 0) & (s == 0), "source_empty").when(s == 0, "lost").when(r != s, "differs").otherwise("same")
    return both.select(*BOARD, r.alias("raw_units"), s.alias("stored_units"), verdict.alias("verdict"))


def sanitized(df: DataFrame, private: dict[str, object]) -> DataFrame:
    """``df`` with fixed values in its private columns."""
    return df.withColumns({c: F.lit(v).cast(df.schema[c].dataType) for c, v in private.items() if c in df.columns})


def leak_counts(df: DataFrame, markers: list[str], ids: DataFrame | None = None, id_col: str = "match_id", player_length: int = 78) -> DataFrame:
    """How often secrets, player ids and source ids show in the string columns of an export."""
    texts = [c for c, t in df.dtypes if t == "string"]
    long = df.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, texts)), F.array(*[F.coalesce(c, F.lit("")) for c in texts]))).alias("column", "value"))
    marked = F.lit(False)
    for m in markers:
        marked = marked | F.col("value").contains(m)
    rows = long.withColumns({"secret": marked, "player": F.col("value").rlike(f"(^|[^A-Za-z0-9_-])[A-Za-z0-9_-]{{{player_length}}}([^A-Za-z0-9_-]|$)")})
    if ids is not None:
        rows = rows.join(ids.select(F.col(id_col).alias("value")).distinct().withColumn("source_id", F.lit(True)), "value", "left")
    else:
        rows = rows.withColumn("source_id", F.lit(None).cast("boolean"))
    count = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(f"{c}s")
    return rows.groupBy("column").agg(count("secret"), count("player"), count("source_id"))


#: Ids that one bucket of a fingerprint holds.
BUCKET_IDS = 100_000


def population_fingerprint(matches: DataFrame) -> DataFrame:
    """A digest of the sorted ids of each window that no task sees whole: sha256 over bucket digests.

    Buckets are ranges of a checksum, as many as the largest window needs.
    """
    most = matches.groupBy("balance_window").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    buckets = most // BUCKET_IDS + 1
    keyed = matches.select("balance_window", "match_id", F.pmod(F.crc32(F.col("match_id").cast("binary")), F.lit(buckets)).alias("b"))
    parts = keyed.groupBy("balance_window", "b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("match_id")), "\n"), 256).alias("d"))
    return parts.groupBy("balance_window").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), "\n"), 256).alias("fingerprint"))


def source_fingerprint(matches: DataFrame, settings: dict | None = None) -> DataFrame:
    """Match count, latest and summed time of each window, and a digest of the settings a result was made with.

    A prepared result is stale when either its source's numbers or the digest differ.
    """
    version = hashlib.sha256(json.dumps(settings or {}, sort_keys=True).encode()).hexdigest()
    rows = matches.groupBy("balance_window").agg(F.count(F.lit(1)).alias("matches"), F.max("game_datetime").alias("latest"), F.sum("game_datetime").alias("time_sum"))
    return rows.withColumn("version", F.lit(version))


def first_reason(*checks: tuple[str, Column]) -> Column:
    """The first failing check's name, or null."""
    out = F.lit(None).cast("string")
    for name, failed in reversed(checks):
        out = F.when(failed, F.lit(name)).otherwise(out)
    return out
