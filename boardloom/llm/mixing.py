"""Mixing sources to target weights by Pfair scheduling.

Weights are rounded to whole blocks of a period of SLOTS slots a source (largest remainder, at
least one each). Within a period, block i of a source with weight w is released at floor(i / w) and due
at ceil((i + 1) / w); the earliest deadline among released blocks runs next, ties to the later
successor deadline, then to the source name. A Pfair schedule repeats after a period, so one
period is worked out (its size follows from the number of sources, at most MAX_SOURCES, and not
from their rows) and any block of any source is placed by arithmetic: block b lies in period b div p, at the slot of block b mod p.
In every prefix of the schedule each source is less than one block from its share.

Blocks are cut by characters (plus one for each document's end): a document belongs to the block
in which it starts. Documents of a source are taken in an order fixed by a hash of doc_id and text. Offsets
inside a source come from hash buckets: totals for each (source, bucket), a running sum over
those totals, and a running sum inside each bucket. So a source with a third of all rows is
spread over as many tasks as its share asks for.

When a source has no blocks left, its slots stay empty and the others keep their proportions; no
document is dropped or repeated. Cases: a null source is a source of its own; null or empty text
counts one character; equal rows follow each other; a null doc_id is an id like any other. An
empty table gives an empty result. Columns of ``docs`` are passed through; only one that is named
like a result column is left out of :func:`schedule`.

:func:`mixed` hands on what it decided: rows lie in the mixed order, file after file, and the source
column's metadata holds the weights. :func:`decided` reads both again, from files or from rows that were not written.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import staged

#: Slots of a period for each source, and the most sources: a period has to fit the driver.
SLOTS = 128
MAX_SOURCES = 4096
BLOCK_CHARS = 65_536
ROWS_PER_BUCKET = 512
TEMPERATURE = 0.5
#: Metadata of the source column of mixed rows: the weights they were mixed by.
WEIGHTS = "mixing.weights"
#: Places of one file; a place is the file's rank above these bits and the row's number below.
FILE_BITS = 40


def whole_shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Slots of each source in one period: largest remainder, ties to the smaller name, at least 1."""
    if len(weights) > period:
        raise ValueError("the period must have a slot for each source")
    spare, total = period - len(weights), sum(weights.values())
    if total <= 0 or min(weights.values()) < 0:
        raise ValueError("weights must be positive")
    exact = {s: spare * w / total for s, w in weights.items()}
    share = {s: math.floor(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (share[s] - exact[s], s))[: spare - sum(share.values())]:
        share[s] += 1
    return {s: n + 1 for s, n in share.items()}


def pfair_period(shares: dict[str, int]) -> list[tuple[str, int]]:
    """(source, block of the period) for every slot of one period."""
    period, slots = sum(shares.values()), []
    # blocks wait for their release, then run in order of deadline
    waiting = [(0, s, 0) for s in sorted(shares)]
    ready: list[tuple[int, int, str, int]] = []
    heapq.heapify(waiting)
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, s, i = heapq.heappop(waiting)
            w = Fraction(shares[s], period)
            heapq.heappush(ready, (math.ceil((i + 1) / w), -math.ceil((i + 2) / w), s, i))
        *_, s, i = heapq.heappop(ready)
        slots.append((s, i))
        if i + 1 < shares[s]:
            heapq.heappush(waiting, (math.floor((i + 1) / Fraction(shares[s], period)), s, i + 1))
    return slots


def target_weights(docs: DataFrame, source_col: str = "source", text_col: str = "text", temperature: float = TEMPERATURE) -> dict[str, float]:
    """Characters of each source to the power ``temperature``: flatter than the raw shares."""
    size = F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(0)) + 1
    rows = docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("\0")).alias("s")).agg(F.sum(size.cast("long")).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"at most {MAX_SOURCES} sources; put small ones together first")
    return {r["s"]: float(r["n"]) ** temperature for r in rows}


def schedule(docs: DataFrame, **how) -> DataFrame:
    """``docs`` plus block, slot and block_offset; see :func:`_placed`."""
    names = {"block": "__block", "slot": "__slot", "block_offset": "__offset"}
    return _placed(docs, **how).select(*[c for c in docs.columns if c not in names], *[F.col(private).alias(name) for name, private in names.items()])


def _placed(
    docs: DataFrame,
    *,
    weights: dict[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block_chars: int = BLOCK_CHARS,
    size_col: str | None = None,
    order_col: str | None = None,
) -> DataFrame:
    """``docs`` plus __block, __slot and __offset; (slot, offset, id) is the mixed order.

    ``weights`` maps every source to its target weight (null is the key ``"\\0"``); by default
    :func:`target_weights`. A source without a weight is an error. ``size_col`` is a row's size in
    place of its characters. ``order_col`` has places to take the rows of a source by, in place of the
    hash; close to each other for rows that follow each other.
    """
    spark = docs.sparkSession
    weights = weights or target_weights(docs, source_col, text_col)
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("\0"))
    size = (F.col(size_col) if size_col else F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(0)) + 1).cast("long")
    if order_col:
        order = F.col(order_col).cast("long")
        bucket = F.floor(order / F.lit(ROWS_PER_BUCKET))
    else:
        order = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
        n_rows = docs.count()
        bits = max(1, min(30, math.ceil(math.log2(max(2, n_rows / ROWS_PER_BUCKET)))))
        bucket = F.shiftrightunsigned(order, 64 - bits)
    keyed = docs.withColumns({"__source": source, "__size": size, "__order": order, "__id": F.col(id_col).cast("long"), "__bucket": bucket})

    totals = keyed.groupBy("__source", "__bucket").agg(F.sum("__size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = staged(totals.select("__source", "__bucket", F.coalesce(before, F.lit(0)).alias("__before")))

    if not weights:
        slots = []
    else:
        unknown = offsets.select("__source").distinct().where(~F.col("__source").isin(list(weights))).limit(1).collect()
        if unknown:
            raise ValueError(f"no weight for source {unknown[0][0]!r}")
        if len(weights) > MAX_SOURCES:
            raise ValueError(f"at most {MAX_SOURCES} weights")
        shares = whole_shares(weights, SLOTS * len(weights))
        slots = [(s, i, t, shares[s]) for t, (s, i) in enumerate(pfair_period(shares))]
    one_period = staged(spark.createDataFrame(slots, "__source string, __i long, __t long, __share long"))
    share = one_period.groupBy("__source").agg(F.first("__share").alias("__share"))
    length = len(slots) or 1

    inside = Window.partitionBy("__source", "__bucket").orderBy("__order", "__id").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.join(offsets.join(share, "__source").hint("shuffle_hash"), ["__source", "__bucket"])
    placed = placed.withColumn("__start", F.col("__before") + F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    placed = placed.withColumn("__block", F.floor(F.col("__start") / block_chars)).withColumn("__i", F.col("__block") % F.col("__share"))
    placed = placed.join(one_period.select("__source", "__i", "__t"), ["__source", "__i"])
    slot = F.floor(F.col("__block") / F.col("__share")) * length + F.col("__t")
    return placed.withColumns({"__slot": slot, "__offset": F.col("__start") % block_chars})


def mixed(docs: DataFrame, *, weights: dict[str, float] | None = None, text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """``docs``, same columns and rows, in the mixed order: ranges of slots, each sorted; the weights go along as metadata."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    weights = weights or target_weights(docs, source_col, text_col)
    out = _placed(docs, weights=weights, text_col=text_col, source_col=source_col, **how)
    out = out.repartitionByRange(n, "__slot").sortWithinPartitions("__slot", "__offset", "__id").select(*docs.columns)
    return out.withMetadata(source_col, docs.schema[source_col].metadata | {WEIGHTS: weights})


def decided(docs: DataFrame, source_col: str = "source") -> tuple[DataFrame, dict[str, float] | None, dict[str, int] | None]:
    """What :func:`mixed` decided for ``docs``: the rows, their weights and how files follow each other.

    Without weights the rows were not mixed. With files the rows have __file and __row; without,
    they were not written and follow each other as they come.
    """
    weights = docs.schema[source_col].metadata.get(WEIGHTS)
    if weights is None:
        return docs, None, None
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        return docs, weights, None
    names = sorted((r[0] for r in placed.select("__file").distinct().collect()), key=lambda name: (len(name), name))
    return placed, weights, {name: i for i, name in enumerate(names)}
