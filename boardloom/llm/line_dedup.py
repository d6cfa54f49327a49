"""Line dedup by a suffix array over line ids, built by distributed prefix doubling.

A maximal repeated run of lines with at least ``min_words`` words keeps its first copy (smaller
doc_id, then earlier line); later copies are deleted. The steps, all DataFrame operations:

1. Only lines whose content occurs twice can lie in a repeated run. They get ranks in a fixed
   order of their content (level 0); every other line ends the runs around it.
2. Prefix doubling: the rank of 2h lines at a position is the rank of the pair (rank of h lines
   here, rank of h lines h further on). Ranks come from a range-partitioned sort of the distinct
   pairs with partition offsets, so no task sees all of them, and pairs are pre-aggregated first.
3. The shortest windows that reach ``min_words`` forward from a line, and backward from a line,
   are looked up: the window's line count and the ranks of its two (overlapping) power-of-two
   halves name the interval of suffixes whose longest common prefix covers it. A window that is
   not the first of its interval is a later copy.

These windows cover just what the maximal repeated runs cover: a line of such a run is in the
forward window that starts at it or in the backward window that ends at the run's end. So
doubling can stop at the longest such window.

Cases: null text has no lines and stays null; a document whose every line goes has empty text
(:func:`drop_repeated_lines` leaves out documents that became empty, and only those). Rows that
repeat a doc_id are told apart by their text, and the smaller text counts as the earlier; equal
rows are judged together as one and each gets that result. Rows with a null doc_id count as later than
all others. Blank lines count as lines without words. Columns of ``docs`` are passed through; only
one that is named like a result column is left out of :func:`with_kept_text`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import LAST_ID, discard, staged

MIN_WORDS = 50
SPACE = "[ \\t\\n\\x0B\\f\\r]+"


def _ranked(keys: DataFrame, by: list[str]) -> DataFrame:
    """Distinct ``keys`` with their rank in the order of ``by``: sorted ranges plus offsets.

    The number of offsets is the number of partitions.
    """
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = staged(keys.repartitionByRange(n, *by).withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    row = F.row_number().over(Window.partitionBy("part").orderBy(*by))
    return staged(parts.join(F.broadcast(offsets), "part").select(*by, (row + F.col("before")).alias("rank")))


def _line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, twin, pos, line_a, line_b, words): twin tells rows that repeat a doc_id apart."""
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    twin = F.xxhash64("text").alias("twin")
    lines = base.select("doc", twin, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    words = F.size(F.filter(F.split("line", SPACE), lambda w: w != ""))
    return lines.select("doc", "twin", "pos", F.xxhash64("line").alias("line_a"), F.xxhash64(F.lit(1), F.col("line"), F.lit(2)).alias("line_b"), words.alias("words"))


def repeated_windows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, twin, first, last): line ranges that are later copies of a run of ``min_words`` words."""
    lines = _line_table(docs, id_col, text_col)
    again = lines.groupBy("line_a", "line_b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("line_a", "line_b")
    again = staged(again)
    names = _ranked(again, ["line_a", "line_b"])
    told = staged(lines.join(names, ["line_a", "line_b"]).select("doc", "twin", "pos", "words", F.col("rank").cast("long").alias("r0")).distinct())
    discard(again, names)

    # consecutive repeated lines form an island; windows stay inside it
    order = Window.partitionBy("doc", "twin").orderBy("pos")
    at = told.withColumn("island", F.col("pos") - F.row_number().over(order))
    island = Window.partitionBy("doc", "twin", "island")
    upto = F.sum("words").over(island.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    at = staged(at.withColumn("upto", upto.cast("long")).withColumn("before", F.col("upto") - F.col("words")))

    def reach(ask, say, order_by, pick):
        """For each line, the line that ``pick`` takes from those whose ``say`` is at or beyond its ``ask``."""
        own = ["doc", "twin", "island", "pos"]
        both = at.select(*own, ask.alias("goal"), F.lit(True).alias("asks")).unionByName(at.select(*own, say.alias("goal"), F.lit(False).alias("asks")))
        frame = island.orderBy(order_by).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        found = pick(F.when(~F.col("asks"), F.col("pos"))).over(frame)
        return both.withColumn("found", found).where("asks and found is not null")

    ends = reach(F.col("before") + min_words, F.col("upto"), F.desc("goal"), F.min).select("doc", "twin", F.col("pos").alias("first"), F.col("found").alias("last"))
    starts = reach(F.col("upto") - min_words, F.col("before"), F.asc("goal"), F.max).select("doc", "twin", F.col("found").alias("first"), F.col("pos").alias("last"))
    windows = ends.unionByName(starts).distinct()
    discard(told)
    windows = staged(windows.withColumn("n", F.col("last") - F.col("first") + 1).withColumn("level", F.length(F.bin("n")) - 1))

    found = None
    ranks, level = at.select("doc", "twin", "pos", "r0").withColumnRenamed("r0", "r"), 0
    while True:
        here = windows.where(F.col("level") == level)
        left = ranks.select("doc", "twin", F.col("pos").alias("first"), F.col("r").alias("a"))
        right = ranks.select("doc", "twin", (F.col("pos") + F.lit((1 << level) - 1)).alias("last"), F.col("r").alias("b"))
        named = here.join(left, ["doc", "twin", "first"]).join(right, ["doc", "twin", "last"]).select("doc", "twin", "first", "last", "n", "a", "b")
        found = named if found is None else found.unionByName(named)
        if windows.where(F.col("level") > level).isEmpty():
            break
        step = 1 << level
        nxt = ranks.select("doc", "twin", (F.col("pos") - step).alias("pos"), F.col("r").alias("b"))
        pairs = staged(ranks.withColumnRenamed("r", "a").join(nxt, ["doc", "twin", "pos"]))
        twice = staged(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b"))
        ranks = staged(pairs.join(_ranked(twice, ["a", "b"]), ["a", "b"]).select("doc", "twin", "pos", F.col("rank").cast("long").alias("r")))
        level += 1

    found = staged(found)
    place = F.struct("doc", "twin", "first")
    heads = staged(found.groupBy("n", "a", "b").agg(F.min(place).alias("head"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies"))
    return found.join(heads, ["n", "a", "b"]).where(place > F.col("head")).select("doc", "twin", "first", "last")


def _cut(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """``docs`` plus __n_lines, __n_removed and __kept."""
    late = staged(repeated_windows(docs, id_col=id_col, text_col=text_col, min_words=min_words))
    # overlapping windows merge to runs, so a document's list is short
    w = Window.partitionBy("doc", "twin").orderBy("first", "last")
    reach = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = late.withColumn("new", F.when(F.col("first") <= reach + 1, 0).otherwise(1))
    runs = cut.withColumn("run", F.sum("new").over(w)).groupBy("doc", "twin", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    runs = staged(runs.groupBy("doc", "twin").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("__runs")))
    discard(late)

    text = F.col(text_col).cast("string")
    keyed = docs.withColumns({"__doc": F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)), "__twin": F.xxhash64(text)})
    joined = keyed.join(runs.select(F.col("doc").alias("__doc"), F.col("twin").alias("__twin"), "__runs").hint("shuffle_hash"), ["__doc", "__twin"], "left")
    lines = F.split(text, "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.exists("__runs", lambda r: i.between(r["first"], r["last"])))
    gone = F.aggregate("__runs", F.lit(0), lambda acc, r: acc + r["last"] - r["first"] + 1)
    return joined.withColumns(
        {
            "__n_lines": F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long"),
            "__n_removed": F.coalesce(gone, F.lit(0)).cast("long"),
            "__kept": F.when(F.col("__runs").isNull(), text).otherwise(F.array_join(kept, "\n")),
        }
    )


def with_kept_text(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` plus n_lines, n_removed and kept_text."""
    names = {"n_lines": "__n_lines", "n_removed": "__n_removed", "kept_text": "__kept"}
    out = _cut(docs, id_col, text_col, min_words)
    return out.select(*[c for c in docs.columns if c not in names], *[F.col(private).alias(name) for name, private in names.items()])


def drop_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the later copies of repeated runs cut from their text; same columns.

    A document that consisted of later copies alone is left out.
    """
    out = _cut(docs, id_col, text_col, min_words)
    keep = out.where((F.col("__n_removed") == 0) | (F.col("__n_removed") < F.col("__n_lines")))
    return keep.withColumn(text_col, F.col("__kept")).select(*docs.columns)
