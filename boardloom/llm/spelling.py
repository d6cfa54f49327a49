"""Spelling variants: words one edit apart, found with asymmetric q-chunks.

Of two words one edit apart, the shorter one (either one, at equal lengths) gives two disjoint
chunks, its halves. One edit leaves a half as it is, so the other word holds that half as a
positional gram, moved by no more than the one place that its length has gained: only the grams
at those places can meet a chunk, and the chunk word's length is part of the key, so the shift is
exact. Frequent halves (prefixes, endings) would still meet a great many words. The rest of the
chunk word is therefore cut in two once more: an edit in the rest spares one part of it, and the key
is the half together with the part. A key fixes at least four of six letters, three of four beyond.
Every meeting is verified by edit distance, so a link is neither lost nor made up.

A word's form is its most frequent near word, when that one is frequent enough; roots follow forms
to their end by pointer doubling (counts rise at each step, so there are no circles).

Cases: null text has no word; a null id counts as an empty string where ids are hashed. Repeated
rows count each time. No words, or none near another, give an empty table and words that are
their own roots. Ties between forms go to the smallest word in code-point order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import discard, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Maximal runs of Latin letters.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
LEAST_POINTS, LEAST_COUNT, RATIO = 6, 5, 5
#: One run in so many (by hash) loses a letter in :func:`with_slips`.
SLIP = 199


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, run): every maximal run of whole texts, with only A-Z lowered."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    lowered = F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", UPPER, LOWER))
    return found.select("doc_id", lowered.alias("run"))


def with_slips(found: DataFrame, one_in: int = SLIP) -> DataFrame:
    """(word) of :func:`runs`: where ``one_in`` divides the crc32 of ``<doc_id>:<run>``, one code point is left out."""
    hashed = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    place = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    return found.withColumn("h", hashed).select(F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run")).alias("word"))


def counted(words: DataFrame, *, least_points: int = LEAST_POINTS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough; shorter ones are gone before the shuffle."""
    return words.where(F.char_length("word") >= least_points).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _keys(word: Column, length: Column, more: int) -> Column:
    """The four keys under which a chunk word of ``length`` points meets a word with ``more`` points than it.

    The half at the start or the end stays, and of the rest its first or its last part.
    """
    half = F.floor(length / 2).cast("int")
    rest = length - half
    part, head = F.floor(rest / 2).cast("int"), F.floor(half / 2).cast("int")
    cut = lambda start, size: F.substring(word, start + 1, size)
    zero = F.lit(0)
    kept = [
        F.concat(cut(zero, half), cut(half, part)),
        F.concat(cut(zero, half), cut(half + part + more, rest - part)),
        F.concat(cut(zero, head), cut(half + more, rest)),
        F.concat(cut(head + more, half - head), cut(half + more, rest)),
    ]
    return F.array(*[F.struct(length.cast("int").alias("size"), F.lit(i).alias("kind"), k.alias("kept")) for i, k in enumerate(kept)])


def near_pairs(words: DataFrame, *, least_points: int = 2) -> DataFrame:
    """(a, na, b, nb): every two of the distinct ``words`` (word, n) with one edit between them, once.

    Words below ``least_points`` code points have no two halves and take no part (never below 2).
    """
    long = words.where(F.char_length("word") >= max(2, least_points)).withColumn("points", F.char_length("word"))
    chunks = long.select(F.col("word").alias("a"), F.col("n").alias("na"), F.inline(_keys(F.col("word"), F.col("points"), 0)))
    longer = F.when(F.col("points") > max(2, least_points), _keys(F.col("word"), F.col("points") - 1, 1)).otherwise(F.array().cast("array<struct<size:int,kind:int,kept:string>>"))
    grams = long.select(F.col("word").alias("b"), F.col("n").alias("nb"), F.inline(F.concat(_keys(F.col("word"), F.col("points"), 0), longer)))
    left, right = staged(chunks), staged(grams)
    met = left.join(right, ["size", "kind", "kept"]).where((F.col("a") < F.col("b")) | (F.char_length("a") < F.char_length("b")))
    out = staged(met.where(F.levenshtein("a", "b", 1) == 1).select("a", "na", "b", "nb").distinct())
    discard(left, right)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): pointers are doubled until none moves."""
    now = staged(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not now.where("moved").isEmpty():
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = staged(now.select("word", "root").join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(now)
        now = new
    return now.select("word", "root")


def variant_groups(words: DataFrame, *, ratio: int = RATIO, least_points: int = LEAST_POINTS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct ``words`` (word, n)."""
    words = staged(words.select("word", "n"))
    pairs = near_pairs(words, least_points=least_points)
    both = pairs.select(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("other"), F.col("nb").alias("m"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("other"), F.col("na").alias("m")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.first("n").alias("n"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("top"))
    enough = -F.col("top.m") >= ratio * F.col("n")
    near = staged(best.select("word", "n_near", F.when(enough, F.col("top.other")).alias("form"), F.when(enough, -F.col("top.m")).alias("form_n")))
    discard(pairs)
    roots = _roots(near.where("form is not null").select("word", "form"))
    out = words.join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), F.col("n").cast("long").alias("n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n"))
