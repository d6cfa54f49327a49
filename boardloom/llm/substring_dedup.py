"""Substring dedup: word windows that start earlier elsewhere, found with FM-index shards.

A window is ``width`` consecutive words. A word goes when a window that covers it has a word
sequence that also starts earlier (smaller doc_id, or same document and earlier start).

Documents can't be streamed against the index of every shard: that is quadratic. Here the text is
cut so that equal windows always meet in one shard. The anchor of a window is the smallest hash
of its ``gram``-word runs; neighbouring windows with one anchor form a segment. An anchor that
occurs once in the corpus can't lie in a repeated window, so its segments are done. Of the others
only places and digests are shuffled; equal segments (anchor and 64-bit digest of the words) fall
together on their earliest place by partial aggregation, so thousands of copies cost one row each
task. Each shard gets the words of its distinct segments once, builds an FM-index over them, and
streams them against it: backward search over the wavelet matrix gives the matching statistics of
every position up to ``width``, and where they reach it the suffix interval lists all places of
the window, of which the earliest stays. An anchor with one distinct segment needs no search. An
anchor with more distinct segments than a shard takes (a common passage in very many contexts) is
split: its distinct segments become single windows, grouped by 128-bit digests.

Cases: null, empty or blank text has no words. Rows that repeat a doc_id are told apart by their
text, the smaller hash being earlier; equal rows are one document and get equal results. Rows
with a null doc_id count as later than all others.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LAST_ID, WordHashes, discard, split_words, splitmix, staged, staged_by
from .fm_index import FmIndex

WIDTH = 20
GRAM = 6
SHARD_WORDS = 150_000
#: Distinct segments of an anchor that one shard takes.
HOT_SEGMENTS = 2_000


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every run of ``size`` neighbours."""
    have, step = x, 1
    while 2 * step <= size:
        have, step = np.minimum(have[:-step], have[step:]), 2 * step
    rest = size - step
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


class RollingDigests:
    """Digests of any runs of words from two prefix sums of word hashes times powers of an odd base."""

    BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

    def __init__(self):
        self.powers = [np.ones(1, np.uint64) for _ in self.BASES]
        self.inverse = [np.ones(1, np.uint64) for _ in self.BASES]

    def of(self, own: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: int = 0) -> np.ndarray:
        n, base = len(own), self.BASES[which]
        if len(self.powers[which]) <= n:
            for table, factor in ((self.powers, base), (self.inverse, pow(base, -1, 1 << 64))):
                steps = np.full(2 * n + 1, factor, np.uint64)
                steps[0] = 1
                table[which] = np.multiply.accumulate(steps)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(own * self.powers[which][:n])))
        got = (sums[starts + sizes] - sums[starts]) * self.inverse[which][starts]
        return splitmix(got + sizes.astype(np.uint64)).view(np.int64)


def segments(own: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first word, number of words) of each segment of a document, from its word hashes."""
    n = len(own)
    if n < width:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    mixed = np.zeros(n - gram + 1, np.uint64)
    for j in range(gram):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + own[j : n - gram + 1 + j]
    mixed = splitmix(mixed)
    least = sliding_min(mixed, width - gram + 1)
    # a segment ends where the anchor changes or its occurrence leaves the window, so that equal
    # windows inside one document lie in different segments
    cut = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (least[:-1] == mixed[: len(least) - 1]))))
    ends = np.append(cut[1:], len(least))
    return least[cut].view(np.int64), cut, ends - cut + width - 1


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc"), F.xxhash64(text).alias("twin"), text.alias("text"))


def _document_rows(docs: DataFrame, id_col: str, text_col: str, width: int, gram: int) -> DataFrame:
    """One row for each document: word count, digest of the whole word list, its segments."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, digests = WordHashes(), RollingDigests()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                words = split_words(text)
                own = hashes.of(words)
                anchors, starts, sizes = segments(own, width, gram)
                rows.append((len(words), hashlib.sha256(b" ".join(words)).hexdigest(), anchors, starts, sizes, digests.of(own, starts, sizes)))
            out = pd.DataFrame(rows, columns=["n_words", "whole_sha256", "anchors", "starts", "sizes", "digests"])
            yield out.assign(doc=batch["doc"].to_numpy(), twin=batch["twin"].to_numpy())

    schema = "doc long, twin long, n_words long, whole_sha256 string, anchors array<long>, starts array<int>, sizes array<int>, digests array<long>"
    return _keyed(docs, id_col, text_col).mapInPandas(scan, schema)


def _contents(chosen: DataFrame, width: int) -> DataFrame:
    """The words of chosen segments, and of hot ones the digest of each window instead.

    (doc, twin, anchor, start, content, a, b): content is null in a window's row.
    """
    columns = ["doc", "twin", "anchor", "start", "content", "a", "b"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, digests = WordHashes(), RollingDigests()
        for batch in batches:
            rows: list[tuple] = []
            for doc, twin, text, anchors, starts, sizes, hot in zip(*[batch[c] for c in ("doc", "twin", "text", "anchors", "starts", "sizes", "hot")]):
                words = split_words(text)
                own = hashes.of(words) if hot.any() else None
                for anchor, i, n, split in zip(anchors.tolist(), starts.tolist(), sizes.tolist(), hot.tolist()):
                    if split:
                        at, w = np.arange(i, i + n - width + 1), np.full(n - width + 1, width)
                        found = zip(at.tolist(), digests.of(own, at, w).tolist(), digests.of(own, at, w, 1).tolist())
                        rows += [(doc, twin, anchor, j, None, x, y) for j, x, y in found]
                    else:
                        rows.append((doc, twin, anchor, i, b" ".join(words[i : i + n]), 0, 0))
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    return chosen.mapInPandas(cut, "doc long, twin long, anchor long, start int, content binary, a long, b long")


def late_windows(contents: list[bytes], places: np.ndarray, width: int) -> list[np.ndarray]:
    """For each distinct segment, the window offsets at which its earliest place is not the window's first.

    ``places`` are sortable (doc, twin, start) triples, one a segment.
    """
    seen: dict[bytes, int] = {}
    split = [c.split() for c in contents]
    sizes = np.array([len(w) for w in split])
    text = np.zeros(int(sizes.sum()) + len(sizes) + 1, np.int64)  # a separator before each segment and at the end
    begins = 1 + np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    for b, words in zip(begins, split):
        text[b : b + len(words)] = [seen.setdefault(w, len(seen) + 1) for w in words]
    index = FmIndex(text, len(seen) + 1, width)
    windows = sizes - width + 1
    segment = np.repeat(np.arange(len(sizes)), windows)
    offset = np.arange(len(segment)) - np.repeat(np.cumsum(windows) - windows, windows)
    reached, low, high = index.matching(begins[segment] + offset + width, width)

    # the earliest place of every suffix's start, as an order-keeping number
    doc, twin, start = places[:, 0][segment], places[:, 1][segment], places[:, 2][segment] + offset
    rank = np.empty(len(segment), np.int64)
    by_place = np.lexsort((start, twin, doc))
    d, t, s = doc[by_place], twin[by_place], start[by_place]
    rank[by_place] = np.concatenate(([0], np.cumsum((d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (s[1:] != s[:-1]))))
    of_suffix = np.full(len(text), np.iinfo(np.int64).max)
    of_suffix[begins[segment] + offset] = rank
    in_order = of_suffix[index.order]
    intervals, back = np.unique(low * (len(text) + 1) + high, return_inverse=True)
    lows, highs = intervals // (len(text) + 1), intervals % (len(text) + 1)
    edges = np.stack((lows, highs), axis=1).ravel()
    least = np.minimum.reduceat(np.append(in_order, np.iinfo(np.int64).max), edges)[::2]
    late = (reached == width) & (rank > least[back])
    return [offset[a:b][late[a:b]] for a, b in zip(np.cumsum(windows) - windows, np.cumsum(windows))]


def removed_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, firsts, ends, twin), one row for each document.

    ``firsts`` and ``ends`` list the removed word ranges [first, end); twin is a hash of the text.
    """
    rows = staged(_document_rows(docs, id_col, text_col, width, gram))
    # rows that repeat an id and its text are one document here
    zipped = F.explode(F.arrays_zip("anchors", "starts", "sizes", "digests")).alias("s")
    parts = rows.where(F.size("anchors") > 0).select("doc", "twin", zipped).select("doc", "twin", F.col("s.anchors").alias("anchor"), F.col("s.digests").alias("digest"), F.col("s.starts").alias("start"), F.col("s.sizes").alias("size"))
    key = ["anchor", "digest"]
    place = F.struct("doc", "twin", "start")
    heads = parts.groupBy(*key).agg(F.min(place).alias("head"), F.max(place).alias("last"), F.first("size").alias("size"))
    heads = staged(heads.select(*key, "head", "size", (F.col("head") != F.col("last")).alias("repeated")))
    several = staged(heads.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))

    # the earliest copy of a segment may lose windows; every other copy loses all of it
    again = staged(heads.where("repeated").select(*key, "head", "size"))
    later = parts.drop("size").join(again, key).where(place != F.col("head"))

    def spans(first, end):
        return F.struct(first.cast("int").alias("first"), end.cast("int").alias("end")).alias("cut")

    later = staged(later.select("doc", "twin", spans(F.col("start"), F.col("start") + F.col("size"))).groupBy("doc", "twin").agg(F.collect_list("cut").alias("cuts")))
    picked = heads.select("anchor", "head.*", "size").join(several, "anchor").select("doc", "twin", F.struct("anchor", "start", "size", (F.col("n") > HOT_SEGMENTS).alias("hot")).alias("s"))
    picked = staged(picked.groupBy("doc", "twin").agg(F.collect_list("s").alias("picked")))
    discard(heads, several, again)

    # the texts that are cut or searched, dealt once for both
    touched = later.select("doc", "twin").union(picked.select("doc", "twin")).distinct()
    texts = staged_by(_keyed(docs, id_col, text_col).join(touched, ["doc", "twin"]), "doc", "twin")
    each = lambda c: F.expr(f"transform(picked, s -> s.{c})")
    asked = texts.join(picked, ["doc", "twin"]).select("doc", "twin", "text", each("anchor").alias("anchors"), each("start").alias("starts"), each("size").alias("sizes"), each("hot").alias("hot"))
    contents = staged(_contents(asked, width))

    whole = contents.where("content is not null")
    load = whole.agg(F.sum(F.length("content"))).first()[0] or 0
    shards = max(1, math.ceil(load / 6 / SHARD_WORDS))
    dealt = whole.select("content", "doc", "twin", "start", F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"))

    def search(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.reset_index(drop=True)
        late = late_windows(shard["content"].tolist(), shard[["doc", "twin", "start"]].to_numpy(np.int64), width)
        return shard[["doc", "twin", "start"]].assign(late=late)

    found = dealt.groupBy("shard").applyInPandas(search, "doc long, twin long, start int, late array<int>").where(F.size("late") > 0)
    first = found.select("doc", "twin", F.transform("late", lambda o: spans(F.col("start") + o, F.col("start") + o + width)).alias("cuts"))

    windows = contents.where("content is null").select("doc", "twin", "start", "a", "b")
    earliest = staged(windows.groupBy("a", "b").agg(F.min(place).alias("least"), F.max(place).alias("last")).where("least <> last").drop("last"))
    single = windows.join(earliest, ["a", "b"]).where(place != F.col("least")).select("doc", "twin", F.array(spans(F.col("start"), F.col("start") + width)).alias("cuts"))
    cuts = first.unionByName(single).unionByName(later).groupBy("doc", "twin").agg(F.flatten(F.collect_list("cuts")).alias("cuts"))
    cuts = staged(cuts.select("doc", "twin", F.expr("transform(cuts, c -> c.first)").alias("firsts"), F.expr("transform(cuts, c -> c.end)").alias("ends")))
    discard(picked, contents, earliest, later)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, firsts, ends in zip(batch["text"], batch["firsts"], batch["ends"]):
                words = split_words(text)
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, firsts, 1)
                np.add.at(gone, ends, -1)
                gone = np.cumsum(gone)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                out.append((int(gone.sum()), hashlib.sha256(kept).hexdigest(), edge[::2], edge[1::2]))
            got = pd.DataFrame(out, columns=["n_removed", "kept_sha256", "firsts", "ends"])
            yield got.assign(doc=batch["doc"].to_numpy(), twin=batch["twin"].to_numpy())

    changed = texts.join(cuts, ["doc", "twin"]).mapInPandas(apply, "doc long, twin long, n_removed long, kept_sha256 string, firsts array<int>, ends array<int>")
    changed = staged(changed.dropDuplicates(["doc", "twin"]))
    discard(texts, cuts)
    out = rows.select("doc", "twin", "n_words", "whole_sha256").join(changed, ["doc", "twin"], "left")
    doc = F.when(F.col("doc") != LAST_ID, F.col("doc")).alias("doc_id")
    return out.select(doc, "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"), "firsts", "ends", "twin")


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` whose texts are their kept words joined by one space; untouched texts stay as they are."""
    cut = removed_words(docs, id_col=id_col, text_col=text_col, width=width).where("n_removed > 0")
    doc = F.coalesce("doc_id", F.lit(LAST_ID)).alias("__doc")
    found = staged(cut.select(doc, F.col("twin").alias("__twin"), F.col("firsts").alias("__firsts"), F.col("ends").alias("__ends")).dropDuplicates(["__doc", "__twin"]))

    @F.pandas_udf("string")
    def kept(texts: pd.Series, firsts: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for text, own_firsts, own_ends in zip(texts, firsts, ends):
            if own_firsts is None:
                out.append(text)
                continue
            words, at, left = split_words(text), 0, []
            for first, end in zip(own_firsts, own_ends):
                left += words[at:first]
                at = end
            out.append(b" ".join(left + words[at:]).decode())
        return pd.Series(out)

    keyed = docs.withColumns({"__doc": F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)), "__twin": F.xxhash64(F.col(text_col).cast("string"))})
    joined = keyed.join(found, ["__doc", "__twin"], "left")
    return joined.withColumn(text_col, kept(F.col(text_col).cast("string"), F.col("__firsts"), F.col("__ends"))).select(*docs.columns)
