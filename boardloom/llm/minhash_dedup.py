"""Near-duplicate documents by min-max hashing.

Each permutation is evaluated once and gives two sketch values, its minimum and its maximum, so
64 evaluations fill a sketch of 128 values: 32 bands of 4 rows. At similarity 0.75 a pair shares
no band with probability (1 - 0.75**4)**32 = 5e-6. One byte of each value is kept as well: pairs
whose agreeing bytes lie six deviations below the threshold (1e-9) go no further, all others are
confirmed on full shingle sets.

No bucket is expanded into all its pairs:

1. Copies with equal sets are one node. A bucket's hub is the member that meets most others; every
   member is held against its hub, the most promising hub first.
2. A bucket is finished when its members other than the hub are in one component. Members of the
   other buckets (say, documents that share a passage but little else) are joined by an exact
   prefix filter: with the shingles of each set in order of rarity, a pair that reaches the
   threshold has a common shingle early in both. How early follows from both sizes, and size
   classes go into the join key. So pairs meet only under shingles that are rare among these
   members, and pairs in one component never do.

Cases: null, empty or blank text has the empty set, is linked with nothing and is kept. Fewer
than five words are one shingle. Each distinct set is a node of its own, so rows that repeat a
doc_id may be in several groups, and equal rows get equal results. Rows with a null doc_id link
like any other; component_id is the smallest doc_id that is not null (null where there is none),
and such a row is kept only where there is none. Further columns are ignored or, in
:func:`keep_representatives`, passed through; that keeps exactly one row of each group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import WordHashes, discard, split_words, splitmix, staged
from .components import connected_components

SHINGLE = 5
PERMUTATIONS = 64
ROWS_PER_BAND = 4
CHUNK = 1 << 17
#: Width of a size class: sets of one class differ by less than this factor.
SIZE_CLASS = 1.1


def _odd_constants(n: int, salt: int) -> np.ndarray:
    return splitmix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt << 32)) | np.uint64(1)


def shingle_hashes(texts, words: WordHashes, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, concatenated, and their counts."""
    listed = [split_words(t, fold=True) for t in texts]
    counts = np.fromiter(map(len, listed), np.int64, len(listed))
    flat = words.of([w for ws in listed for w in ws])
    weights = _odd_constants(size, 7)
    out: list[np.ndarray] = []
    start = 0
    for n in counts:
        own = flat[start : start + n]
        start += n
        if n == 0:
            out.append(own)
            continue
        width = min(size, int(n))
        grams = np.zeros(n - width + 1, np.uint64)
        for j in range(width):
            grams += splitmix(own[j : n - width + 1 + j] + weights[j]) * weights[j]
        grams = splitmix(grams + np.uint64(width))
        grams.sort()
        out.append(grams[np.concatenate(([True], grams[1:] != grams[:-1]))])
    sizes = np.fromiter(map(len, out), np.int64, len(out))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes


def min_max_sketch(flat: np.ndarray, sizes: np.ndarray, permutations: int) -> np.ndarray:
    """Minima, then maxima, of each permutation over each text's set (sizes must be positive)."""
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    mul, add = _odd_constants(permutations, 11), _odd_constants(permutations, 13)
    sketch = np.empty((2 * permutations, len(sizes)), np.uint64)
    for p in range(permutations):
        hashed = flat * mul[p]
        hashed += add[p]
        sketch[p] = np.minimum.reduceat(hashed, starts)
        sketch[permutations + p] = np.maximum.reduceat(hashed, starts)
    return sketch


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One row of keys for each text; a key stands for the band's number and its values."""
    bands = np.zeros((len(sketch) // rows, sketch.shape[1]), np.uint64)
    for r in range(rows):
        bands = splitmix(bands + sketch[r::rows] + np.uint64(r + 1))
    bands = splitmix(bands + np.arange(1, len(bands) + 1, dtype=np.uint64)[:, None])
    return bands.T.view(np.int64)


def _chunks(texts: list, words: WordHashes, size: int):
    """Texts in runs of about CHUNK characters: the arrays of a run stay in the CPU's cache."""
    start, load = 0, 0
    for i, t in enumerate(texts):
        load += len(t) if t else 0
        if load >= CHUNK * 6 or i == len(texts) - 1:
            yield start, *shingle_hashes(texts[start : i + 1], words, size)
            start, load = i + 1, 0


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, twin, text): twin tells rows that repeat a doc_id apart."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("twin"), text.alias("text"))


def sketches(docs: DataFrame, id_col: str, text_col: str, *, size: int, permutations: int, rows: int) -> DataFrame:
    """(doc_id, twin, n_shingles, set_a, set_b, bands, sketch): set_a and set_b are a digest of the whole set."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for batch in batches:
            texts = batch["text"].tolist()
            for start, flat, sizes in _chunks(texts, words, size):
                n = len(sizes)
                out = batch[["doc_id", "twin"]].iloc[start : start + n].reset_index(drop=True)
                full = np.flatnonzero(sizes)
                a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                bands, bytes_ = [[]] * n, [b""] * n
                if len(full):
                    starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
                    a[full] = np.add.reduceat(splitmix(flat + np.uint64(1)), starts)
                    b[full] = np.add.reduceat(splitmix(flat ^ np.uint64(0x5DEECE66D)), starts)
                    values = min_max_sketch(flat, sizes[full], permutations)
                    low = np.ascontiguousarray((values & np.uint64(255)).astype(np.uint8).T)
                    for i, keys, byte in zip(full, band_keys(values, rows), low):
                        bands[i], bytes_[i] = keys, byte.tobytes()
                yield out.assign(n_shingles=sizes, set_a=a.view(np.int64), set_b=b.view(np.int64), bands=bands, sketch=bytes_)

    return _columns(docs, id_col, text_col).mapInPandas(sketch, "doc_id long, twin long, n_shingles long, set_a long, set_b long, bands array<long>, sketch binary")


def _full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(node, grams) of the ``wanted`` (node, doc_id, twin): the whole sorted set as 64-bit words."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for batch in batches:
            nodes, texts = batch["node"].to_numpy(), batch["text"].tolist()
            for start, flat, sizes in _chunks(texts, words, size):
                ends = np.cumsum(sizes)
                grams = [flat[e - n : e].tobytes() for n, e in zip(sizes, ends)]
                yield pd.DataFrame({"node": nodes[start : start + len(sizes)], "grams": grams})

    # a shuffled join at every size: the documents may be many, and so may the wanted ids
    right = wanted.withColumnsRenamed({"doc_id": "d", "twin": "t"}).hint("shuffle_hash")
    both = _columns(docs, id_col, text_col).join(right, F.expr("doc_id <=> d and twin = t"))
    # rows that repeat an id and its text give one set
    return both.select("node", "text").mapInPandas(sets, "node long, grams binary").dropDuplicates(["node"])


def _promising(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(u, v, same) of the pairs that sizes and sketches leave open; same counts agreeing bytes."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        share = percent / 100
        for batch in batches:
            if not len(batch):
                continue
            u = np.frombuffer(b"".join(batch["u_sketch"]), np.uint8).reshape(len(batch), -1)
            v = np.frombuffer(b"".join(batch["v_sketch"]), np.uint8).reshape(len(batch), -1)
            same = (u == v).sum(axis=1)
            values = u.shape[1]
            floor = math.floor(values * share - 6 * math.sqrt(values * share * (1 - share)))
            yield batch[["u", "v"]].assign(same=same)[same >= floor]

    u = nodes.select(F.col("node").alias("u"), F.col("n_shingles").alias("u_n"), F.col("sketch").alias("u_sketch"))
    v = nodes.select(F.col("node").alias("v"), F.col("n_shingles").alias("v_n"), F.col("sketch").alias("v_sketch"))
    fits = 100 * F.least("u_n", "v_n") >= percent * F.greatest("u_n", "v_n")
    both = pairs.join(v, "v").join(u, "u").where(fits)
    return both.select("u", "v", "u_sketch", "v_sketch").mapInPandas(compare, "u long, v long, same int")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets pass ``100 * both >= percent * either``."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch["u_grams"], batch["v_grams"])):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                ok[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield batch.loc[ok, ["u", "v"]]

    u = sets.select(F.col("node").alias("u"), F.col("grams").alias("u_grams"))
    v = sets.select(F.col("node").alias("v"), F.col("grams").alias("v_grams"))
    both = pairs.select("u", "v").join(v, "v").join(u, "u").select("u", "v", "u_grams", "v_grams")
    return both.mapInPandas(judge, "u long, v long")


def _component_of(nodes: DataFrame, comps: DataFrame, name: str = "node", label: str = "component") -> DataFrame:
    """``nodes`` with the component of column ``name``; a node without a link is its own."""
    own = comps.select(F.col("node").alias(name), F.col("component").alias("__c"))
    return nodes.join(own, name, "left").withColumn(label, F.coalesce("__c", name)).drop("__c")


def _prefix_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) of ``members`` (node, component, n_shingles) in different components, by prefix filter.

    Every pair that reaches the threshold is among them. Needed overlap of sizes m and n:
    percent * (m + n) / (100 + percent).
    """

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.iloc[i : i + 256]
                n = part["grams"].str.len().to_numpy() // 8
                yield pd.DataFrame({"node": np.repeat(part["node"].to_numpy(), n), "gram": np.frombuffer(b"".join(part["grams"]), np.int64)})

    grams = sets.join(members.select("node"), "node", "left_semi").mapInPandas(explode, "node long, gram long")
    known = staged(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    by_rarity = Window.partitionBy("node").orderBy("df", "gram")
    whole = Window.partitionBy("node")
    # shingles of one member alone come first and meet nothing
    ranked = grams.join(known, "gram").select("node", "gram", F.row_number().over(by_rarity).alias("r"), F.count(F.lit(1)).over(whole).alias("k"))
    ranked = ranked.join(members, "node").withColumn("at", F.col("n_shingles") - F.col("k") + F.col("r") - 1)
    size, step = F.col("n_shingles"), math.log(SIZE_CLASS)

    def need(other):
        return F.ceil(percent * (size + other) / (100 + percent))

    own = F.floor(F.log(size.cast("double")) / step).cast("int")
    least = F.ceil(percent * size / 100)
    ranked = staged(ranked.where(F.col("at") <= size - need(least)).select("gram", "node", "component", "n_shingles", "at", own.alias("size_class")))
    # as the larger of a pair in its own class, as the smaller in each class a partner may have
    reach = F.floor(F.log(100 * size / percent) / step).cast("int")
    edge = F.floor(F.exp(F.col("class") * step) * (1 - 1e-9))
    small = ranked.withColumn("class", F.explode(F.sequence("size_class", F.greatest("size_class", reach)))).where(F.col("at") <= size - need(F.greatest(size, edge)))
    large = ranked.withColumnRenamed("size_class", "class")
    key = ["gram", "class"]
    counted = small.select(*key, "component").unionByName(large.select(*key, "component")).groupBy(*key, "component").agg(F.count(F.lit(1)).alias("n"))
    several = counted.groupBy(*key).agg(F.count(F.lit(1)).alias("parts"), F.max_by("component", F.struct("n", "component")).alias("main")).where("parts > 1").drop("parts")
    several = staged(several)
    small, large = staged(small.drop("size_class").join(several, key)), staged(large.join(several, key))
    s = small.select(*key, F.col("node").alias("u"), F.col("component").alias("u_c"), F.col("n_shingles").alias("u_n"), F.col("at").alias("u_at"), "main")
    g = large.select(*key, F.col("node").alias("v"), F.col("component").alias("v_c"), F.col("n_shingles").alias("v_n"), F.col("at").alias("v_at"))
    needed = f"ceil({percent} * (u_n + v_n) / {100 + percent})"
    fits = F.expr(f"u_c <> v_c and (u_n < v_n or (u_n = v_n and u < v)) and u_at <= u_n - {needed} and v_at <= v_n - {needed}")
    # rows of a key's main component meet only the others
    outside = s.where("u_c <> main").drop("main").join(g, key)
    inside = s.where("u_c = main").drop("main").join(large.where("component <> main").select(*key, F.col("node").alias("v"), F.col("component").alias("v_c"), F.col("n_shingles").alias("v_n"), F.col("at").alias("v_at")), key)
    pairs = staged(outside.where(fits).select("u", "v").unionByName(inside.where(fits).select("u", "v")).distinct())
    discard(known, ranked, several, small, large)
    return pairs


def near_duplicate_components(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    percent: int = 75,
    permutations: int = PERMUTATIONS,
    rows: int = ROWS_PER_BAND,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``."""
    out = _grouped(docs, id_col, text_col, size, percent, permutations, rows)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, permutations: int, rows: int) -> DataFrame:
    """(doc_id, twin, n_shingles, component_id, head) for each row of ``docs``.

    head: (doc_id, twin) of the row that stands for the group; null for an empty set.
    """
    sig = staged(sketches(docs, id_col, text_col, size=size, permutations=permutations, rows=rows))
    key = ["n_shingles", "set_a", "set_b"]
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "twin")
    nodes = sig.where("n_shingles > 0").groupBy(*key).agg(F.min(first).alias("head"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()))

    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = staged(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = staged(banded.join(sizes, "bucket"))
    score = met.groupBy("node").agg(F.sum("n").alias("score"))
    hubs = staged(met.join(score, "node").groupBy("bucket").agg(F.min_by("node", F.struct(-F.col("score"), "node")).alias("hub"), F.first("n").alias("n")))
    with_hub = met.drop("n").join(hubs, "bucket").where("node <> hub")

    tries = with_hub.select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()
    tries = staged(_promising(tries, nodes, percent))
    # whose sets are needed: both ends of these pairs, and members of buckets of three or more
    wanted = tries.select(F.col("u").alias("node")).union(tries.select("v")).union(with_hub.where("n > 2").select("node")).distinct()
    places = nodes.select("node", "head.doc_id", "head.twin")
    sets = staged(_full_sets(docs, places.join(wanted, "node"), id_col, text_col, size))

    best = staged(tries.groupBy("u").agg(F.max_by("v", F.struct("same", -F.col("v"))).alias("v")))
    links = staged(_confirmed(best, sets, percent))
    comps = connected_components(links)

    others = _component_of(_component_of(tries.join(best, ["u", "v"], "left_anti"), comps, "u", "u_c"), comps, "v", "v_c").where("u_c <> v_c")
    placed = staged(_component_of(with_hub.where("n > 2").select("bucket", "node"), comps))
    ends = placed.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b"))
    members = placed.join(ends.where("a <> b"), "bucket").select("node", "component").distinct()
    members = staged(members.join(nodes.select("node", "n_shingles"), "node"))
    more = others.select("u", "v")
    if not members.isEmpty():
        close = _prefix_pairs(members, sets, percent)
        more = more.unionByName(_promising(close, nodes, percent).select("u", "v")).distinct()
    late = staged(_confirmed(more, sets, percent))
    discard(sizes, met, hubs, tries, sets, best, placed, members)
    if not late.isEmpty():
        # links between components: their ends are few
        ends = _component_of(_component_of(late, comps, "u", "u_c"), comps, "v", "v_c")
        merged = connected_components(ends.select(F.col("u_c").alias("u"), F.col("v_c").alias("v")))
        lone = ends.select(F.col("u_c").alias("node")).union(ends.select("v_c")).distinct()
        lone = lone.join(comps.select("node"), "node", "left_anti").withColumn("component", F.col("node"))
        known = comps.unionByName(lone)
        comps = staged(_component_of(known.withColumnRenamed("component", "c"), merged, "c").select("node", "component"))

    # every component that has links, and its first row in order of doc_id
    linked = nodes.select("node", *key, "head").join(comps, "node")
    heads = linked.groupBy("component").agg(F.min("head").alias("group_head"))
    linked = linked.join(heads, "component").select(*key, "group_head")
    found = staged(nodes.select(*key, "head").join(linked, key, "left").select(*key, F.coalesce("group_head", "head").alias("head")))
    out = sig.drop("bands", "sketch").join(found, key, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("head.doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "twin", "n_shingles", component.alias("component_id"), F.when(F.col("n_shingles") > 0, F.struct("head.doc_id", "head.twin")).alias("head"))


def keep_representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = 75, permutations: int = PERMUTATIONS, rows: int = ROWS_PER_BAND) -> DataFrame:
    """One row of each group of ``docs``, that of the smallest doc_id, with all its columns.

    Rows without words stay. Of rows that repeat the doc_id and the text of a group's first row
    one stays, whichever comes first.
    """
    groups = _grouped(docs, id_col, text_col, size, percent, permutations, rows)
    heads = groups.where("head is not null").select("head.*").distinct()
    heads = staged(heads.withColumnsRenamed({"doc_id": "__doc", "twin": "__twin"}))
    text = F.col(text_col).cast("string")
    keyed = docs.withColumns({"__id": F.col(id_col).cast("long"), "__key": F.coalesce(F.xxhash64(text), F.lit(0))})
    one = keyed.join(heads.hint("shuffle_hash"), F.expr("__id <=> __doc and __key = __twin")).dropDuplicates(["__id", "__key"])
    empty = docs.where(F.coalesce(F.length(F.regexp_replace(text, "[ \\t\\n\\x0B\\f\\r]+", "")), F.lit(0)) == 0)
    return one.select(*docs.columns).unionByName(empty)
