"""Lexical retrieval packing.

Documents are tokenised once and staged. Document frequencies and the mean length are counted over
all of them (at most one row for each token id reaches the driver). Then documents are dealt to bounded
shards by content, wherever they stand in the input. PIVOTS documents with the smallest hashes are
pivots; a document's keys are its nearest pivots by the cosine of BM25 weights. A table above the
bound is split by the nearest pivot, a part still above it by the next one, a part that shares
DEPTH pivots by a hash of the document, at last by a salt (copies of one row). Small parts of a
split stand together in a shard, neighbouring pivots first.

A shard has a BM25 inverted index over token ids with the global statistics. The first unused
document seeds a window; the unused documents nearest to the seed by BM25 over all its terms follow
until the window is full. A document that does not fit is cut, and what is left of it seeds the
next window. So all windows but a shard's last are full, and the last is cut into sequences whose
lengths are powers of two, which need no padding either.

Neighbours in another shard are not found; a table within the bound is searched as a whole. Shards
and windows follow from the rows alone and not from how they lie in files. Sequence ids are unique:
the shard's number stands in their high bits. With sources, shards and windows are made source by
source (statistics still count all documents), since a window of several sources has no place in a
schedule that holds target weights; sequences then get ascending numbers along that schedule. Of
mixed documents (:func:`.mixing.mixed`) the weights are those they were mixed by, windows are seeded
in the mixed order, and the sequences of a source follow each other as the documents they begin with.

Cases: null text is empty and gives one piece, the end id alone. Repeated rows are packed like any
others. Extra columns are ignored. An empty table gives no piece. A document longer than the bound
is a shard of its own or with a few others.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, splitmix, staged
from .mixing import FILE_BITS, decided, schedule, target_weights
from .tokens import Encoder

WINDOW = 2048
END_ID = 1
SHARD_DOCS = 2048
SHARD_TOKENS = 4_000_000
PIVOTS, DEPTH = 64, 4
#: Shorter documents are pivots only if there are too few others.
PIVOT_TOKENS = 200
#: A part split by hash has parts of 1 / SPREAD of the bound on average.
SPREAD = 1.5
SHARD_BITS = 24
K1, B = 1.2, 0.75
#: A token id in one of so many documents of a shard has a row of weights there, in place of a list.
ROW_SHARE = 8
#: Used documents leave the rows once no more than this share of them is unused.
KEPT_SHARE = 0.8
NAMES = [f"k{i}" for i in range(DEPTH + 2)]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PIECE = [x.split()[0] for x in SCHEMA.split(", ")]
#: Tokens of a block of the mixed order; a window is at most that long.
BLOCK_TOKENS = 16_384


def term_counts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct token ids of a document, ascending, and how often each stands in it."""
    own = ids.astype(np.uint16)
    own.sort(kind="stable")
    new = np.empty(len(own) + 1, bool)
    new[0] = new[-1] = True
    np.not_equal(own[1:], own[:-1], out=new[1:-1])
    at = new.nonzero()[0]
    return own[at[:-1]], at[1:] - at[:-1]


class Statistics:
    """Number of documents, document frequency of each token id and mean length."""

    def __init__(self, n: int, df: np.ndarray, tokens: int):
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
        self.mean = max(1.0, tokens / max(1, n))

    def weights(self, term: np.ndarray, tf: np.ndarray, length) -> np.ndarray:
        norm = np.asarray(K1 * (1 - B + B * length / self.mean), np.float32)
        tf = tf.astype(np.float32)
        return self.idf[term] * tf * np.float32(K1 + 1) / (tf + norm)

    @classmethod
    def of(cls, docs: list[np.ndarray]) -> Statistics:
        df = np.bincount(np.concatenate([term_counts(d)[0] for d in docs]), minlength=1 << 16)
        return cls(len(docs), df, sum(map(len, docs)))


class Bm25:
    """Inverted index of a shard: for each token id, the documents that hold it and their weights.

    Frequent ids have a weight for every document, zero in those without the id: at most ROW_SHARE
    times as many as the lists would have. Sums are in double precision, in which those of single
    precision weights are exact, so neither their order nor the form of a list shows.
    """

    def __init__(self, docs: list[np.ndarray], statistics: Statistics):
        found = [term_counts(ids) for ids in docs]
        size, length = np.array([len(t) for t, _ in found]), np.array([len(d) for d in docs], np.float32)
        term, tf = np.concatenate([t for t, _ in found]), np.concatenate([c for _, c in found])
        doc = np.repeat(np.arange(len(docs), dtype=np.int32), size)
        weight = statistics.weights(term, tf, length[doc])
        self.own = np.concatenate(([0], np.cumsum(size)))
        self.term, self.n = term, len(docs)
        held = np.bincount(term, minlength=1 << 16)
        frequent = held * ROW_SHARE >= max(self.n, ROW_SHARE)
        self.row = np.where(frequent, np.cumsum(frequent) - 1, -1)
        self.rows = np.zeros((int(frequent.sum()), self.n))
        often = frequent[term]
        self.rows[self.row[term[often]], doc[often]] = weight[often]
        term, doc, weight = term[~often], doc[~often], weight[~often].astype(np.float64)
        order = np.argsort(term, kind="stable")
        self.posting_doc, self.posting_weight = doc[order], weight[order]
        self.at = np.concatenate(([0], np.cumsum(np.where(frequent, 0, held))))
        self.left = np.arange(self.n)

    def keep(self, unused: np.ndarray) -> None:
        """Give scores of unused documents alone from now on."""
        here = unused[self.left]
        self.left, self.rows = self.left[here], np.compress(here, self.rows, axis=1)

    def scores(self, d: int) -> np.ndarray:
        """BM25 of the documents that are left for all distinct terms of document d."""
        term = self.term[self.own[d] : self.own[d + 1]]
        row = self.row[term]
        ranges = [slice(self.at[t], self.at[t + 1]) for t in term[row < 0].tolist()]
        if ranges:
            docs = np.concatenate([self.posting_doc[r] for r in ranges])
            out = np.bincount(docs, np.concatenate([self.posting_weight[r] for r in ranges]), self.n)[self.left]
        else:
            out = np.zeros(len(self.left))
        for r in row[row >= 0].tolist():
            np.add(out, self.rows[r], out)
        return out


def fill_order(docs: list[np.ndarray], window: int, statistics: Statistics | None = None) -> list[int]:
    """The order in which a shard's documents enter its windows."""
    index = Bm25(docs, statistics or Statistics.of(docs))
    unused = np.ones(len(docs), bool)
    order: list[int] = []
    filled, next_seed, seed, ranked = 0, 0, -1, None
    while len(order) < len(docs):
        if seed < 0:
            while not unused[next_seed]:
                next_seed += 1
            d = seed = next_seed
        else:
            if ranked is None:
                if len(docs) - len(order) < KEPT_SHARE * len(index.left):
                    index.keep(unused)
                ranked = index.scores(seed)
                ranked[~unused[index.left]] = 0
            best = int(ranked.argmax())
            if ranked[best] <= 0:
                seed = -1
                continue
            d, ranked[best] = int(index.left[best]), 0
        order.append(d)
        unused[d] = False
        before, filled = filled // window, filled + len(docs[d])
        if filled // window > before:  # the window is full: what is left of d, or the next unused, seeds another
            seed, ranked = (d if filled % window else -1), None
        elif seed == d:
            ranked = None
    return order


def sequence_cuts(total: int, window: int) -> np.ndarray:
    """Ends of the sequences of a stream of ``total`` ids: full windows, then powers of two."""
    ends = list(range(window, total + 1, window))
    at, rest = (ends[-1] if ends else 0), total % window
    while rest:
        step = 1 << (rest.bit_length() - 1)
        at, rest = at + step, rest - step
        ends.append(at)
    return np.array(ends, np.int64)


def pack_shard(doc_ids: list, docs: list[np.ndarray], first_sequence: int, window: int = WINDOW, statistics: Statistics | None = None) -> tuple[list[tuple], int]:
    """Pieces of a shard and the number of its sequences."""
    order = fill_order(docs, window, statistics)
    ends = sequence_cuts(sum(map(len, docs)), window)
    pieces, at, s = [], 0, 0
    for d in order:
        ids, start, opened = docs[d], 0, (int(ends[s - 1]) if s else 0)
        raw = memoryview(np.ascontiguousarray(ids, np.dtype("<u4")).tobytes())
        while start < len(ids):
            n = int(min(len(ids) - start, ends[s] - at))
            pieces.append((doc_ids[d], start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), len(ids), first_sequence + s, at - opened))
            start, at = start + n, at + n
            if at == ends[s]:
                opened, s = at, s + 1
    return pieces, len(ends)


def tokenised(docs: DataFrame, vocabulary: str | None, ordered: bool = False, files: dict[str, int] | None = None) -> DataFrame:
    """doc_id, grp, ids (two bytes a token), n_tokens, h (a hash of the ids), a salt that tells equal rows apart, and the place of a row.

    Places are 0 unless ``ordered``: then by ``files`` and the columns __file and __row, or as rows come.
    """

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, done = Encoder(vocabulary), TaskContext.get().partitionId() << FILE_BITS
        if encoder.library.get_vocab_size() > 1 << 16:
            raise ValueError("token ids must fit two bytes")
        for batch in batches:
            ids = [np.append(x, END_ID).astype("<u2").tobytes() for x in encoder.encode_all(batch["text"].tolist())]
            salt = (splitmix(np.arange(done, done + len(ids), dtype=np.uint64)) >> np.uint64(1)).astype(np.int64)
            place = np.arange(done, done + len(ids)) if ordered else np.zeros(len(ids), np.int64)
            if ordered and files is not None:
                place = (batch["__file"].map(files).to_numpy(np.int64) << FILE_BITS) + batch["__row"].to_numpy(np.int64)
            done += len(ids)
            out = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "grp": batch["grp"], "ids": ids, "n_tokens": [len(x) // 2 for x in ids]})
            yield out.assign(h=[xxhash.xxh3_64_intdigest(x) >> 1 for x in ids], salt=salt, place=place)

    return staged(docs.mapInPandas(encoded, "doc_id long, grp string, ids binary, n_tokens long, h long, salt long, place long"))


def statistics_of(rows: DataFrame) -> Statistics:
    """Counted over every document: partial counts a task, summed by Spark."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for raw in batch["ids"]:
                df[np.frombuffer(raw, "<u2")] += 1  # once for each distinct id: NumPy reads before it adds
        term = np.flatnonzero(df)
        yield pd.DataFrame({"term": term, "n": df[term]})

    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).first()
    df = np.zeros(1 << 16, np.int64)
    for r in rows.select("ids").mapInPandas(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r["term"]] = r["n"]
    return Statistics(total["n"], df, total["tokens"])


def pivots_of(rows: DataFrame) -> list[np.ndarray]:
    """Token ids of the pivots: distinct texts, long ones first, by their hashes."""

    short = F.col("n_tokens") < PIVOT_TOKENS
    best = [r["h"] for r in rows.select(short.alias("short"), "h").distinct().orderBy("short", "h").limit(PIVOTS).collect()]
    ids = {r["h"]: r["ids"] for r in rows.where(F.col("h").isin(best)).select("h", "ids").dropDuplicates(["h"]).collect()}
    return [np.frombuffer(ids[h], "<u2") for h in best]


class Keys:
    """What documents are dealt by: DEPTH nearest pivots, a hash of the row, its salt."""

    def __init__(self, pivots: list[np.ndarray], statistics: Statistics):
        self.statistics, self.table = statistics, None
        self.pivots = [self.weighted(p) for p in pivots]
        near, order = np.array([self.cosines(t, w) for t, w in self.pivots]), list(range(len(pivots)))
        for i in range(1, len(order)):  # a chain in which neighbours are alike
            order[i:] = sorted(order[i:], key=lambda j: (-near[order[i - 1], j], j))
        self.pivots, self.table = [self.pivots[j] for j in order], None

    def weighted(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        term, tf = term_counts(ids)
        weight = self.statistics.weights(term, tf, len(ids))
        return term, weight / max(np.sqrt(weight @ weight), np.float32(1e-9))

    def cosines(self, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        if self.table is None:
            self.table = np.zeros((1 << 16, len(self.pivots)), np.float32)
            for j, (t, w) in enumerate(self.pivots):
                self.table[t, j] = w
        return weight @ self.table[term]

    def of(self, batch: pd.DataFrame) -> np.ndarray:
        keys = np.zeros((len(batch), DEPTH + 2), np.int64)
        for i, (doc_id, raw, salt) in enumerate(zip(batch["doc_id"], batch["ids"], batch["salt"])):
            near = np.argsort(-self.cosines(*self.weighted(np.frombuffer(raw, "<u2"))), kind="stable")[:DEPTH]
            keys[i, : len(near)] = near
            keys[i, DEPTH] = xxhash.xxh3_64_intdigest(raw, 0 if pd.isna(doc_id) else int(doc_id) & (2**64 - 1)) >> 1
            keys[i, DEPTH + 1] = salt
        return keys

    def __getstate__(self):
        return self.__dict__ | {"table": None}


def keyed(rows: DataFrame, keys: Keys) -> DataFrame:
    """``rows`` with their keys and load, staged: keys are worked out once."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            load = np.maximum(batch["n_tokens"].to_numpy(), -(-SHARD_TOKENS // SHARD_DOCS))
            out = batch[["doc_id", "grp", "ids", "place"]].assign(load=load)
            out[NAMES] = keys.of(batch)
            yield out

    return staged(rows.mapInPandas(add, "doc_id long, grp string, ids binary, place long, load long, " + ", ".join(f"{k} long" for k in NAMES)))


def dealt(part: DataFrame) -> tuple[dict, dict]:
    """How parts are split, {(grp, path): n}, and the shard of each part, {(grp, path): number}.

    n is 0 for a split by pivots. Both have at most some PIVOTS rows for each full shard and one
    for each ``grp``, so they fit the driver.
    """
    spark = part.sparkSession
    part = part.select("grp", "load", *NAMES).withColumns({"parent": F.lit(""), "step": F.lit(0).cast("long")})
    splits, shards, number = {}, {}, 0
    for depth in range(len(NAMES) + 1):
        nodes = part.groupBy("grp", "parent", "step").agg(F.sum("load").alias("load")).collect()
        hot, above, filled = [], None, 0
        for r in sorted(nodes, key=lambda r: (r["grp"], r["parent"], r["step"])):
            node = (r["grp"], f"{r['parent']}/{r['step']}")
            if r["load"] > SHARD_TOKENS and depth < len(NAMES):
                splits[node] = math.ceil(SPREAD * r["load"] / SHARD_TOKENS) if depth >= DEPTH else 0
                hot.append((r["grp"], r["parent"], r["step"], node[1], splits[node]))
                continue
            filled += r["load"]
            if (r["grp"], r["parent"]) != above or filled > SHARD_TOKENS:
                number, above, filled = number + 1, (r["grp"], r["parent"]), r["load"]
            shards[node] = number
        if not hot:
            break
        ways = spark.createDataFrame(hot, "grp string, parent string, step long, path string, n long")
        key = F.col(NAMES[depth]) if depth < DEPTH else F.col(NAMES[depth]) % F.col("n")
        part = part.join(F.broadcast(ways), ["grp", "parent", "step"]).withColumns({"parent": F.col("path"), "step": key}).drop("path", "n")
    return splits, shards


def sharded(rows: DataFrame, statistics: Statistics) -> DataFrame:
    """``rows`` with the number of each document's shard."""
    part = keyed(rows, Keys(pivots_of(rows), statistics))
    discard(rows)
    splits, shards = dealt(part)

    @F.pandas_udf("long")
    def shard(rows: pd.DataFrame) -> pd.Series:  # keys alone go to Python, not the ids
        found = []
        for grp, own in zip(rows["grp"], rows[NAMES].to_numpy().tolist()):
            path, left = "/0", iter(own)
            while (n := splits.get((grp, path))) is not None:
                key = next(left)
                path = f"{path}/{key % n if n else key}"
            found.append(shards[grp, path])
        return pd.Series(found, dtype="int64")

    return part.select("doc_id", "grp", "ids", "place", shard(F.struct("grp", *NAMES)).alias("shard"))


def in_mixed_order(pieces: DataFrame, weights: dict[str, float], ordered: bool = False) -> DataFrame:
    """Number sequences by their place in the Pfair schedule of their sources, and sort by it.

    ``ordered`` takes the sequences of a source by the places of the documents they begin with.
    A slot has one block of one source, and a sequence belongs to the block in which it starts, so
    slot and offset make the number; numbers ascend along the schedule and leave gaps.
    """
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sequences = pieces.groupBy("grp", "sequence_id").agg(F.sum("length").alias("tokens"), F.min_by("place", "offset").alias("place"))
    placed = schedule(sequences, weights=weights, id_col="sequence_id", text_col="tokens", size_col="tokens", source_col="grp", block_chars=BLOCK_TOKENS, order_col="place" if ordered else None)
    number = placed.select("sequence_id", (F.col("slot") * BLOCK_TOKENS + F.col("block_offset")).alias("number"))
    out = pieces.join(number, "sequence_id").withColumn("sequence_id", F.col("number")).select(*PIECE)
    return out.repartitionByRange(n, "sequence_id").sortWithinPartitions("sequence_id", "offset")


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = None, window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """One row for each piece: which ids of which document stand where in which sequence.

    With ``source_col`` a sequence has documents of one source, and sequences follow the schedule of
    :mod:`.mixing`: with the weights and the order of mixed documents, else with its default ones. ``vocabulary`` is the path of the tokenizer file, on
    every executor; by default the public one.
    """
    if window & (window - 1) or source_col is not None and window > BLOCK_TOKENS:
        raise ValueError("the window must be a power of two, and no longer than a block of the mixed order")
    grp = F.lit("") if source_col is None else F.coalesce(F.col(source_col).cast("string"), F.lit("\0"))
    weights = files = None
    if source_col is not None:
        docs, weights, files = decided(docs, source_col)
    ordered = weights is not None
    where = ["__file", "__row"] if files is not None else []
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), grp.alias("grp"), *where)
    rows = tokenised(cols, vocabulary, ordered, files)
    statistics = statistics_of(rows)

    def packed(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.assign(doc_id=shard["doc_id"].astype("Int64")).sort_values(["place", "doc_id", "ids"])
        ids = [np.frombuffer(raw, "<u2") for raw in shard["ids"]]
        pieces, _ = pack_shard(list(range(len(ids))), ids, int(shard["shard"].iloc[0]) << SHARD_BITS, window, statistics)
        out = pd.DataFrame(pieces, columns=PIECE)
        own = out["doc_id"].to_numpy()
        return out.assign(doc_id=shard["doc_id"].array[own], grp=shard["grp"].iloc[0], place=shard["place"].to_numpy()[own])

    pieces = sharded(rows, statistics).groupBy("shard").applyInPandas(packed, f"{SCHEMA}, grp string, place long")
    if source_col is None:
        return pieces.select(*PIECE)
    return in_mixed_order(staged(pieces), weights if ordered else target_weights(docs, source_col, text_col), ordered)
