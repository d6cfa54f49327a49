"""Cross-tokenizer alignment: where the tokens of two vocabularies end together, and what overlaps between.

Both encodings of a text cover the same bytes. A byte offset where a token of each ends is a cut;
the intervals between neighbouring cuts are the groups. They are found by divide and conquer: in
an interval, the ends of its A tokens are looked up among the B ends by bisection, from the middle
outwards in rings of doubling width, and the common end next to the middle splits the interval into
two halves that are treated alike; an interval without a common end inside is a leaf. All
intervals of a depth, over all texts of a block, are worked at once with numpy, so the number of
rounds is the depth of the longest text and not the number of its cuts.

A block is a run of a task's texts of about ``BLOCK_BYTES`` (one text at least, so a longer one is a
block of its own). It keeps each document's linked id pairs as positions in the block's own list
of distinct pairs, and that list with the number of documents for each. Corpus-wide counts are sums
over the lists, and travel back to blocks through a join on the pair: rows that are shuffled are
the blocks' distinct pairs, not the links. Documents are written bucketed by block and stay where they are.

Cases: a text that is null, empty, or that one vocabulary does not give back byte for byte has no
tokens: zeros, and an empty ``groups_sha256``. Repeated rows count as documents of their own, and
null ids are kept. Extra columns of the input are dropped.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, staged, staged_by
from .tokens import VOCABULARY, Encoder, vocabulary_path

PIECES = "piece_bpe_32k.model"
BLOCK_BYTES = 4 << 20
#: B ids below this; a pair of ids is a * IDS + b.
IDS = 1 << 24
_LINKS = pa.list_(pa.struct([("at", pa.int32()), ("times", pa.int32())]))
_PAIRS = pa.list_(pa.struct([("pair", pa.int64()), ("docs", pa.int64())]))
_OUT = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("links", _LINKS), ("pairs", _PAIRS)])
_SCHEMA = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<at:int,times:int>>, pairs array<struct<pair:long,docs:long>>"


class Vocabulary:
    """The bytes of every token id, as one flat array with offsets."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]) if tokens else np.zeros(0, np.int64)
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.texts = np.array([str(i) for i in range(len(tokens))], object)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ``ids`` one after another."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _byte_level() -> dict[str, int]:
    """Characters of byte-level vocabularies to bytes: printable Latin-1 stands for itself, others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class TwoTokenizers:
    """A byte-level BPE (A) that sees a space before each text, and a piece model (B) that adds that space itself."""

    def __init__(self, a_path: str | None = None, b_path: str | None = None, ranks_path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece

        self.a = Encoder(a_path or vocabulary_path(f"{VOCABULARY}.json"), ranks_path)
        self.a.library.encode_special_tokens = True
        to_byte = _byte_level()
        special = {i: t.content for i, t in self.a.library.get_added_tokens_decoder().items()}
        known = {i: t for t, i in self.a.library.get_vocab().items()}
        as_bytes = lambda i, t: t.encode() if i in special else bytes(to_byte[c] for c in t)
        self.a_bytes = Vocabulary([as_bytes(i, known[i]) if i in known else b"" for i in range(max(known) + 1)])
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path or vocabulary_path(PIECES))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = Vocabulary([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [self.a.encode_plain(" " + t) for t in texts], self.b.encode(texts, num_threads=1)


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    out = np.empty(int(sizes.sum()), np.int64)
    at = 0
    for row, n in zip(rows, sizes.tolist(), strict=True):
        out[at : at + n] = row
        at += n
    return out, np.concatenate([[0], np.cumsum(sizes)])


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[i] + 0, 1, .. sizes[i] - 1`` for each i, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _middle_cut(a_ends: np.ndarray, b_ends: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each interval, the A token in ``lo`` to ``hi`` nearest to the middle whose end is a B end, or -1."""
    found = np.full(len(lo), -1, np.int64)
    middle = (lo + hi) // 2
    open_, near, width = np.arange(len(lo)), 0, 1
    while len(open_):
        mid, low, high = middle[open_], lo[open_], hi[open_]
        left = np.maximum(low, mid - (near + width - 1))
        right = np.minimum(high, mid + (near + width - 1))
        n_left = np.maximum(0, mid - near - left + 1)
        n_right = np.maximum(0, right - (mid + max(near, 1)) + 1)
        tried = np.concatenate([_spread(left, n_left), _spread(mid + max(near, 1), n_right)])
        owner = np.concatenate([np.repeat(np.arange(len(open_)), n_left), np.repeat(np.arange(len(open_)), n_right)])
        ends = a_ends[tried]
        hit = b_ends[np.minimum(np.searchsorted(b_ends, ends), len(b_ends) - 1)] == ends
        tried, owner = tried[hit], owner[hit]
        order = np.lexsort((np.abs(tried - mid[owner]), owner))
        tried, owner = tried[order], owner[order]
        first = np.ones(len(owner), bool)
        first[1:] = owner[1:] != owner[:-1]
        found[open_[owner[first]]] = tried[first]
        more = (found[open_] < 0) & ((left > low) | (right < high))
        open_ = open_[more]
        near, width = near + width, 2 * width
    return found


def group_starts(a_ends: np.ndarray, b_ends: np.ndarray, a_first: np.ndarray, b_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first A and the first B token of every group, in order, over texts that start at ``a_first`` and ``b_first``.

    Both arrays of ends rise strictly over one axis of bytes; the last entries of the firsts are their lengths.
    """
    al, ar, bl, br = a_first[:-1], a_first[1:], b_first[:-1], b_first[1:]
    done_a, done_b = [], []
    while len(al):
        inner = (ar - al > 1) & (br - bl > 1)
        cut = np.full(len(al), -1, np.int64)
        cut[inner] = _middle_cut(a_ends, b_ends, al[inner], ar[inner] - 2)
        leaf = cut < 0
        done_a.append(al[leaf])
        done_b.append(bl[leaf])
        al, ar, bl, br, cut = (x[~leaf] for x in (al, ar, bl, br, cut))
        at = np.searchsorted(b_ends, a_ends[cut]) + 1
        al, ar, bl, br = np.concatenate([al, cut + 1]), np.concatenate([cut + 1, ar]), np.concatenate([bl, at]), np.concatenate([at, br])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_a, done_b))
    return np.sort(a), np.sort(b)


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every A and B token whose byte ranges overlap, as two arrays of positions."""
    starts = np.concatenate([[0], a_ends[:-1]])
    first = np.searchsorted(b_ends, starts, "right")
    counts = np.searchsorted(b_ends, a_ends, "left") - first + 1
    return np.repeat(np.arange(len(a_ends)), counts), _spread(first, counts)


class _Printer:
    """Groups as ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, two: TwoTokenizers):
        after = lambda texts, mark: np.array([t + mark for t in texts], object)
        a, b = two.a_bytes.texts, two.b_bytes.texts
        self.table = np.concatenate([after(a, ","), after(a, "|"), after(b, ","), after(b, ";")])
        self.n_a, self.n_b = len(a), len(b)

    def codes(self, a, b, a_starts, b_starts) -> np.ndarray:
        """Table entries of all groups in print order, A tokens of a group before its B tokens."""
        a_sizes, b_sizes = np.diff(np.append(a_starts, len(a))), np.diff(np.append(b_starts, len(b)))
        a_code, b_code = a.copy(), b + 2 * self.n_a
        a_code[a_starts + a_sizes - 1] += self.n_a
        b_code[b_starts + b_sizes - 1] += self.n_b
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.repeat(b_starts, a_sizes)] = a_code
        out[np.arange(len(b)) + np.repeat(a_starts + a_sizes, b_sizes)] = b_code
        return out

    def text(self, codes: np.ndarray) -> str:
        return "".join(self.table[codes].tolist())[:-1]


def _returned(vocabulary: Vocabulary, ids: np.ndarray, first: np.ndarray, data: list[bytes]) -> np.ndarray:
    """Which texts their ids give back byte for byte."""
    sizes = np.concatenate([[0], np.cumsum(vocabulary.sizes[ids])])[first]
    want = np.fromiter(map(len, data), np.int64, len(data))
    same = np.diff(sizes) == want
    joined = vocabulary.joined(ids)
    if same.all():
        wrong = np.concatenate([[0], np.cumsum(joined != np.frombuffer(b"".join(data), np.uint8))])
        return same & (wrong[sizes[1:]] == wrong[sizes[:-1]])
    return np.array([s and joined[sizes[i] : sizes[i + 1]].tobytes() == data[i] for i, s in enumerate(same)])


def _block(two: TwoTokenizers, printer: _Printer, number: int, doc_ids: list, texts: list) -> pa.RecordBatch:
    """One row for each document of a block, then one with the block's distinct pairs."""
    n = len(texts)
    told = [i for i in range(n) if texts[i]]
    data = [b" " + texts[i].encode() for i in told]
    a_rows, b_rows = two.encode([texts[i] for i in told]) if told else ([], [])
    good = np.ones(len(told), bool)
    for vocabulary, rows in ((two.a_bytes, a_rows), (two.b_bytes, b_rows)):
        ids, first = _flat(rows)
        good &= _returned(vocabulary, ids, first, data)
    told, a_rows, b_rows = ([x[i] for i in np.flatnonzero(good)] for x in (told, a_rows, b_rows))
    a, a_first = _flat(a_rows)
    b, b_first = _flat(b_rows)
    a_ends, b_ends = np.cumsum(two.a_bytes.sizes[a]), np.cumsum(two.b_bytes.sizes[b])
    a_starts, b_starts = group_starts(a_ends, b_ends, a_first, b_first)
    codes = printer.codes(a, b, a_starts, b_starts)
    at_a, at_b = overlaps(a_ends, b_ends)
    owner = np.searchsorted(a_first, at_a, "right") - 1
    distinct, place = np.unique(a[at_a] * IDS + b[at_b], return_inverse=True)
    keys, times = np.unique(owner * len(distinct) + place, return_counts=True)
    whose, where = (keys // len(distinct), keys % len(distinct)) if len(keys) else (keys, keys)

    columns = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
    shas: list[str | None] = [""] * n
    sizes = np.zeros(n, np.int64)
    told_at = np.array(told, np.int64)
    columns["n_a"][told_at], columns["n_b"][told_at] = np.diff(a_first), np.diff(b_first)
    columns["n_groups"][told_at] = np.diff(np.searchsorted(a_starts, a_first))
    columns["n_links"][told_at] = np.bincount(owner, minlength=len(told))
    sizes[told_at] = np.bincount(whose, minlength=len(told))
    both_first = a_first + b_first
    for k, i in enumerate(told):
        shas[i] = hashlib.sha256(printer.text(codes[both_first[k] : both_first[k + 1]]).encode()).hexdigest()
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    links = pa.ListArray.from_arrays(pa.array(np.append(offsets, offsets[-1]), pa.int32()), pa.StructArray.from_arrays([pa.array(where.astype(np.int32)), pa.array(times.astype(np.int32))], ["at", "times"]))
    listed = pa.StructArray.from_arrays([pa.array(distinct), pa.array(np.bincount(where, minlength=len(distinct)).astype(np.int64))], ["pair", "docs"])
    pairs = pa.ListArray.from_arrays(pa.array([None] * n + [0, len(distinct)], pa.int32()), listed) if n else None
    arrays = [pa.array(np.full(n + 1, number)), pa.array([*doc_ids, None], pa.int64()), *[pa.array([*v.tolist(), None], pa.int64()) for v in columns.values()], pa.array([*shas, None], pa.string()), links, pairs]
    return pa.RecordBatch.from_arrays(arrays, schema=_OUT)


def _aligner(paths: tuple, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = printer = None
        number = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                if two is None:
                    two = TwoTokenizers(*paths)
                    printer = _Printer(two)
                text = text.as_py()
                size = 4 * len(text or "") if (text and not text.isascii()) else len(text or "")
                if texts and held + size > block_bytes:
                    yield _block(two, printer, number, ids, texts)
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(doc_id)
                texts.append(text)
                held += size
        if texts:
            yield _block(two, printer, number, ids, texts)

    return run


def _scores(links: pa.Table, counts: pa.Table) -> pa.Table:
    """Per document of one block: links at their A id's highest count, and the sum of counts over links."""
    docs = np.zeros(counts.num_rows, np.int64)
    best = np.zeros(counts.num_rows, np.int64)
    at = counts["at"].to_numpy()
    docs[at], best[at] = counts["docs"].to_numpy(), counts["best"].to_numpy()
    column = links["links"].combine_chunks()
    offsets, flat = column.offsets.to_numpy(), column.values
    where, times = flat.field("at").to_numpy(), flat.field("times").to_numpy().astype(np.int64)
    totals = [np.concatenate([[0], np.cumsum(times * v[where])]) for v in (best, docs)]
    n_best, count_sum = (t[offsets[1:]] - t[offsets[:-1]] for t in totals)
    kept = links.drop_columns(["block", "links"])
    return kept.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(count_sum))


def align(docs: DataFrame, *, a_path: str | None = None, b_path: str | None = None, ranks_path: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row a document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = staged_by(rows.mapInArrow(_aligner((a_path, b_path, ranks_path), block_bytes), _SCHEMA), "block")
    listed = blocks.where("pairs is not null").select("block", F.posexplode("pairs").alias("at", "p")).select("block", "at", "p.pair", "p.docs")
    totals = listed.groupBy("pair").agg(F.sum("docs").alias("docs")).withColumn("a", F.expr(f"pair div {IDS}"))
    counted = staged(totals)
    highest = counted.groupBy("a").agg(F.max("docs").alias("most"))
    marked = staged(counted.join(highest, "a").select("pair", "docs", (F.col("docs") == F.col("most")).cast("long").alias("best")))
    back = listed.drop("docs").join(marked, "pair").select(F.col("block").alias("of_block"), F.col("at").cast("long").alias("at"), "docs", "best")
    told = blocks.where("pairs is null").drop("pairs")
    out = told.groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(_scores, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    found = staged(out)
    discard(blocks, counted, marked)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
