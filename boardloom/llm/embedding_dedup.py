"""Near-duplicate vectors by a subspace pigeonhole join.

Vectors are scaled to length one; a cosine of at least ``least`` is then a squared distance of at
most ``2 - 2 * least``. A rotation fixed by a seed spreads the variance evenly, and the rotated
vector is split into blocks of 8 dimensions. A block's budget is its share of the squared distance;
two vectors over budget in every block are over it in all, so a pair that links is within budget in
at least one block. Each block is range-joined on its own:

* A grid over a block's first two dimensions, with cells as wide as twice the radius, deals rows to
  cells. A row lies in its own cell and, where its ball reaches over, in cells that come after it
  in order; two rows within the radius so meet in just one cell.
* Rows of a cell are dealt to tiles by hash and tiles meet in pairs, so that no task takes more than
  two tiles, however many rows a cell or a label has.
* In a task the rows of a tile are halved along their widest dimension until few are left, and each
  half keeps only rows of the other tile that its box can reach. Those within the block's budget are
  verified by their cosine in double precision.

A pair within budget in several blocks counts in the first. A task returns, for each of its rows, the
number of links and a root of the links among its rows (a spanning forest), so no pair is ever
written. Equal vectors of a label are one row with a count.

On isotropic vectors a cosine of 0.98 is not much smaller than the spread of a block of few
dimensions, so the grid alone leaves about two fifths of a label's pairs to each block; the boxes
then drop most of them. Work inside one label therefore still grows with its square, at a few
nanoseconds a pair.

Cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows without a
label, link with nothing and form groups of their own. Vectors of different length never meet. A
null id counts as later than all others; repeated rows are vectors of their own that link with each
other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import LAST_ID, discard, staged
from .components import connected_components

LEAST = 0.98
BLOCK = 8
GRID = 2
TILE = 4096
SEED = 20
#: Pairs compared at once within a task.
LEAF = 1 << 15
SLACK = 1e-5
_HOME, _GUEST = 0, 1
_ROTATIONS: dict[int, np.ndarray] = {}
_DEALT = pa.schema([("node", pa.int64()), ("copies", pa.int64()), ("label", pa.string()), ("dims", pa.int32()), ("block", pa.int32()), ("cell", pa.int64()), ("guest", pa.int32())])
_DEALT_SQL = "node long, copies long, label string, dims int, block int, cell long, guest int, raw array<{kind}>, turned array<float>"


def rotation(dims: int) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    if dims not in _ROTATIONS:
        q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))
        _ROTATIONS[dims] = q * np.sign(np.diag(r))
    return _ROTATIONS[dims]


def blocks_of(dims: int) -> list[slice]:
    return [slice(i, min(i + BLOCK, dims)) for i in range(0, dims, BLOCK)]


def budget(dims: int, block: slice, least: float) -> float:
    """A block's share of the squared distance; the slack covers single-precision coordinates."""
    return (2 - 2 * least) * (block.stop - block.start) / dims * (1 + SLACK) + 1e-9


def _unit(raw: np.ndarray) -> np.ndarray:
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _cells(points: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, guest) for points of one or two dimensions: their own cells, and later ones that their balls reach."""
    width = 2 * radius
    grid = points[:, :GRID].astype(np.float64)
    home = np.floor(grid / width).astype(np.int64)
    low, high = np.floor((grid - radius) / width).astype(np.int64), np.floor((grid + radius) / width).astype(np.int64)
    code = lambda c: c[:, 0] * (1 << 31) + (c[:, 1] if c.shape[1] > 1 else 0)
    own = code(home)
    rows, cells, guests = [np.arange(len(points))], [own], [np.zeros(len(points), np.int32)]
    steps = np.stack(np.meshgrid(*[[-1, 0, 1]] * grid.shape[1], indexing="ij"), -1).reshape(-1, grid.shape[1])
    for step in steps:
        there = home + step
        reached = ((there >= low) & (there <= high)).all(axis=1) & (code(there) > own)
        rows.append(np.flatnonzero(reached))
        cells.append(code(there)[reached])
        guests.append(np.ones(reached.sum(), np.int32))
    return np.concatenate(rows), np.concatenate(cells), np.concatenate(guests)


def _dealer(least: float, kind: str):
    """Rows for the cells of every block; ``raw`` goes along in the input's own precision (``kind``)."""
    own = pa.float32() if kind == "float" else pa.float64()
    schema = _DEALT.append(pa.field("raw", pa.list_(own))).append(pa.field("turned", pa.list_(pa.float32())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            for dims, part in frame.groupby("dims", sort=False):
                raw = np.stack(part["raw"].to_numpy()).astype(np.float64)
                turned = (_unit(raw) @ rotation(int(dims))).astype(np.float32)
                for b, block in enumerate(blocks_of(int(dims))):
                    rows, cells, guests = _cells(turned[:, block], np.sqrt(budget(int(dims), block, least)))
                    n = len(rows)
                    lists = [pa.FixedSizeListArray.from_arrays(pa.array(x[rows].ravel()), int(dims)).cast(pa.list_(of)) for x, of in ((raw.astype(own.to_pandas_dtype()), own), (turned, pa.float32()))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part["node"].to_numpy()[rows]), pa.array(part["copies"].to_numpy()[rows]), pa.array(part["label"].to_numpy()[rows], pa.string()), pa.array(np.full(n, dims, np.int32)), pa.array(np.full(n, b, np.int32)), pa.array(cells), pa.array(guests), *lists], schema=schema
                    )

    return run


def _squares(x: np.ndarray, y: np.ndarray, block: slice) -> np.ndarray:
    """Squared distances of paired rows in one block, summed in a fixed order so that every task gets the same value."""
    out = np.zeros(len(x))
    for d in range(block.start, block.stop):
        step = x[:, d].astype(np.float64) - y[:, d]
        out += step * step
    return out


def _leaves(x: np.ndarray, y: np.ndarray, radius: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index sets of the two sides that hold all pairs within ``radius``; each pair is in one of them."""
    todo = [(np.arange(len(x)), np.arange(len(y)))]
    while todo:
        left, right = todo.pop()
        if not len(left) or not len(right):
            continue
        low, high = x[left].min(axis=0), x[left].max(axis=0)
        near = ((y[right] >= low - radius) & (y[right] <= high + radius)).all(axis=1)
        right = right[near & (right > left.min())] if same else right[near]
        if len(left) * len(right) <= LEAF or len(left) <= 16:
            size = max(1, LEAF // len(left))
            for i in range(0, len(right), size):
                yield left, right[i : i + size]
            continue
        widest = int((high - low).argmax())
        order = left[np.argsort(x[left, widest], kind="stable")]
        todo += [(order[: len(order) // 2], right), (order[len(order) // 2 :], right)]


def _links(raw, turned, first: np.ndarray, second: np.ndarray | None, dims: int, number: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (positions) between two sets of rows, or within one, that count in block ``number``."""
    blocks = blocks_of(dims)
    block = blocks[number]
    limit = budget(dims, block, least)
    radius = np.float32(np.sqrt(limit) * (1 + SLACK))
    other = first if second is None else second
    x, y = turned[first][:, block], turned[other][:, block]
    x2, y2 = (x * x).sum(axis=1), (y * y).sum(axis=1)
    out = [[], []]
    for left, right in _leaves(x, y, radius, second is None):
        rough = x2[left, None] + y2[None, right] - 2 * (x[left] @ y[right].T)
        i, j = np.nonzero(rough <= limit * 1.01 + 1e-5)
        i, j = left[i], right[j]
        if second is None:
            up = i < j
            i, j = i[up], j[up]
        i, j = first[i], other[j]
        within = _squares(turned[i], turned[j], block) <= limit
        i, j = i[within], j[within]
        for earlier in blocks[:number]:
            later = _squares(turned[i], turned[j], earlier) > budget(dims, earlier, least)
            i, j = i[later], j[later]
        a, b = raw[i], raw[j]
        cosine = np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
        out[0].append(i[cosine >= least])
        out[1].append(j[cosine >= least])
    return tuple(np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position linked with each of ``n`` positions, at any number of steps."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


_FOUND_SQL = "node long, links long, root long"


def _judge(least: float):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        dims, number, p, q = (key[k].as_py() for k in (1, 2, 4, 5))
        n = rows.num_rows
        flat = lambda name: rows[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, dims)
        raw, turned, tile = flat("raw"), flat("turned"), rows["tile"].to_numpy()
        raw = raw.astype(np.float64)
        raw /= np.abs(raw).max(axis=1, keepdims=True)
        first = np.flatnonzero(tile == p)
        i, j = _links(raw, turned, first, None if p == q else np.flatnonzero(tile == q), dims, number, least)
        copies, node = rows["copies"].to_numpy(), rows["node"].to_numpy()
        links = (np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)).astype(np.int64)
        some = np.flatnonzero(links)
        root = node[_roots(n, i, j)]
        return pa.table({"node": node[some], "links": links[some], "root": root[some]})

    return run


def _usable() -> Column:
    """Whether a vector has components, all finite, and one that isn't zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.col("label").isNotNull() & F.coalesce((F.size("vector") > 0) & F.forall("vector", fine) & F.exists("vector", lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, *, least: float = LEAST, vector_col: str = "embedding", tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row a vector."""
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), vector.alias("vector"))
    rows = staged(rows.withColumn("vector", F.when(_usable(), F.col("vector"))).withColumn("row", F.monotonically_increasing_id()))
    kinds = rows.where("vector is not null").groupBy("label", "vector").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"))
    kinds = staged(kinds.withColumn("dims", F.size("vector")))
    dealt = staged(kinds.select("node", "copies", "label", "dims", F.col("vector").alias("raw")).mapInArrow(_dealer(least, kind), _DEALT_SQL.format(kind=kind)))
    cell = ["label", "dims", "block", "cell"]
    sizes = dealt.groupBy(*cell).agg(F.count_if(F.col("guest") == _HOME).alias("home"), F.count_if(F.col("guest") == _GUEST).alias("away"))
    tiles = lambda c: F.ceil(F.col(c) / tile).cast("int")
    sizes = staged(sizes.where("home > 0 and home + away > 1").select(*cell, tiles("home").alias("h"), tiles("away").alias("g")))
    placed = dealt.join(sizes, cell)
    own = F.pmod(F.xxhash64("node"), F.when(F.col("guest") == _HOME, F.col("h")).otherwise(F.col("g"))).cast("int")
    placed = placed.withColumn("tile", own + F.when(F.col("guest") == _GUEST, F.col("h")).otherwise(0))
    meet = lambda p, q: F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"))
    here = F.col("tile")
    ahead = F.transform(F.sequence(here, F.col("h") + F.col("g") - 1), lambda q: meet(here, q))
    behind = F.when(here > 0, F.transform(F.sequence(F.lit(0), here - 1), lambda p: meet(p, here)))
    guests = F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda p: meet(p, here))
    pairs = F.when(F.col("guest") == _GUEST, guests).otherwise(F.concat(ahead, F.coalesce(behind, F.array().cast("array<struct<p:int,q:int>>"))))
    met = placed.select("node", "copies", *cell, "raw", "turned", "tile", F.inline(pairs))
    found = staged(met.groupBy(*cell, "p", "q").applyInArrow(_judge(least), _FOUND_SQL))

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = connected_components(found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    of_kind = staged(kinds.join(links, "node", "left").join(groups, "node", "left").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")))
    told = staged(rows.where("vector is not null").join(of_kind, ["label", "vector"]).select("vec_id", "row", "n_links", "component"))
    least_id = told.groupBy("component").agg(F.min(F.coalesce("vec_id", F.lit(LAST_ID))).alias("first"))
    named = told.join(least_id, "component").select("vec_id", "n_links", F.when(F.col("first") < LAST_ID, F.col("first")).alias("component_id"))
    alone = rows.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = staged(named.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
    discard(rows, kinds, dealt, sizes, found, groups, of_kind, told)
    return out
