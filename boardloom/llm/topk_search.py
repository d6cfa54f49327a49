"""Exact top-k inner-product search by no-random-access aggregation.

Vectors are quantised to integers. A block of candidates keeps one list for each component,
sorted by value. A query reads its lists in step, from the end that its own sign favours; after
each stretch it knows, for every candidate, a lower bound (seen components plus the worst value
of the unseen lists) and an upper bound (seen components plus the lists' present values). Reading
stops when no candidate outside the best k, seen or unseen, can reach the k-th lower bound. Then
the final scores of the few that are left are resolved from their vectors, which the block holds.
Nothing is estimated, so results are exact; ties go to the smaller id.

The first block is searched before the others; a query's k-th score there is a floor for all of
them, so their lists are first read to where an unseen candidate falls below the floor, which
takes no look at any candidate. Candidates are copied only when there are more queries than one
task holds (QUERY_BLOCK); queries, the smaller side, go to every block. Blocks have up to BLOCK
candidates and no fewer than there are cores. The best k of each block go on to a ranked merge,
at most k rows a block and query. A query set that grows with the table makes the number of
meetings grow too; this is the job asked for, and it is spread over all tasks.

Cases: vectors that are null, hold a null or a component that is not finite take no part, nor do
rows with a null id. Vectors of different lengths: missing components count as 0. Repeated ids
are candidates of their own, and no candidate with the query's own id is returned. A query that
stands there twice (same id and vector) is one query; one id with two vectors is two queries.
Fewer than k candidates: all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import staged

BLOCK = 32_768
QUERY_BLOCK = 16_384
#: Candidates of the first block, and the least that is worth a block of its own.
SMALL_BLOCK = 4_096
#: Queries that read the lists together.
TOGETHER = 256


def quantised(embedding: Column, scale: int = 256) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale))


def usable(embedding: Column) -> Column:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(True))


class SortedLists:
    """The sorted lists of a block of candidates, read by a block of queries at once.

    A list read to some depth shows each candidate either its own value or, unseen, a value that
    bounds it: the list's far end from below, the value just read from above. With the lists
    filled up that way, the bounds of all candidates for all queries are matrix products.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.x = ids, vectors
        self.n = len(ids)
        order = np.argsort(vectors, axis=0, kind="stable")
        self.rank = np.empty_like(order)
        np.put_along_axis(self.rank, order, np.arange(self.n)[:, None], axis=0)
        self.ascending = np.take_along_axis(vectors, order, axis=0)

    def _unseen(self, plus: np.ndarray, minus: np.ndarray, depth: int) -> np.ndarray:
        """The most that a candidate seen in no list can score."""
        return self.ascending[self.n - depth] @ plus + self.ascending[depth - 1] @ minus

    def _bounds(self, plus: np.ndarray, minus: np.ndarray, depth: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high, low = self.rank[rows] >= self.n - depth, self.rank[rows] < depth
        x, small, large = self.x[rows], self.ascending[0], self.ascending[-1]
        at_high, at_low = self.ascending[self.n - depth], self.ascending[depth - 1]
        lower = np.where(high, x, small) @ plus + np.where(low, x, large) @ minus
        # an upper bound has the present value where the lower one has the worst value
        upper = lower + np.where(high, 0, at_high - small) @ plus + np.where(low, 0, at_low - large) @ minus
        return lower, upper

    def top(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query number, ids, scores) of the best k of this block for each query, those below its floor left out."""
        plus, minus = np.maximum(queries, 0).T, np.minimum(queries, 0).T
        depth = min(self.n, 4 * k)
        while depth < self.n and (self._unseen(plus, minus, depth) >= floors).any():
            depth = min(self.n, 2 * depth)
        if not np.isfinite(floors).all():
            depth = min(self.n, max(4 * k, self.n // 4))
        rows = np.arange(self.n)
        live = self.ids[:, None] != query_ids[None, :]
        while True:
            lower, upper = self._bounds(plus, minus, depth, rows)
            lower = np.where(live, lower, -np.inf)
            bar = floors
            if len(rows) > k:
                bar = np.maximum(floors, np.partition(lower, len(rows) - k, axis=0)[len(rows) - k])
            live &= upper >= bar
            if depth == self.n or live.sum(axis=0).max(initial=0) <= 4 * k:
                break
            depth, some = min(self.n, 2 * depth), live.any(axis=1)
            rows, live = rows[some], live[some]
        for j in range(len(query_ids)):
            at = rows[live[:, j]]
            scores = self.x[at] @ queries[j]
            best = np.lexsort((self.ids[at], -scores))[:k]
            yield j, self.ids[at][best], scores[best].astype(np.int64)


def _matrix(rows: pd.Series, dims: int) -> np.ndarray:
    if len(rows) and all(len(r) == dims for r in rows):
        return np.stack(rows.to_numpy()).astype(np.int64)
    out = np.zeros((len(rows), dims), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query, its own row excepted."""

    def ready(df: DataFrame) -> DataFrame:
        good = df.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
        return good.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("x"))

    candidates = staged(ready(vectors).withColumn("salt", F.monotonically_increasing_id()))
    asked = staged(ready(queries).distinct().withColumn("ask", F.monotonically_increasing_id()))
    n, m = candidates.count(), asked.count()
    blocks = max(math.ceil(n / BLOCK), min(math.ceil(n / SMALL_BLOCK), 2 * vectors.sparkSession.sparkContext.defaultParallelism), 1)
    query_blocks = max(1, math.ceil(m / QUERY_BLOCK))
    dealt = candidates.withColumn("block", F.pmod(F.xxhash64("id", "salt"), F.lit(blocks)))
    schema = "query_id long, ask long, vec_id long, score long"

    def search(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": [], "ask": [], "vec_id": [], "score": []}, dtype="int64")]
        if not len(own) or not len(queries):
            return found[0]
        dims = max(own["x"].map(len).max(), queries["x"].map(len).max())
        x, q = _matrix(own["x"], dims), _matrix(queries["x"], dims)
        if dims * float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) < 2.0**53:
            x, q = x.astype(float), q.astype(float)  # sums stay whole numbers that doubles hold exactly
        lists, floors = SortedLists(own["id"].to_numpy(), x), queries["floor"].to_numpy(float, na_value=-np.inf)
        for start in range(0, len(queries), TOGETHER):
            part = slice(start, start + TOGETHER)
            ids, asks = queries["id"].to_numpy()[part], queries["ask"].to_numpy()[part]
            for j, near, scores in lists.top(ids, q[part], k, floors[part]):
                found.append(pd.DataFrame({"query_id": ids[j], "ask": asks[j], "vec_id": near, "score": scores}))
        return pd.concat(found)

    def searched(part: DataFrame, asked: DataFrame, low: int, high: int) -> DataFrame:
        """The best k of each of the blocks low to high - 1."""
        left = part.withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))) if query_blocks > 1 else part.withColumn("with", F.lit(0))
        right = asked.withColumns({"with": F.pmod(F.xxhash64("ask"), F.lit(query_blocks)).cast("int"), "block": F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high - 1).cast("long")))})
        return left.groupBy("block", "with").cogroup(right.groupBy("block", "with")).applyInPandas(search, schema)

    near = staged(searched(dealt.where("block = 0"), asked.withColumn("floor", F.lit(None).cast("double")), 0, 1))
    if blocks > 1:
        floor = F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double")
        floors = asked.join(near.groupBy("ask").agg(floor.alias("floor")), "ask", "left")
        near = near.unionByName(searched(dealt.where("block > 0"), floors, 1, blocks))
    best = F.row_number().over(Window.partitionBy("query_id", "ask").orderBy(F.desc("score"), F.asc("vec_id")))
    return near.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
