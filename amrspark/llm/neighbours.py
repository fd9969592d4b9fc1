"""Nearest neighbours of chunk vectors by collision-counting hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROJECTIONS, COLLISIONS, SHARE, GROWTH, WIDE = 64, 0.65, 0.3, 1.1, 1.5
BLOCK_ROWS, QUERY_ROWS, _LEAST = 16_384, 512, 10


def nearest_chunks(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    k: int = 20,
    projections: int = PROJECTIONS,
    collisions: float = COLLISIONS,
    share: float = SHARE,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
    seed: int = 11,
) -> DataFrame:
    """The k chunks of largest inner product for each query chunk, but itself.

    Parameters
    ----------
    vectors: chunk_id, vector (array of numbers, one length); all are candidates.
    queries: chunk_id, vector.
    projections: random lines; collisions: share of their windows that a vector must lie in.
    share: of a block, how many vectors are verified at least (and 10 k of them).
    block_rows, query_rows: vectors and queries that meet in a task.

    Returns query_id, rank (from 1), chunk_id, score: the inner product of the given vectors, in
    double precision, summed in index order. Larger scores first, ties to the smaller chunk_id;
    fewer than k rows if there are fewer candidates.

    Vectors that are null, empty, zero, or hold null or non-finite numbers take no part, nor do
    null ids; of a repeated chunk_id each row is a candidate, and equal query rows are one. Vectors of another length than the
    query's are no candidates. Empty tables give no rows.

    Every vector is divided by the largest length and given one more component that makes its
    length one, so the largest inner product is the least distance. A block of vectors keeps, per
    random line, its vectors sorted by their place on it. Around a query's place a window opens on
    every line and grows by a factor (virtual rehashing); a vector collides where it lies in the
    window. A query's first window is the last one of the query before it, in id order. Vectors with enough collisions are verified; the windows grow until `share` of the
    block are, so equal vectors are all verified or none. Each task has one block and one group of
    queries and returns k rows per query at most.
    """
    n = vectors.count()
    blocks = max(1, math.ceil(n / block_rows))
    groups = max(1, math.ceil(queries.count() / query_rows))
    data = _usable(vectors).withColumn("b", _spread("chunk_id", blocks))
    asked = _usable(queries).distinct().withColumn("g", _spread("chunk_id", groups))
    kind = data.schema["chunk_id"].dataType.simpleString()
    longest = data.agg(F.max(_length("vector"))).first()[0]
    if longest is None:
        longest = 1.0
    every = [F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(c) for m, c in ((groups, "g"), (blocks, "b"))]
    left = data.select("chunk_id", "vector", "b", every[0])
    right = asked.select("chunk_id", "vector", "g", every[1])
    settings = (k, projections, collisions, share, seed, float(longest))

    def search(own: pa.Table, wanted: pa.Table) -> pa.Table:
        found = _search(own, wanted, settings)
        types = [own.schema.field("chunk_id").type, own.schema.field("chunk_id").type, pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(found, types, strict=True)], ["query_id", "chunk_id", "score"])

    near = left.groupBy("b", "g").cogroup(right.groupBy("b", "g")).applyInArrow(
        search, f"query_id {kind}, chunk_id {kind}, score double"
    )
    # At most k rows per query and block.
    best = near.groupBy("query_id").agg(
        F.slice(
            F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "chunk_id", "score"))), 1, k
        ).alias("best")
    )
    return best.select("query_id", F.posexplode("best").alias("rank", "x")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), "x.chunk_id", "x.score"
    )


def _length(vector: str):
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def _usable(rows: DataFrame) -> DataFrame:
    given = rows.select("chunk_id", "vector")
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return given.where(
        F.col("chunk_id").isNotNull() & F.coalesce(good & F.exists("vector", lambda x: x != 0), F.lit(False))
    )


def _spread(column: str, parts: int):
    return F.pmod(F.xxhash64(column, "vector"), F.lit(parts)).cast("int")


def _search(own: pa.Table, wanted: pa.Table, settings) -> tuple[list, list, list]:
    out: tuple[list, list, list] = ([], [], [])
    lengths = np.array([len(v) for v in own["vector"]]) if len(own) else np.empty(0, int)
    asked = np.array([len(v) for v in wanted["vector"]]) if len(wanted) else np.empty(0, int)
    for size in np.unique(asked):
        mine = own.filter(pa.array(lengths == size))
        if not len(mine):
            continue
        block = _Block(mine, int(size), settings)
        # In one order: a query's first window is taken from the query before it.
        some = wanted.filter(pa.array(asked == size)).sort_by("chunk_id")
        for key, vector in zip(some["chunk_id"].to_pylist(), _matrix(some["vector"], int(size)), strict=True):
            for other, score in block.nearest(key, vector):
                out[0].append(key)
                out[1].append(other)
                out[2].append(score)
    return out


def _matrix(column, size: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(-1, size)


class _Block:
    """A block's vectors, sorted by place on every line."""

    def __init__(self, table: pa.Table, size: int, settings):
        self.k, lines, collisions, self.share, seed, longest = settings
        self.need, self.radius = max(1, math.ceil(collisions * lines)), 0.0
        ids = table["chunk_id"].to_pylist()
        rank = sorted(range(len(ids)), key=ids.__getitem__)
        self.ids = [ids[i] for i in rank]
        self.data = _matrix(table["vector"], size)[rank]
        self.columns = np.ascontiguousarray(self.data.T)
        unit = self.data / longest
        rest = np.sqrt(np.maximum(0.0, 1.0 - (unit * unit).sum(axis=1)))
        self.lines = np.random.default_rng(seed).standard_normal((size + 1, lines))
        place = unit @ self.lines[:-1] + rest[:, None] * self.lines[-1]
        order = np.argsort(place, axis=0, kind="stable")
        self.sorted = np.take_along_axis(place, order, axis=0).T.copy()
        # Where each vector stands in the sorted array of each line.
        kind = np.uint16 if len(ids) < 1 << 16 else np.uint32
        self.rank = np.empty(self.sorted.shape, kind)
        for rank, own in zip(self.rank, order.T, strict=True):
            rank[own] = np.arange(len(ids), dtype=kind)

    def nearest(self, key, query: np.ndarray) -> Iterator[tuple]:
        n, lines = len(self.ids), len(self.sorted)
        size = np.sqrt((query * query).sum())
        at = (query / size) @ self.lines[:-1]
        target = min(n, max(_LEAST * self.k, math.ceil(self.share * n)))
        kind = self.rank.dtype.type
        shifted, inside = np.empty(n, kind), np.empty(n, bool)
        radius = self.radius or self._first(at, target)
        while True:
            count = np.zeros(n, np.uint8 if lines < 256 else np.uint16)
            whole = True
            for row, rank, p in zip(self.sorted, self.rank, at, strict=True):
                low, high = row.searchsorted(p - radius), row.searchsorted(p + radius, "right")
                whole = whole and high - low == n
                # A vector lies in the window if its place in the sorted array does.
                np.subtract(rank, kind(low), out=shifted)
                np.less(shifted, kind(high - low), out=inside)
                count += inside
            hit = np.flatnonzero(count >= self.need)
            if len(hit) >= target or whole:
                break
            radius *= GROWTH
        # The next query begins here, or a little closer where this one reached far more than asked.
        self.radius = radius if len(hit) < WIDE * target else radius / GROWTH
        score = np.zeros(len(hit))
        for column, q in zip(self.columns, query, strict=True):
            score += column[hit] * q
        given = 0
        for i in np.lexsort((hit, -score)):
            if given == self.k:
                return
            if self.ids[hit[i]] != key:
                given += 1
                yield self.ids[hit[i]], float(score[i])

    def _first(self, at: np.ndarray, target: int) -> float:
        """The median radius whose window reaches as many vectors on a side as are to be verified."""
        n, half = self.sorted.shape[1], target
        ends = []
        for row, p in zip(self.sorted, at, strict=True):
            m = int(row.searchsorted(p))
            ends.append(max(p - row[max(0, m - half)], row[min(n - 1, m + half)] - p))
        return max(float(np.median(ends)), 1e-9)
