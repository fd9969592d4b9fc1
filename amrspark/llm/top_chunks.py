"""Exact top-k chunks by inner product, by branch and bound over ball trees."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from amrspark.llm.store import store

SHARD_ROWS, QUERY_ROWS, LEAF_ROWS = 16_384, 8_192, 64
MAX_BALLS, SAMPLE_PER_BALL, _POWER_STEPS = 1024, 16, 4
_EXACT, _MOST = float(1 << 53), (1 << 63) - 1
# Bounds are computed in double precision and widened by this share of the terms they sum.
_SLACK = 1e-9


def top_chunks(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    k: int = 5,
    scale: int = 256,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
    leaf_rows: int = LEAF_ROWS,
    max_balls: int = MAX_BALLS,
) -> DataFrame:
    """The k chunks of largest integer inner product for each query chunk, but itself.

    Parameters
    ----------
    vectors: chunk_id, vector (array of numbers); all are candidates. queries: chunk_id, vector.
    scale: every component x counts as the integer floor(scale * x).
    shard_rows: vectors of a shard, about; query_rows: queries that meet a shard in one task.
    leaf_rows: vectors of a leaf of a shard's tree, at most.
    max_balls: shard centres, at most; they and their radii are all that is broadcast.

    Returns query_id, rank (from 1), chunk_id, score (long): larger scores first, ties to the
    smaller chunk_id; fewer than k rows if there are fewer candidates. A score beyond 64 bits counts
    as the nearest 64-bit number.

    Vectors that are null, empty, or hold null or non-finite numbers take no part, nor do null ids;
    zero vectors do. Of a repeated chunk_id each row is a candidate; equal query rows are one, and
    query rows of one id with different vectors are answered apart. Vectors of another length than
    the query's are no candidates. Empty tables give no rows.

    1. Centres are fitted on a sample of SAMPLE_PER_BALL vectors each, those of least hash. Every
       vector goes to the shards of its nearest centre; a centre with many vectors, equal ones
       included, has several shards, dealt by a hash.
    2. Each query is answered in one shard of the ball with its highest bound: the inner product
       with the centre plus the query's length times the radius. Its kth score there is shared.
    3. It then goes to all other shards whose bound reaches that score. Nothing else can hold a
       better chunk, so the result is exact.
    In a shard, a ball tree is descended for all queries at once: nodes whose bound falls short of a
    query's kth score are left, and each query takes its leaves by falling bound, in rounds of
    doubling size with the kth score raised after each.
    """
    given = _usable(vectors)
    asked = _usable(queries).distinct().withColumn("query", F.xxhash64("vector"))
    kind = given.schema["chunk_id"].dataType.simpleString()
    n = given.count()
    balls = _centres(given, min(max_balls, math.ceil(n / shard_rows)))
    session = vectors.sparkSession
    shared = session.sparkContext.broadcast(balls)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, far = _nearest(batch.column("vector"), shared.value, scale)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(number, pa.int32()), pa.array(far, pa.float64())],
                [*batch.schema.names, "ball", "far"],
            )

    placed = store(
        given.mapInArrow(assign, f"chunk_id {kind}, vector array<double>, ball int, far double"), "placed"
    )
    # At most max_balls + 1 rows, so a broadcast of them is bounded.
    counted = placed.groupBy("ball").agg(
        F.ceil(F.count("*") / shard_rows).cast("int").alias("parts"), F.max("far").alias("far")
    )
    shards = {r["ball"]: (r["parts"], r["far"]) for r in counted.collect()}
    parts = session.createDataFrame([(b, m) for b, (m, _) in shards.items()], "ball int, parts int")
    data = placed.join(F.broadcast(parts), "ball").select(
        "chunk_id", "vector", "ball", F.pmod(F.xxhash64("chunk_id", "vector"), "parts").cast("int").alias("shard")
    )
    groups = max(1, math.ceil(asked.count() / query_rows))
    known = session.sparkContext.broadcast((balls, shards))
    layout = f"chunk_id {kind}, vector array<double>, query long, kth long, ball int, shard int"
    asked = store(asked, "asked")
    settings = (k, scale, leaf_rows)

    def wave(rows: DataFrame, first: bool) -> DataFrame:
        routed = rows.select("chunk_id", "vector", "query", "kth").mapInArrow(_router(known, scale, first), layout)
        group = F.pmod(F.xxhash64("chunk_id", "query"), F.lit(groups)).cast("int")
        left = data.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        met = left.groupBy("ball", "shard", "g").cogroup(routed.withColumn("g", group).groupBy("ball", "shard", "g"))

        def search(own: pa.Table, wanted: pa.Table) -> pa.Table:
            return _search(own, wanted, settings)

        return met.applyInArrow(search, f"query_id {kind}, query long, chunk_id {kind}, score long")

    found = store(wave(asked.withColumn("kth", F.lit(None).cast("long")), True), "first-wave")
    reached = found.groupBy("query_id", "query").agg(
        F.when(F.count("*") == k, F.min("score")).alias("kth")
    ).select(F.col("query_id").alias("chunk_id"), "query", "kth")
    rest = wave(asked.join(reached, ["chunk_id", "query"], "left"), False)
    best = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "chunk_id")
    ranked = found.unionAll(rest).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def _usable(rows: DataFrame) -> DataFrame:
    given = rows.select("chunk_id", F.col("vector").cast("array<double>").alias("vector"))
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return given.where(F.col("chunk_id").isNotNull() & F.coalesce(good & (F.size("vector") > 0), F.lit(False)))


def _centres(given: DataFrame, count: int) -> list[np.ndarray]:
    """Centres fitted by a few rounds of means on a sample bounded by its row number."""
    sample = given.orderBy(F.xxhash64("chunk_id", "vector"), "chunk_id").limit(SAMPLE_PER_BALL * count)
    rows = [np.array(r["vector"]) for r in sample.select("vector").collect()] if count else []
    out = []
    for size in sorted({len(r) for r in rows}):
        own = np.stack([r for r in rows if len(r) == size])
        own = own / max(1.0, np.abs(own).max())  # directions only; keeps the squares finite
        middle = own[:: max(1, len(rows) // count)].copy()
        for _ in range(5):
            near = _distances(own, middle).argmin(axis=1)
            for i in np.unique(near):
                middle[i] = own[near == i].mean(axis=0)
        out.append(middle)
    return out


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, up to a term that is the same for all centres."""
    return (centres * centres).sum(axis=1) - 2.0 * rows @ centres.T


def _lists(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of the vectors of a column."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[offsets[rows][:, None] + np.arange(size)]


def _scaled(matrix: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles: exact below 2^53, and else as good as a double gets."""
    with np.errstate(over="ignore"):
        return np.floor(matrix * scale)


def _nearest(column: pa.Array, balls: list[np.ndarray], scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The ball of each vector (-1 where no centre has its length) and its distance, rounded up."""
    number, far = np.full(len(column), -1, np.int32), np.full(len(column), np.inf)
    first = 0
    by_size = {}
    for centres in balls:
        by_size[centres.shape[1]] = (first, centres)
        first += len(centres)
    for rows, matrix in _lists(column):
        if matrix.shape[1] in by_size:
            first, centres = by_size[matrix.shape[1]]
            own = _distances(matrix, centres).argmin(axis=1)
            with np.errstate(over="ignore", invalid="ignore"):
                off = _scaled(matrix, scale) - _scaled(centres[own], scale)
                far[rows] = np.nan_to_num(np.sqrt((off * off).sum(axis=1)) * (1 + _SLACK), nan=np.inf)
            number[rows] = own + first
    return number, far


def _router(known, scale: int, first: bool):
    """Queries to one shard of their best ball, or to all the others that may hold a better chunk."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls, shards = known.value
        loose = [(-1, s) for s in range(shards[-1][0])] if -1 in shards else []
        number, by_size = 0, {}
        for centres in balls:
            held = [i for i in range(len(centres)) if number + i in shards]
            own = [(number + i, s) for i in held for s in range(shards[number + i][0])]
            place = np.repeat(np.arange(len(held)), [shards[number + i][0] for i in held])
            far = np.array([shards[number + i][1] for i in held])
            by_size[centres.shape[1]] = (own, place, _scaled(centres[held], scale), far)
            number += len(centres)
        for batch in batches:
            kth = batch.column("kth")
            least = np.where(kth.is_null(), -np.inf, kth.fill_null(0).to_numpy().astype(float))
            row, ball, shard = [], [], []
            for rows, matrix in _lists(batch.column("vector")):
                own, place, centres, far = by_size.get(matrix.shape[1], ([], np.empty(0, int), None, None))
                every = np.array(own + loose, np.int64).reshape(-1, 2)
                if not len(every):
                    continue
                reach = np.full((len(rows), len(every)), np.inf)
                if len(own):
                    reach[:, : len(own)] = _bounds(_scaled(matrix, scale), centres, far)[:, place]
                # Of the shards of the best ball one by a hash, the same in both waves.
                best = reach[:, : len(own)].argmax(axis=1) if len(own) else np.zeros(len(rows), int)
                parts = np.bincount(place)[place[best]] if len(own) else np.full(len(rows), len(loose))
                home = best + np.array([zlib.crc32(v.tobytes()) for v in matrix]) % parts
                if first:
                    q, s = np.arange(len(rows)), home
                else:
                    wanted = reach >= least[rows][:, None]
                    wanted[np.arange(len(rows)), home] = False
                    q, s = np.nonzero(wanted)
                row.append(rows[q])
                ball.append(every[s, 0])
                shard.append(every[s, 1])
            flat = [np.concatenate([np.empty(0, np.int64), *c]) for c in (row, ball, shard)]
            taken = batch.take(pa.array(flat[0]))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(flat[1].astype(np.int32)), pa.array(flat[2].astype(np.int32))],
                [*batch.schema.names, "ball", "shard"],
            )

    return route


def _bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """For each query and ball, no less than any inner product with a vector of the ball."""
    with np.errstate(over="ignore", invalid="ignore"):
        length = np.sqrt((queries * queries).sum(axis=1))[:, None]
        size = np.sqrt((centres * centres).sum(axis=1))
        bound = queries @ centres.T + length * radii + _SLACK * length * (size + radii)
    return np.where(np.isfinite(bound), bound, np.inf)


def _search(own: pa.Table, wanted: pa.Table, settings) -> pa.Table:
    k, scale, leaf_rows = settings
    out = {"query_id": [], "query": [], "chunk_id": [], "score": []}
    own, wanted = own.combine_chunks(), wanted.combine_chunks()
    kind = own.schema.field("chunk_id").type
    if len(own) and len(wanted):
        # In ascending id order, so that a row's number decides ties.
        own = own.sort_by("chunk_id")
        ids, keys = own["chunk_id"], wanted["chunk_id"]
        asked = dict((m.shape[1], (r, m)) for r, m in _lists(wanted["vector"].chunk(0)))
        for rows, matrix in _lists(own["vector"].chunk(0)):
            if matrix.shape[1] in asked:
                at, queries = asked[matrix.shape[1]]
                tree = BallTree(matrix, scale, leaf_rows)
                mine, both = ids.take(pa.array(rows)), keys.take(pa.array(at))
                kth = wanted["kth"].take(pa.array(at))
                q, r, score = tree.search(queries, k, _codes(mine, both), kth)
                out["query_id"].append(both.take(pa.array(q)).combine_chunks())
                out["query"].append(wanted["query"].take(pa.array(at)).take(pa.array(q)).combine_chunks())
                out["chunk_id"].append(mine.take(pa.array(r)).combine_chunks())
                out["score"].append(pa.array(score, pa.int64()))
    kinds = {"query_id": kind, "query": pa.int64(), "chunk_id": kind, "score": pa.int64()}
    return pa.table({c: pa.chunked_array(out[c], t) for c, t in kinds.items()})


def _codes(ids, keys) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where a chunk's id and a query's are."""
    both = pa.chunked_array([*ids.chunks, *keys.chunks], ids.type).combine_chunks().dictionary_encode()
    codes = (both.combine_chunks() if isinstance(both, pa.ChunkedArray) else both).indices.to_numpy()
    return codes[: len(ids)], codes[len(ids) :]


class BallTree:
    """A complete binary tree of balls over the scaled vectors of a shard."""

    def __init__(self, matrix: np.ndarray, scale: int, leaf_rows: int):
        self.scale, self.given = scale, matrix
        self.data = _scaled(matrix, scale)
        self.most = float(np.abs(self.data).max())
        order = np.arange(len(matrix))
        cuts = [0, len(matrix)]
        self.levels = []
        with np.errstate(over="ignore", invalid="ignore"):
            while True:
                spans = list(zip(cuts, cuts[1:], strict=False))
                self.levels.append(self._balls(order, spans))
                if max(b - a for a, b in spans) <= max(1, leaf_rows):
                    break
                new = [0]
                for (a, b), centre in zip(spans, self.levels[-1][0], strict=True):
                    new += [self._halved(order, a, b, centre), b]
                cuts = new
        self.order, self.spans = order, spans

    def _balls(self, order, spans) -> tuple[np.ndarray, np.ndarray]:
        centres = np.stack([self.data[order[a:b]].mean(axis=0) for a, b in spans])
        radii = [np.sqrt(((self.data[order[a:b]] - c) ** 2).sum(axis=1).max()) for (a, b), c in zip(spans, centres, strict=True)]
        return centres, np.array(radii) * (1 + _SLACK)

    def _halved(self, order: np.ndarray, a: int, b: int, centre: np.ndarray) -> int:
        """Order a node's rows along the direction they vary most in, about, and halve them."""
        middle = (b - a) // 2
        if b - a > 1:
            own = self.data[order[a:b]] - centre
            axis = np.random.default_rng(middle).standard_normal(own.shape[1])
            for _ in range(_POWER_STEPS):
                longer = own.T @ (own @ axis)
                length = np.sqrt((longer * longer).sum())
                if not 0 < length < np.inf:
                    break
                axis = longer / length
            order[a:b] = order[a:b][np.argpartition(own @ axis, middle)]
        return a + middle

    def search(self, queries: np.ndarray, k: int, codes, kth: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score): the k best of each query, or those that reach its kth score so far."""
        scaled = _scaled(queries, self.scale)
        # The kth score by which a query prunes; a shared one may be tied by smaller ids.
        least = np.array([-_MOST - 1 if v is None else v for v in kth.to_pylist()], np.int64)
        exact = float(np.abs(scaled).max()) * self.most * queries.shape[1] < _EXACT
        bounds = np.full((len(queries), 1), np.inf)
        for centres, radii in self.levels:
            parents = np.repeat(bounds, len(radii) // bounds.shape[1], axis=1)
            bounds = np.minimum(parents, _bounds(scaled, centres, radii)) if exact else np.full_like(parents, np.inf)
            bounds[bounds < least[:, None]] = -np.inf
        turn = np.argsort(-bounds, axis=1, kind="stable")
        falling = np.take_along_axis(bounds, turn, axis=1)
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
        at, step, leaves = 0, 1, turn.shape[1]
        while at < leaves:
            open_ = (falling[:, at : at + step] >= least[:, None]) & (falling[:, at : at + step] > -np.inf)
            q, j = np.nonzero(open_)
            if not len(q):
                break
            leaf = turn[q, at + j]
            order = np.argsort(leaf, kind="stable")
            q, leaf = q[order], leaf[order]
            found = [best]
            starts = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
            for a, b in zip(starts, [*starts[1:], len(leaf)], strict=True):
                found.append(self._leaf(queries, scaled, q[a:b], int(leaf[a]), least, codes, exact))
            best = _best(found, k)
            counts = np.bincount(best[0], minlength=len(queries))
            full = counts >= k
            ends = np.cumsum(counts) - 1
            least[full] = np.maximum(least[full], best[2][ends[full]])
            at, step = at + step, step * 2
        return best

    def _leaf(self, queries, scaled, asked, leaf: int, least, codes, exact: bool):
        """Scores of a leaf's vectors that reach the kth score of their query."""
        rows = self.order[slice(*self.spans[leaf])]
        if exact:
            score = (scaled[asked] @ self.data[rows].T).astype(np.int64)
        else:
            score = _large(queries[asked], self.given[rows], self.scale)
        keep = (score >= least[asked][:, None]) & (codes[0][rows][None, :] != codes[1][asked][:, None])
        q, r = np.nonzero(keep)
        return asked[q], rows[r], score[q, r]


def _best(found: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query, by query, falling score and rising row."""
    q, r, s = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((r, ~s, q))
    q, r, s = q[order], r[order], s[order]
    first = np.searchsorted(q, q, "left")
    keep = np.arange(len(q)) - first < k
    return q[keep], r[keep], s[keep]


def _large(queries: np.ndarray, rows: np.ndarray, scale: int) -> np.ndarray:
    """Inner products of numbers too large for doubles, in whole numbers of any size."""

    def whole(matrix: np.ndarray) -> np.ndarray:
        # From 2^53 on a double is a whole number.
        exact = [[math.floor(x * scale) if abs(x) < _EXACT else int(x) * scale for x in v] for v in matrix.tolist()]
        return np.array(exact, object).reshape(matrix.shape)

    product = whole(queries).dot(whole(rows).T)
    return np.clip(product, -_MOST, _MOST).astype(np.int64)
