import math

import numpy as np
import pytest
from amrspark.llm import top_chunks as T

LAYOUT = "chunk_id long, vector array<double>"


def brute(rows, asked, k, scale=256):
    """Whole-number inner products of every query with every row."""

    def whole(v):
        return [math.floor(x * scale) if abs(x) < 2**53 else int(x) * scale for x in v]

    def good(v):
        return v and all(x is not None and math.isfinite(x) for x in v)

    most = (1 << 63) - 1
    out = []
    for key, v in {(a, tuple(b)) for a, b in asked if a is not None and good(b)}:
        scored = [
            (-max(-most, min(most, sum(x * y for x, y in zip(whole(v), whole(w), strict=True)))), other)
            for other, w in rows
            if other is not None and other != key and good(w) and len(w) == len(v)
        ]
        out += [(key, i + 1, other, -s) for i, (s, other) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def found(spark, rows, asked, **settings):
    got = T.top_chunks(spark.createDataFrame(rows, LAYOUT), spark.createDataFrame(asked, LAYOUT), **settings)
    assert got.columns == ["query_id", "rank", "chunk_id", "score"]
    return sorted(tuple(r) for r in got.collect())


SMALL = {"shard_rows": 40, "leaf_rows": 4, "query_rows": 7}


@pytest.mark.parametrize("seed, spread", [(1, 0.05), (2, 1.0), (3, 0.0)])
def test_equals_brute(spark, seed, spread):
    """Clusters, one of them with most rows; spread 0 makes every cluster one repeated vector."""
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((5, 8))
    own = np.minimum(rng.integers(0, 9, 400), 4)
    data = middle[own] + spread * rng.standard_normal((400, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    assert found(spark, rows, rows[::20], **SMALL) == brute(rows, rows[::20], 5)
    assert found(spark, rows, rows[::50]) == brute(rows, rows[::50], 5)


def test_odd_vectors(spark):
    rows = [
        (1, [1.0, 2.0]), (2, None), (3, []), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [0.0, 0.0]), (None, [1.0, 1.0]),
        (7, [1.0, 2.0, 3.0]), (8, [1e300, -1e300]), (9, [3e15, 1.0]), (10, [1e200, 1e200]), (1, [1.0, 2.0]), (1, [5.0, 5.0]),
        (11, [float("inf"), 0.0]), (12, [-1e17, 7.0]), (13, [3e15, 1.0]), (14, [0.003, -0.003]),
    ]
    for k in (1, 3, 20):
        assert found(spark, rows, rows, k=k, **SMALL) == brute(rows, rows, k)


def test_empty_tables_and_columns(spark):
    rows = [(1, [1.0]), (2, [2.0])]
    assert found(spark, [], rows) == [] and found(spark, rows, []) == [] and found(spark, [], []) == []
    more = spark.createDataFrame(rows, LAYOUT).selectExpr("*", "1 AS query", "2 AS ball", "3 AS rank", "4 AS kth")
    assert T.top_chunks(more, more).count() == 2
    text = spark.createDataFrame([("a", [1.0, 1.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0])], "chunk_id string, vector array<float>")
    assert [tuple(r) for r in T.top_chunks(text, text.where("chunk_id = 'a'")).collect()] == [("a", 1, "b", 65536), ("a", 2, "c", 65536)]


def test_nodes_are_left():
    """In far apart clusters most leaves are never scored, and the result is still exact."""
    rng = np.random.default_rng(5)
    data = np.repeat(50 * np.eye(32), 64, axis=0) + 0.1 * rng.standard_normal((2048, 32))
    tree = T.BallTree(data, 256, 16)
    seen = []
    leaf = tree._leaf
    tree._leaf = lambda *a: (seen.append(len(a[2])), leaf(*a))[1]
    import pyarrow as pa

    codes = (np.arange(2048), np.arange(0, 2048, 64))
    q, r, s = tree.search(data[::64], 5, codes, pa.array([None] * 32, pa.int64()))
    whole = np.floor(256 * data)
    score = (whole[::64] @ whole.T).astype(np.int64)
    score[np.arange(32), np.arange(0, 2048, 64)] = -(1 << 62)
    assert (s.reshape(32, 5) == -np.sort(-score, axis=1)[:, :5]).all()
    assert sum(seen) < 32 * len(tree.spans) / 8
