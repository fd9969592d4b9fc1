import numpy as np

from amrspark.llm.neighbours import nearest_chunks


def brute(ids, data, q, k):
    score = np.zeros(len(ids))
    for d in range(data.shape[1]):
        score += data[:, d] * data[q, d]
    score[q] = -np.inf
    return np.lexsort((ids, -score))[:k], score


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((8, 32))
    data = centres[rng.integers(0, 8, 1500)] + 0.7 * rng.standard_normal((1500, 32))
    data[100:200] = data[7]  # one very common vector
    ids = np.arange(1500)
    rows = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, data)], "chunk_id long, vector array<double>")
    got = nearest_chunks(rows, rows.where("chunk_id % 50 = 0"), block_rows=400, query_rows=10).toPandas()
    hits = []
    for q, found in got.groupby("query_id"):
        best, score = brute(ids, data, q, 20)
        found = found.sort_values("rank")
        assert found["rank"].tolist() == list(range(1, 21))
        assert (found["score"].to_numpy() == score[found["chunk_id"]]).all()
        assert (np.diff(found["score"]) <= 0).all()
        hits.append(len(set(best) & set(found["chunk_id"])) / 20)
    assert len(hits) == 30 and np.mean(hits) >= 0.9


def test_odd_vectors(spark):
    schema = "chunk_id int, vector array<double>, b int, score string"
    rows = [
        (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [2.0, 1.0]),
        (6, [1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (None, [3.0, 3.0]), (8, [None, 1.0]), (9, []),
        (10, [float("inf"), 0.0]),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], schema)
    got = nearest_chunks(df, df.where("chunk_id in (1, 6, 7)")).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.chunk_id, r.score))
    assert sorted(by[1]) == [(1, 5, 2.0), (2, 7, 1.0), (3, 7, 1.0)]
    assert sorted(by[7]) == [(1, 5, 2.0), (2, 1, 1.0)]
    assert 6 not in by
    assert nearest_chunks(df.limit(0), df.limit(0)).count() == 0
