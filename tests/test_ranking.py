import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from amrspark.operators.ranking import cumulative, ranges, ranked, weighted_quantile_rows


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for part in ("a", "b", "c"):
        for i in range({"a": 400, "b": 30, "c": 1}[part]):
            # Heavy ties and one far outlier.
            score = 1e6 if i == 7 else rng.choice([0.0, 0.25, 0.5, rng.random()])
            out.append((part, i, float(score), rng.randint(0, 3)))
    return out


def test_cumulative_matches_sorting(spark, rows):
    df = spark.createDataFrame(rows, "part string, id int, k double, w long")
    got = {(r["part"], r["k"]): r for r in cumulative(df, ["part"], "k", ["w"]).collect()}
    for part in "abc":
        mine = [r for r in rows if r[0] == part]
        for k in {r[2] for r in mine}:
            r = got[(part, k)]
            assert r["w_before"] == sum(x[3] for x in mine if x[2] < k)
            assert r["w"] == sum(x[3] for x in mine if x[2] == k)
            assert r["w_total"] == sum(x[3] for x in mine)


def test_ranked_matches_sorting(spark, rows):
    df = spark.createDataFrame(rows, "part string, id int, k double, w long")
    got = {(r["part"], r["id"]): r["rank"] for r in ranked(df, ["part"], "k", "id").collect()}
    for part in "abc":
        mine = sorted((r for r in rows if r[0] == part), key=lambda r: (-r[2], r[1]))
        assert [got[(part, r[1])] for r in mine] == list(range(1, len(mine) + 1))


def test_ranked_with_text_ties(spark):
    rows = [("q", f"doc-{i:03d}" + "x" * (i % 3), float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "q string, id string, s double")
    got = {r["id"]: r["rank"] for r in ranked(df, ["q"], "s", "id").collect()}
    want = sorted(rows, key=lambda r: (-r[2], r[1]))
    assert [got[r[1]] for r in want] == list(range(1, 61))


def test_quantile_rank_outside_is_null(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 2)], "p string, k double, w long")
    out = weighted_quantile_rows(df, ["p"], "k", "w", {"q2": F.lit(2), "q4": F.lit(4)}).first()
    assert (out["n"], out["q2"], out["q4"]) == (3, 2.0, None)


def test_medians_agree_with_numpy(spark):
    rng = random.Random(5)
    values = [round(rng.random() * 10, 1) for _ in range(501)]
    df = spark.createDataFrame([("a", v, 1) for v in values], "p string, k double, w long")
    out = weighted_quantile_rows(df, ["p"], "k", "w", {"m": F.floor((F.col("n") + 1) / 2)}).first()
    assert out["m"] == np.median(values)


def test_ranges_are_even_where_values_crowd(spark):
    """99 % of the scores lie below 1e-4, and one part holds nearly all rows."""
    df = spark.range(40_000).select(
        F.when(F.col("id") % 100 == 0, "small").otherwise("large").alias("part"),
        F.when(F.col("id") % 100 == 1, F.rand(1)).otherwise(F.rand(2) * 1e-4).alias("k"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in ranges(df, ["part", "k"]).groupBy("_range").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 8 and max(sizes) < 3 * sum(sizes) / len(sizes)
