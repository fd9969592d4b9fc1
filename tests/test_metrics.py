import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from amrspark.operators import conformal as C
from amrspark.operators import metrics as M


def frame(spark, rows):
    return spark.createDataFrame(rows, "d string, p double, y int")


def brute_auroc(p, y):
    pos, neg = p[y == 1], p[y == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


def brute_ap(p, y):
    total, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        recall = (y[hit] == 1).sum() / (y == 1).sum()
        total += (recall - last) * (y[hit] == 1).mean()
        last = recall
    return total


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rank_metrics_match_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [("d", round(rng.random(), 1 + seed % 2), rng.randint(0, 1)) for _ in range(300)]
    p, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    got = M.rank_metrics(frame(spark, rows), ["d"]).first()
    assert got["auroc"] == pytest.approx(brute_auroc(p, y), abs=1e-12)
    assert got["pr_auc"] == pytest.approx(brute_ap(p, y), abs=1e-12)
    all_of = M.classification_metrics(frame(spark, rows), ["d"]).first()
    pred = p >= 0.5
    assert all_of["resistant_recall"] == pytest.approx(pred[y == 1].mean())
    assert all_of["susceptible_recall"] == pytest.approx((~pred[y == 0]).mean())
    assert all_of["brier"] == pytest.approx(((p - y) ** 2).mean())


def test_single_class_and_empty(spark):
    rows = [("s", 0.2, 0), ("s", 0.7, 0), ("r", 0.7, 1)]
    got = {r["d"]: r for r in M.classification_metrics(frame(spark, rows), ["d"]).collect()}
    s, r = got["s"], got["r"]
    assert s["single_class"] and s["auroc"] is None and s["pr_auc"] is None
    assert s["balanced_accuracy"] == 0.5 and s["f1"] == 0.0 and s["resistant_recall"] == 0.0
    assert r["auroc"] is None and r["pr_auc"] == 1.0 and r["balanced_accuracy"] == 1.0
    assert M.classification_metrics(frame(spark, []), ["d"]).count() == 0


def test_bin_edges(spark):
    want = {0.0: 0, 0.1: 1, 0.2: 2, 0.3: 2, 0.6: 5, 0.7: 6, 0.9: 9, 1.0: 9}
    for p, b in want.items():
        rows = M.reliability_bins(frame(spark, [("d", p, 1)]), ["d"]).where("n > 0").collect()
        assert [r["bin"] for r in rows] == [b]
    bins = M.reliability_bins(frame(spark, [("d", p, 1) for p in want]), ["d"]).collect()
    assert len(bins) == 10 and sum(r["n"] for r in bins) == len(want)
    assert all((r["mean_predicted"] is None) == (r["n"] == 0) for r in bins)
    curve = M.calibration_curve(frame(spark, [("d", 0.1, 1), ("d", 0.5, 0)]), ["d"]).collect()
    assert sorted(r["bin"] for r in curve) == [0, 4]


def test_tampered_metric_is_reported(spark):
    rows = [("a", i / 50, i % 3 == 0) for i in range(50)] + [("b", i / 50, i % 2) for i in range(50)]
    got = M.classification_metrics(frame(spark, [(d, p, int(y)) for d, p, y in rows]), ["d"])
    same = M.compare_metrics(got, got, ["d"]).collect()
    assert all(r["matches"] and r["max_abs_delta"] == 0.0 for r in same)
    tampered = got.withColumn("auroc", F.when(F.col("d") == "a", F.col("auroc") + 0.1).otherwise(F.col("auroc")))
    out = {r["d"]: r["matches"] for r in M.compare_metrics(tampered, got, ["d"]).collect()}
    assert out == {"a": False, "b": True}
    hole = got.withColumn("auroc", F.when(F.col("d") == "a", None).otherwise(F.col("auroc")))
    out = {r["d"]: r["matches"] for r in M.compare_metrics(hole, got, ["d"]).collect()}
    assert out == {"a": False, "b": True}
    other_n = got.withColumn("n", F.col("n") + 1)
    assert not any(r["matches"] for r in M.compare_metrics(other_n, got, ["d"]).collect())


def brute_tau(scores, alpha):
    n = len(scores)
    rank = math.ceil((n + 1) * (1.0 - alpha))
    return 1.0 if n == 0 or rank > n else float(np.sort(scores)[rank - 1])


@pytest.mark.parametrize("n", [0, 1, 8, 9, 19, 60])
def test_conformal_thresholds(spark, n):
    rng = random.Random(n)
    rows = [("d", rng.random(), 1) for _ in range(n)] + [("d", rng.random(), 0) for _ in range(9)]
    for r in C.fit(frame(spark, rows), ["d"], (0.05, 0.1, 0.2)).collect():
        a = r["alpha"]
        assert r["tau_r"] == brute_tau(np.array([1 - p for _, p, y in rows if y == 1]), a)
        assert r["tau_s"] == brute_tau(np.array([p for _, p, y in rows if y == 0]), a)
        assert (r["n_cal_resistant"], r["n_cal_susceptible"]) == (n, 9)
        assert r["guarantee"] == (min(n, 9) >= max(1, math.ceil(1 / a) - 1))


def test_sets_and_rates(spark):
    tau = spark.createDataFrame([("a", 0.1, 0.3, 0.3), ("b", 0.1, 0.6, 0.6), ("none", 0.1, 0.5, 0.5)], "d string, alpha double, tau_s double, tau_r double")
    rows = frame(spark, [("a", 0.1, 0), ("a", 0.9, 1), ("a", 0.5, 1), ("b", 0.5, 0)])
    sets = {(r["d"], r["p"]): (r["in_s"], r["in_r"]) for r in C.predict_sets(rows, tau, ["d"]).collect()}
    assert sets == {("a", 0.1): (True, False), ("a", 0.9): (False, True), ("a", 0.5): (False, False), ("b", 0.5): (True, True)}
    got = {r["d"]: r for r in C.evaluate(rows, tau, ["d"]).collect()}
    assert (got["a"]["n"], got["a"]["n_called"], got["a"]["accuracy_on_called"]) == (3, 2, 1.0)
    assert got["a"]["empty_rate"] == pytest.approx(1 / 3)
    assert got["b"]["ambiguous_rate"] == 1.0 and got["b"]["accuracy_on_called"] is None
    assert got["none"]["n"] == 0 and got["none"]["coverage"] == 0.0 and got["none"]["accuracy_on_called"] is None


def test_coverage_on_separated_points(spark):
    rng = random.Random(0)
    rows = [("d", min(1.0, max(0.0, rng.gauss(0.75 if i % 2 else 0.25, 0.2))), i % 2) for i in range(800)]
    cal, test = frame(spark, rows[:400]), frame(spark, rows[400:])
    out = C.evaluate(test, C.fit(cal, ["d"]), ["d"]).first()
    assert out["coverage"] >= 0.85
    assert C.marginal_coverage(cal, test, ["d"]).first()["coverage"] >= 0.85


def test_fingerprints(spark):
    ids = spark.createDataFrame([("b",), ("a",), ("a",)], "genome_id string")
    turned = ids.orderBy("genome_id")
    one = M.fingerprint(ids, ids).first()
    assert one == M.fingerprint(turned, ids).first()
    assert (one["n_genomes"], one["n_features"]) == (2, 3)
    assert one["genome_ids_sha256"] == hashlib.sha256(b"a\nb").hexdigest()
    empty = M.fingerprint(ids.limit(0)).first()
    assert (empty["n_genomes"], empty["n_features"]) == (0, None)
    assert empty["genome_ids_sha256"] == hashlib.sha256(b"").hexdigest()
