import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from amrspark import fixed
from amrspark.operators import features as FE
from amrspark.operators import groups as G
from amrspark.operators import models as MO
from amrspark.operators import newton as newton_fit
from amrspark.plans import analysis
from amrspark.sources import store

HITS = "genome_id string, row_ord long, gene_symbol string, element_subtype string, drug_class string, drug_subclass string, method string"


def data(n=120, d=4, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 2, size=(n, d)).astype(float)
    z = x @ np.array([2.0, -1.0, 0.5, 0.0]) - 0.5 + rng.normal(0, 1, n)
    return x, (z > 0).astype(int)


def newton(x, y, w, penalty, steps=60):
    """Weighted logistic fit with `penalty` on the slopes, by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    reg = np.diag([penalty] * x.shape[1] + [0.0])
    beta = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-a @ beta))
        grad = a.T @ (w * (p - y)) + reg @ beta
        hess = (a * (w * p * (1 - p))[:, None]).T @ a + reg
        beta -= np.linalg.solve(hess, grad)
    return beta


@pytest.mark.parametrize("c", [0.1, 10.0])
def test_balanced_fit_matches_newton(spark, c):
    x, y = data()
    df = spark.createDataFrame([(Vectors.dense(r.tolist()), int(v)) for r, v in zip(x, y)], ["features", "y"])
    model = MO.fit_balanced(df, c)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    want = newton(x, y, w, 1.0 / c)
    got = np.append(model.coefficients, model.intercept)
    assert np.allclose(got, want, atol=1e-8) and model.converged
    assert MO.largest_gradient(df, model, c) < 1e-8
    model_of_half = MO.fit_balanced(df, c / 50)
    assert MO.largest_gradient(df, model_of_half, c) > 1e-3


def test_many_models_equal_single_fits(spark):
    """All folds and penalties in one pass a step, also nearly separable ones; row weights count."""
    x, y = data(200, 4, 3)
    x = np.hstack([x, y[:, None] + 0.3 * x[:, :1]])
    fold, w = np.arange(200) % 4, np.where(np.arange(200) % 3 == 0, 2.0, 0.5)
    rows = spark.createDataFrame(
        [(r.tolist(), float(t), float(u), int(k)) for r, t, u, k in zip(x, y, w, fold)], "v array<double>, y double, w double, fold int"
    ).repartition(3)
    jobs = [newton_fit.Problem(1 / c, k, 1.5, 2.0) for c in (0.01, 1.0, 100.0) for k in (None, 0, 3)]
    for job, model in zip(jobs, newton_fit.fit(rows, jobs, 5), strict=True):
        mine = fold != (-1 if job.without is None else job.without)
        own = w[mine] * np.where(y[mine] == 1, job.positive, job.negative)
        want = newton(x[mine], y[mine], own, job.penalty)
        assert np.allclose(np.append(model.coefficients, model.intercept), want, atol=1e-6)
        assert model.converged and model.steps < 30
    with pytest.raises(ValueError, match="too large"):
        newton_fit.fit(rows, jobs, 10_000)


def test_search_equals_single_fits(spark):
    x, y = data(150, 4, 5)
    rows = spark.createDataFrame(
        [(Vectors.dense(r.tolist()), int(v), "R" if v else "S", f"g{i}", f"s{i % 30}") for i, (r, v) in enumerate(zip(x, y))],
        ["features", "y", "side", "genome_id", "grp"],
    )
    best, scores = MO.search_c(rows, (0.1, 10.0), 3)
    placed = G.grouped_folds(rows.withColumn("_d", F.lit(0)), ["_d"], k=3, y="side").toPandas()
    got = {(r["c"], r["fold"]): r["pr_auc"] for r in scores.collect()}
    assert len(got) == 6
    for (c, k), value in got.items():
        out, held = placed[placed.fold != k], placed[placed.fold == k]
        a = np.array([v.toArray() for v in out.features])
        w = np.where(out.y == 1, len(out) / (2 * out.y.sum()), len(out) / (2 * (len(out) - out.y.sum())))
        beta = newton(a, out.y.to_numpy(), w, 1 / c)
        f = np.array([v.toArray() for v in held.features]) @ beta[:-1] + beta[-1]
        t = held.y.to_numpy()
        ap = sum(t[f >= s].mean() * (t[f == s].sum() / t.sum()) for s in np.unique(f))
        assert value == pytest.approx(ap, abs=1e-9)
    means = {c: np.mean([v for (d, _), v in got.items() if d == c]) for c in (0.1, 10.0)}
    assert best == max(means, key=lambda c: (means[c], -c))


def test_platt_matches_newton(spark):
    rng = np.random.default_rng(1)
    f = rng.normal(0, 2, 80)
    y = (f + rng.normal(0, 1, 80) > 0).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(f, y)], "f double, y int")
    slope, offset = MO.fit_platt(df)
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    want = newton(np.concatenate([f, f])[:, None], np.repeat([1, 0], len(f)), np.concatenate([t, 1 - t]), 0.0)
    assert np.allclose([slope, offset], want, atol=1e-7)
    wide = df.withColumn("f", df.f * 1e5 + 7e6)
    assert np.allclose(MO.fit_platt(wide), [slope / 1e5, offset - slope * 70], rtol=1e-3)
    with pytest.raises(ValueError):
        MO.fit_platt(df.where("y = 1"))


@pytest.fixture(scope="module")
def cohort(spark):
    """120 genomes in 24 groups of five."""
    hits, labels, meta = [], [], []
    for i in range(120):
        g, w = f"g{i:03d}", i % 5
        meta.append((g, "kpneumoniae", i // 5))
        mine = [("blaSHV-11", "AMR", "BETA-LACTAM", "BETA-LACTAM")]
        if w in (0, 1, 2):
            mine.append(("aac(3)-IIa", "AMR", "AMINOGLYCOSIDE", "GENTAMICIN"))
        if w == 0:
            mine.append(("blaKPC-2", "AMR", "BETA-LACTAM", "CARBAPENEM"))
        if i < 3:
            mine += [("gyrA_S83Y", "POINT", None, None), ("parC_S80I", "POINT", None, None)]
        hits += [(g, n, *m, "EXACTX") for n, m in enumerate(mine)]
        labels.append((g, "gentamicin", "Resistant" if w in (0, 1, 2) else "Susceptible"))
        labels.append((g, "meropenem", "Resistant" if w == 0 else "Susceptible"))
        if i < 8:
            labels.append((g, "ciprofloxacin", "Resistant" if i < 3 else "Susceptible"))
    return (
        spark.createDataFrame(hits, HITS),
        spark.createDataFrame(labels, "genome_id string, antibiotic string, sir string"),
        spark.createDataFrame(meta, "genome_id string, mlst_scheme string, mlst_st int"),
    )


def test_train_store_analyse_evaluate(spark, cohort, tmp_path):
    hits, labels, meta = cohort
    genomes, root = meta.select("genome_id"), str(tmp_path / "store")
    trained = analysis.train_and_store(
        spark, root, hits, genomes, labels, meta, "2026-05-15.1",
        drugs=("gentamicin", "meropenem", "ciprofloxacin"), grid=(0.1, 1.0), folds=3,
    )
    states = {d: t.status.first()["status"] for d, t in trained.items()}
    assert states == {"gentamicin": "trained", "meropenem": "trained", "ciprofloxacin": "insufficient_data"}
    gent = trained["gentamicin"]
    test = gent.metrics.where("split = 'test' and population = 'marginal'").first()
    assert test["resistant_recall"] >= 0.8
    top = [r["feature"] for r in gent.coefficients.orderBy(F.abs("coefficient").desc(), "feature").limit(5).collect()]
    assert "aac(3)-IIa" in top or "eng:has_ame" in top
    assert gent.coefficients.count() == 14
    assert gent.scores.groupBy("grp").agg(F.countDistinct("split").alias("k")).where("k > 1").count() == 0

    models, coefficients, registry = analysis.stored_models(spark, root)
    report, aside = analysis.analyse(hits, genomes, models, coefficients, registry, "2026-05-15.1")
    assert aside.count() == 0
    row = {p["antibiotic"]: p for p in report.where("genome_id = 'g005'").first()["predictions"]}
    assert (row["meropenem"]["verdict"], row["meropenem"]["category"], row["meropenem"]["set_labels"]) == (
        "likely_to_fail", "known_mechanism", None,
    )
    assert (row["ciprofloxacin"]["verdict"], row["ciprofloxacin"]["category"]) == ("no_call", "no_signal")
    scored = gent.scores.select("genome_id", "p")
    _, wrong = analysis.analyse(hits, genomes, models, coefficients, registry, "2020-01-01.1")
    assert wrong.count() == 120

    rows = gent.scores.select("antibiotic", "genome_id", "y", "grp", "gate_fired", "p").unionByName(
        trained["meropenem"].scores.select("antibiotic", "genome_id", "y", "grp", "gate_fired", "p")
    )
    out = analysis.evaluate(spark, root, rows, folds=3)
    assert out["comparison"].count() >= 4 and out["comparison"].where("not matches").count() == 0
    assert out["missing"].count() == 0
    assert out["slices"].where("slice_kind = 'overall'").count() == 2
    tampered = rows.withColumn("p", F.when(F.col("antibiotic") == "gentamicin", 1 - F.col("p")).otherwise(F.col("p")))
    again = analysis.evaluate(spark, root, tampered, folds=3)
    assert again["comparison"].where("antibiotic = 'gentamicin' and not matches").count() > 0

    redone = analysis.reevaluate(spark, root, hits, genomes, labels, meta, folds=3)
    assert redone["comparison"].count() >= 4 and redone["comparison"].where("not matches").count() == 0
    assert [r["antibiotic"] for r in redone["skipped"].collect()] == ["ciprofloxacin"]
    with pytest.raises(ValueError, match="stored features differ"):
        analysis.rescore(spark, root, hits.where("gene_symbol <> 'blaKPC-2'"), genomes, labels, meta)
    wrong = {
        "model": gent.model, "coefficients": gent.coefficients.withColumn("coefficient", -F.col("coefficient")),
        "metrics": gent.metrics, "conformal": gent.conformal, "evaluation": gent.evaluation, "scores": gent.scores,
    }
    store.save(spark, root, "gentamicin", wrong, status="trained", reason=None, db_version="2026-05-15.1")
    bad = analysis.reevaluate(spark, root, hits, genomes, labels, meta, folds=3)["comparison"]
    assert bad.where("antibiotic = 'gentamicin' and not matches").count() > 0
    assert bad.where("antibiotic = 'meropenem' and not matches").count() == 0

    head = trained["gentamicin"].model.join(trained["gentamicin"].conformal, "antibiotic").withColumn("version", F.lit("v1"))
    ranking = gent.coefficients.withColumn("rank", F.row_number().over(
        __import__("pyspark").sql.Window.partitionBy("antibiotic").orderBy(F.abs("coefficient").desc(), "feature")))
    card = store.model_cards(head, MO.headline(gent.metrics), ranking).first()
    assert card["slug"] == "gentamicin" and card["card"].startswith("# Model card -- gentamicin (v1)")
    assert card["card"].count("\n- `") == 10
    parts = [x for x in card["card"].split("\n") if x.startswith("## ")]
    assert parts == [
        "## Provenance", "## Headline metrics (test part, where the model serves)", "## Calibration",
        "## No-call behaviour", "## Largest coefficients",
    ]
    assert "(seed 0)" in card["card"] and "split degraded: " in card["card"] and "\n- n: " in card["card"]
    lines = {r["antibiotic"]: r for r in MO.summary(trained).collect()}
    assert set(lines) == {"gentamicin", "meropenem", "ciprofloxacin"}
    assert lines["ciprofloxacin"]["best_c"] is None and lines["ciprofloxacin"]["status"] == "insufficient_data"
    line = lines["gentamicin"]
    alphas = [x["alpha"] for x in line["alpha_sensitivity"]]
    assert alphas == sorted(alphas) and len(alphas) == len(fixed.ALPHA_GRID)
    own = [x for x in line["alpha_sensitivity"] if x["alpha"] == fixed.ALPHA][0]
    assert (line["coverage"], line["no_call_rate"]) == (own["coverage"], own["no_call_rate"])
    calibration = gent.scores.where("split = 'calibration'").toPandas()
    assert line["calibration_brier"] == pytest.approx(((calibration.p - calibration.y) ** 2).mean())
    assert line["population"] == "gate_negative" and lines["meropenem"]["n"] < 120
    assert scored.count() == 120
