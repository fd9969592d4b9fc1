"""Per-drug logistic models on sparse vectors: weighting, search, calibration, tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amrspark import fixed
from amrspark.functions import text
from amrspark.operators import conformal, groups, metrics, newton
from amrspark.operators.newton import Linear, Problem
from amrspark.session import cut


def _arrays(df: DataFrame, features: str, y: str, *more: str) -> DataFrame:
    """Rows for the Newton fits: v, y, w, and fold (-1 if not given)."""
    fold = F.col("fold").cast("int") if "fold" in more else F.lit(-1)
    return df.select(
        vector_to_array(features).alias("v"), F.col(y).cast("double").alias("y"), F.lit(1.0).alias("w"), fold.alias("fold")
    )


def fit_balanced(df: DataFrame, c: float, features: str = "features", y: str = "y") -> Linear:
    """L2 logistic regression with balanced class weights.

    The objective is `C * sum(loss) + |w|^2 / 2`; weights sum to the row count.
    """
    size = df.agg(F.count("*").alias("n"), F.sum(y).alias("pos"), F.first(F.size(vector_to_array(features))).alias("d")).first()
    n, pos = size["n"], size["pos"]
    problem = Problem(1.0 / c, None, n / (2.0 * pos), n / (2.0 * (n - pos)))
    return newton.fit(cut(_arrays(df, features, y)), [problem], size["d"])[0]


def largest_gradient(df: DataFrame, model: Linear, c: float, features: str = "features", y: str = "y") -> float:
    """Largest component, per row, of the gradient of the objective of `fit_balanced` at a model:
    near zero where it is the result. One row per feature reaches the driver."""
    sizes = df.agg(F.count("*").alias("n"), F.sum(y).alias("pos")).first()
    n, pos = sizes["n"], sizes["pos"]
    weight = F.when(F.col(y) == 1, n / (2.0 * pos)).otherwise(n / (2.0 * (n - pos)))
    chance = 1.0 / (1.0 + F.exp(-F.col("_f")))
    pull = (weight * (chance - F.col(y)) / n).alias("pull")
    rows = decision(df, model, features, "_f").select(pull, vector_to_array(features).alias("v"))
    values = F.transform(F.concat(F.array(F.lit(1.0)), "v"), lambda x: x * F.col("pull"))
    sums = rows.select(F.posexplode(values).alias("i", "g")).where("g <> 0").groupBy("i").agg(F.sum("g").alias("g"))
    by_place = {r["i"]: r["g"] for r in sums.collect()}
    kept = model.coefficients / (c * n)
    inner = [abs(by_place.get(i + 1, 0.0) + w) for i, w in enumerate(kept)]
    return float(max([abs(by_place.get(0, 0.0)), *inner]))


def decision(df: DataFrame, model: Linear, features: str = "features", out: str = "f") -> DataFrame:
    """Linear score of each row."""
    return newton.score(df.withColumn("_v", vector_to_array(features)), model, "_v", out).drop("_v")


def search_c(
    train: DataFrame,
    grid: tuple[float, ...] = fixed.C_GRID,
    folds: int = fixed.N_SPLITS,
    seed: int = 0,
) -> tuple[float, DataFrame]:
    """(best C, average precision per C and fold) by grouped folds; the first best of the grid wins.

    All models of the grid and folds are fitted together, one pass a step, and all held-out rows
    are scored and ranked in one job. Folds without both classes to train on are left out.
    """
    placed = groups.grouped_folds(train.withColumn("_d", F.lit(0)), ["_d"], k=folds, seed=seed, y="side")
    rows = cut(_arrays(placed, "features", "y", "fold"))
    sizes = rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("pos"), F.max(F.size("v")).alias("d")).collect()
    n, pos = sum(r["n"] for r in sizes), sum(r["pos"] for r in sizes)
    jobs = []
    for r in sorted(sizes, key=lambda r: r["fold"]):
        own, side = n - r["n"], pos - r["pos"]
        if 0 < side < own:
            jobs += [(c, r["fold"], Problem(1.0 / c, r["fold"], own / (2.0 * side), own / (2.0 * (own - side)))) for c in grid]
    fitted = newton.fit(rows, [p for _, _, p in jobs], max([r["d"] for r in sizes], default=0))
    scored = newton.held_out(rows, [(c, k, m) for (c, k, _), m in zip(jobs, fitted, strict=True)])
    scores = metrics.rank_metrics(scored, ["c", "fold"])
    scores = cut(scores.select("c", "fold", "pr_auc"))
    means = {r["c"]: r["m"] for r in scores.groupBy("c").agg(F.avg("pr_auc").alias("m")).collect()}
    ranked = [(means.get(c) if means.get(c) is not None else -1.0, -i) for i, c in enumerate(grid)]
    return grid[-max(ranked)[1]], scores


def fit_platt(scored: DataFrame, f: str = "f", y: str = "y") -> tuple[float, float]:
    """(slope, offset) of the sigmoid over the linear score of a frozen model.

    Smoothed targets make each row two weighted rows of an unpenalised one-feature regression. The
    score is brought to mean 0 and deviation 1 for the fit, so that scores of any size fit alike.
    """
    sizes = scored.agg(
        F.count("*").alias("n"), F.sum(y).alias("pos"), F.avg(f).alias("m"), F.stddev_pop(f).alias("sd")
    ).first()
    pos, neg = sizes["pos"] or 0, sizes["n"] - (sizes["pos"] or 0)
    if min(pos, neg) < 2:
        raise ValueError("calibration needs two rows of each class")
    target = F.when(F.col(y) == 1, (pos + 1.0) / (pos + 2.0)).otherwise(1.0 / (neg + 2.0))
    pair = F.array(
        F.struct(F.lit(1.0).alias("y"), target.alias("w")),
        F.struct(F.lit(0.0).alias("y"), (1.0 - target).alias("w")),
    )
    middle, spread = sizes["m"], sizes["sd"] or 1.0
    rows = scored.select(F.array((F.col(f) - middle) / spread).alias("v"), F.lit(-1).alias("fold"), F.inline(pair))
    model = newton.fit(cut(rows), [Problem(0.0)], 1)[0]
    slope = float(model.coefficients[0]) / spread
    return slope, model.intercept - slope * middle


@dataclass
class Trained:
    """Tables of one drug; all but `status` are None when no model could be built."""

    status: DataFrame
    model: DataFrame | None = None
    coefficients: DataFrame | None = None
    scores: DataFrame | None = None
    metrics: DataFrame | None = None
    conformal: DataFrame | None = None
    evaluation: DataFrame | None = None
    search: DataFrame | None = None


def _status(spark, drug: str, status: str, reason: str | None) -> DataFrame:
    return spark.createDataFrame(
        [(drug, status, reason)], "antibiotic string, status string, reason string"
    )


def train_drug(
    rows: DataFrame,
    drug: str,
    names: list[str],
    *,
    grid: tuple[float, ...] = fixed.C_GRID,
    folds: int = fixed.N_SPLITS,
    alpha: float = fixed.ALPHA,
    seed: int = 0,
) -> Trained:
    """Split, search, fit, calibrate, score once, then measure.

    `rows`: genome_id, features (vector over `names`), side (R or S), grp, gate_fired.
    """
    spark = rows.sparkSession
    base = rows.select(
        F.lit(drug).alias("antibiotic"), "genome_id", "features", "side", "grp", "gate_fired",
        (F.col("side") == "R").cast("int").alias("y"),
    )
    split, status = groups.make_split(
        base.withColumnRenamed("y", "_y").withColumnRenamed("side", "y"), ["antibiotic"], k=folds, seed=seed
    )
    line = status.first()  # one row per drug
    if line is None or line["reason"] is not None:
        reason = line["reason"] if line else "no labelled genome"
        return Trained(_status(spark, drug, "insufficient_data", reason))
    split = cut(split.withColumnRenamed("y", "side").withColumnRenamed("_y", "y"))
    groups.require_no_leakage(split, ["antibiotic"])
    train = split.where(F.col("split") == "train").drop("split")
    cal = split.where(F.col("split") == "calibration")
    sides = cal.agg(F.count_if(F.col("y") == 1).alias("r"), F.count_if(F.col("y") == 0).alias("s")).first()
    if min(sides["r"], sides["s"]) < 2:
        reason = "calibration fold has <2 samples of a class; cannot fit a reliable calibrator"
        return Trained(_status(spark, drug, "insufficient_data", reason))
    both = train.agg(F.countDistinct("side").alias("k")).first()["k"]
    if both < 2:
        return Trained(_status(spark, drug, "insufficient_data", "training part has one class"))
    best_c, search = search_c(train, grid, folds, seed)
    model = fit_balanced(train, best_c)
    if not model.converged:
        return Trained(_status(spark, drug, "not_converged", f"largest gradient {model.gradient:.3g}"))
    slope, offset = fit_platt(decision(cal, model))
    p = 1.0 / (1.0 + F.exp(-(F.lit(slope) * F.col("f") + F.lit(offset))))
    scored = cut(
        decision(split, model)
        .withColumn("p", p)
        .select("antibiotic", "genome_id", "grp", "split", "gate_fired", "y", "p")
    )
    measured = metrics.classification_metrics(
        metrics.with_populations(scored.where(F.col("split").isin("test", "holdout"))),
        ["antibiotic", "split", "population"],
    )
    fitted = cut(conformal.fit(scored.where(F.col("split") == "calibration"), ["antibiotic"], (alpha,)))
    evaluation = conformal.alpha_table(
        scored.where(F.col("split") == "calibration"),
        scored.where(F.col("split") == "test"),
        ["antibiotic"],
    )
    balance = groups.split_balance(split, ["antibiotic"], y="side")
    degraded = bool(balance.agg(F.max("degraded")).first()[0])
    gap = F.col("p") - F.col("y")
    brier = scored.where(F.col("split") == "calibration").agg(F.avg(gap * gap)).first()[0]
    weights = spark.createDataFrame(
        [(drug, n, float(w)) for n, w in zip(names, model.coefficients, strict=True)],
        "antibiotic string, feature string, coefficient double",
    )
    header = spark.createDataFrame(
        [
            (
                drug, best_c, model.intercept, slope, offset, line["n_resistant"],
                line["n_susceptible"], line["n_groups"], model.gradient, seed, degraded, brier,
            )
        ],
        "antibiotic string, best_c double, intercept double, platt_a double, platt_b double, "
        "n_resistant long, n_susceptible long, n_groups long, largest_gradient double, "
        "seed int, degraded boolean, calibration_brier double",
    )
    return Trained(
        _status(spark, drug, "trained", None), header, weights, scored, measured, fitted,
        evaluation, search,
    )


def train_panel(
    matrix: DataFrame,
    labels: DataFrame,
    group_of: DataFrame,
    fired: DataFrame,
    names: list[str],
    drugs: tuple[str, ...] = fixed.PANEL,
    **options,
) -> dict[str, Trained]:
    """Train each drug in turn. The loop is over the panel; every step inside is a job.

    `matrix`: genome_id, features. `labels`: genome_id, antibiotic, sir. `group_of`: genome_id, grp.
    `fired`: genome_id, antibiotic, gate_fired.
    """
    binary = labels.withColumn("side", text.binary_side("sir")).where(F.col("side").isNotNull())
    rows = (
        binary.select("genome_id", "antibiotic", "side")
        .join(matrix, "genome_id")
        .join(group_of, "genome_id")
        .join(fired.select("genome_id", "antibiotic", "gate_fired"), ["genome_id", "antibiotic"], "left")
        .withColumn("gate_fired", F.coalesce("gate_fired", F.lit(False)))
    )
    rows = cut(rows)
    return {d: train_drug(rows.where(F.col("antibiotic") == d), d, names, **options) for d in drugs}


def headline(measured: DataFrame) -> DataFrame:
    """One row of metrics per drug: of the test part, the rows that the model serves (where the gate
    is quiet), or all rows where there are none of these."""
    rows = measured.where((F.col("split") == "test") & (F.col("n") > 0))
    served = F.when(F.col("population") == "gate_negative", 0).otherwise(1)
    row = F.min_by(F.struct(*[c for c in measured.columns if c != "antibiotic"]), served).alias("m")
    return rows.groupBy("antibiotic").agg(row).select("antibiotic", "m.*")


def summary(trained: dict[str, Trained]) -> DataFrame:
    """The training summary: one row per drug, also for those without a model.

    antibiotic, status, reason, best_c, calibration_brier, the headline metrics, coverage and
    no-call rate on the test part, whether the guarantee holds, and `alpha_sensitivity`, an array of
    (alpha, coverage, no_call_rate) by alpha.
    """
    built = [t for t in trained.values() if t.model is not None]
    status = reduce(DataFrame.unionByName, [t.status for t in trained.values()])
    if not built:
        return status

    def table(name: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [getattr(t, name) for t in built])

    by_alpha = F.array_sort(F.collect_list(F.struct("alpha", "coverage", "no_call_rate")))
    sensitivity = table("evaluation").groupBy("antibiotic").agg(by_alpha.alias("alpha_sensitivity"))
    test = table("scores").where(F.col("split") == "test")
    own = conformal.evaluate(test, table("conformal"), ["antibiotic"]).select("antibiotic", "coverage", "no_call_rate")
    best = headline(table("metrics")).select(
        "antibiotic", "population", "n", "resistant_recall", "susceptible_recall", "balanced_accuracy", "auroc", "pr_auc"
    )
    parts = [
        table("model").select("antibiotic", "best_c", "calibration_brier"), best, own,
        table("conformal").select("antibiotic", "guarantee"), sensitivity,
    ]
    return reduce(lambda a, b: a.join(b, "antibiotic", "left"), parts, status)
