"""Class-conditional conformal thresholds and their behaviour on other rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amrspark import fixed
from amrspark.functions import text
from amrspark.operators.decide import sets_of
from amrspark.operators.ranking import weighted_quantile_rows


def _rank(alpha: float) -> Column:
    return F.ceil((F.col("n") + 1) * F.lit(1.0 - alpha))


def _floor(alpha: float) -> int:
    return max(1, math.ceil(1.0 / alpha) - 1)


def fit(df: DataFrame, by: list[str], alphas: tuple[float, ...] = (fixed.ALPHA,)) -> DataFrame:
    """Thresholds per key and alpha: the k-th smallest score of each class, 1.0 when k > n.

    A row scores `1 - p` under R and `p` under S. All alphas come from one pass.
    """
    rows = df.select(
        *by,
        F.when(F.col("y") == 1, "R").otherwise("S").alias("cls"),
        F.when(F.col("y") == 1, 1 - F.col("p")).otherwise(F.col("p")).alias("score"),
        F.lit(1).cast("bigint").alias("w"),
    )
    ranks = {f"t{i}": _rank(a) for i, a in enumerate(alphas)}
    tau = weighted_quantile_rows(rows, [*by, "cls"], "score", "w", ranks)

    def side(cls: str, column: str, missing) -> Column:
        return F.coalesce(F.max(F.when(F.col("cls") == cls, F.col(column))), F.lit(missing))

    wide = tau.groupBy(*by).agg(
        side("S", "n", 0).alias("ns"),
        side("R", "n", 0).alias("nr"),
        *[side(c, f"t{i}", 1.0).alias(f"{c}{i}") for i in range(len(alphas)) for c in "SR"],
    )
    entries = [
        F.struct(
            F.lit(a).alias("alpha"),
            F.col(f"S{i}").alias("tau_s"),
            F.col(f"R{i}").alias("tau_r"),
            F.col("ns").alias("n_cal_susceptible"),
            F.col("nr").alias("n_cal_resistant"),
            ((F.col("ns") >= _floor(a)) & (F.col("nr") >= _floor(a))).alias("guarantee"),
        )
        for i, a in enumerate(alphas)
    ]
    return wide.select(*by, F.inline(F.array(*entries)))


def predict_sets(df: DataFrame, fitted: DataFrame, by: list[str]) -> DataFrame:
    """Rows with `in_s`, `in_r`, `alpha`; `fitted` has one line per key and alpha."""
    joined = df.join(fitted.select(*by, "alpha", "tau_s", "tau_r"), by)
    in_s, in_r = sets_of(F.col("p"), F.col("tau_s"), F.col("tau_r"))
    return joined.withColumns({"in_s": in_s, "in_r": in_r}).drop("tau_s", "tau_r")


def evaluate(df: DataFrame, fitted: DataFrame, by: list[str]) -> DataFrame:
    """Coverage, no-call, empty, ambiguous rates and accuracy on called rows per key and alpha.

    A key without rows has n 0, rates 0.0 and no accuracy.
    """
    rows = predict_sets(df.select(*by, "p", "y"), fitted, by)
    in_s, in_r, resistant = F.col("in_s"), F.col("in_r"), F.col("y") == 1
    covered = F.when(resistant, in_r).otherwise(in_s)
    called = in_s != in_r

    def rate(condition: Column) -> Column:
        return F.avg(condition.cast("double"))

    found = rows.groupBy(*by, "alpha").agg(
        F.count("*").alias("n"),
        F.count_if(called).alias("n_called"),
        rate(covered).alias("coverage"),
        rate(~called).alias("no_call_rate"),
        rate(~in_s & ~in_r).alias("empty_rate"),
        rate(in_s & in_r).alias("ambiguous_rate"),
        F.avg(F.when(called, covered.cast("double"))).alias("accuracy_on_called"),
    )
    joined = fitted.select(*by, "alpha").join(found, [*by, "alpha"], "left")
    filled = joined.fillna(0, ["n", "n_called"])
    return filled.fillna(0.0, ["coverage", "no_call_rate", "empty_rate", "ambiguous_rate"])


def alpha_table(
    calibration: DataFrame,
    test: DataFrame,
    by: list[str],
    alphas: tuple[float, ...] = fixed.ALPHA_GRID,
) -> DataFrame:
    return evaluate(test, fit(calibration, by, alphas), by)


def marginal_coverage(
    calibration: DataFrame, test: DataFrame, by: list[str], alpha: float = fixed.ALPHA
) -> DataFrame:
    """Coverage of a single threshold over both classes, a cross-check of the per-class one."""
    own = F.when(F.col("y") == 1, 1 - F.col("p")).otherwise(F.col("p"))
    rows = calibration.select(*by, own.alias("score"), F.lit(1).cast("bigint").alias("w"))
    tau = weighted_quantile_rows(rows, by, "score", "w", {"tau": _rank(alpha)})
    tau = tau.select(*by, F.coalesce("tau", F.lit(1.0)).alias("tau"))
    return (
        test.join(tau, by)
        .groupBy(*by)
        .agg(F.first("tau").alias("tau"), F.avg((own <= F.col("tau")).cast("double")).alias("coverage"))
    )


def verdict_counts(df: DataFrame, fitted: DataFrame, by: list[str]) -> DataFrame:
    rows = predict_sets(df, fitted, by)
    verdict = text.verdict_of_set(F.col("in_s"), F.col("in_r")).alias("verdict")
    return rows.groupBy(*by, "alpha", verdict).agg(F.count("*").alias("n"))
