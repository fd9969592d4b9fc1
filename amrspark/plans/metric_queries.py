"""Metrics and conformal sets over `orders` seen as scored genomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from amrspark import fixed
from amrspark.operators import conformal as C
from amrspark.operators import metrics as M
from amrspark.plans import bindings as B


def _exprs(h):
    return [
        "cast(o_orderkey as string) AS genome_id",
        "o_orderpriority AS drug",
        "concat('n', cast(c_nationkey as string)) AS grp",
        "case o_orderstatus when 'F' then 1 else 0 end AS y",
        f"({h('cast(o_orderkey as string)')} % 701 + case o_orderstatus when 'F' then 300 else 0 end)"
        " / 1000 AS p",
        "case when c_nationkey = 7 then 'holdout' when o_orderkey % 3 = 0 then 'calibration' "
        "else 'test' end AS split",
        "o_totalprice > 300000 AS gate_fired",
    ]


_FROM = "orders JOIN customer ON o_custkey = c_custkey"
SCORED = (
    f"scored AS (SELECT {', '.join(_exprs(B.duck_hash))} FROM {_FROM} "
    "WHERE o_orderstatus IN ('F', 'O'))"
)


def scored(spark, sf_dir):
    orders = B.table(spark, sf_dir, "orders").where("o_orderstatus IN ('F', 'O')")
    customer = B.table(spark, sf_dir, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        *_exprs(B.spark_hash)
    )


def _round(df, *columns):
    """Squared three-digit scores have long finite decimals, hence more digits for the Brier mean."""
    return df.withColumns({c: F.round(c, 12 if c == "brier" else 9) for c in columns})


def binary_metrics(spark, sf_dir):
    out = M.confusion_metrics(scored(spark, sf_dir), ["drug"])
    return _round(out, "balanced_accuracy", "resistant_recall", "susceptible_recall", "f1", "brier")


def auroc(spark, sf_dir):
    return _round(M.rank_metrics(scored(spark, sf_dir), ["drug"]).drop("pr_auc"), "auroc")


def average_precision(spark, sf_dir):
    return _round(M.rank_metrics(scored(spark, sf_dir), ["drug"]).drop("auroc"), "pr_auc")


def metric_slices(spark, sf_dir):
    served = scored(spark, sf_dir).where(~F.col("gate_fired"))
    out = M.classification_metrics(M.with_slices(served), ["drug", "slice_kind", "slice"])
    return _round(out, *M.METRICS, "brier")


def metric_populations(spark, sf_dir):
    rows = scored(spark, sf_dir).where("split IN ('test', 'holdout')")
    out = M.classification_metrics(M.with_populations(rows), ["drug", "split", "population"])
    return _round(out, *M.METRICS, "brier")


def reliability(spark, sf_dir):
    out = M.reliability_bins(scored(spark, sf_dir), ["drug"])
    return _round(out, "bin_lower", "bin_upper", "mean_predicted", "fraction_positive")


def calibration_curve(spark, sf_dir):
    out = M.calibration_curve(scored(spark, sf_dir), ["drug"])
    return _round(out, "mean_predicted", "fraction_positive")


def metric_compare(spark, sf_dir):
    """Published metrics of one drug moved by 0.1 must be reported."""
    got = M.classification_metrics(scored(spark, sf_dir), ["drug"])
    published = got.withColumn(
        "f1", F.when(F.col("drug") == "5-LOW", F.col("f1") + 0.1).otherwise(F.col("f1"))
    )
    return _round(M.compare_metrics(published, got, ["drug"]), "max_abs_delta")


def metric_set_mismatch(spark, sf_dir):
    rows = M.with_slices(scored(spark, sf_dir))
    keys = ["drug", "slice"]
    published = rows.where("slice <> 'n3'").select(*keys)
    got = rows.where("slice <> 'n4'").select(*keys)
    return M.set_mismatch(published, got, keys)


def _parts(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return rows.where("split = 'calibration'"), rows.where("split = 'test'")


def conformal_fit(spark, sf_dir):
    return C.fit(_parts(spark, sf_dir)[0], ["drug", "grp"])


def conformal_eval(spark, sf_dir):
    cal, test = _parts(spark, sf_dir)
    out = C.evaluate(test, C.fit(cal, ["drug"]), ["drug"])
    return _round(out, *out.columns[4:])


def alpha_grid(spark, sf_dir):
    cal, test = _parts(spark, sf_dir)
    out = C.alpha_table(cal, test, ["drug"])
    return _round(out, *out.columns[4:])


def marginal_coverage(spark, sf_dir):
    return _round(C.marginal_coverage(*_parts(spark, sf_dir), ["drug"]), "coverage")


def conformal_verdicts(spark, sf_dir):
    cal, test = _parts(spark, sf_dir)
    return C.verdict_counts(test, C.fit(cal, ["drug"]), ["drug"])


def fingerprint(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return M.fingerprint(rows, rows.select("drug").distinct())


QUERIES = {
    f.__name__: f
    for f in (
        binary_metrics, auroc, average_precision, metric_slices, metric_populations, reliability,
        calibration_curve, metric_compare, metric_set_mismatch, conformal_fit, conformal_eval,
        alpha_grid, marginal_coverage, conformal_verdicts, fingerprint,
    )
}


def _metrics_sql(source: str, keys: str) -> str:
    """Confusion and rank metrics of `source` by `keys`, as CTEs ending in `m`."""
    return f"""c AS (SELECT {keys}, count(*) AS n, count(*) FILTER (WHERE y = 1) AS n_resistant,
        count(*) FILTER (WHERE y = 0) AS n_susceptible,
        count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp,
        count(*) FILTER (WHERE y = 0 AND p < 0.5) AS tn,
        count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp,
        avg((p - y) * (p - y)) AS brier FROM {source} GROUP BY {keys}),
      lv AS (SELECT {keys}, p, sum(y) AS pos, sum(1 - y) AS neg FROM {source} GROUP BY {keys}, p),
      cu AS (SELECT *, sum(pos) OVER (PARTITION BY {keys} ORDER BY p DESC) AS tpc,
        sum(neg) OVER (PARTITION BY {keys} ORDER BY p DESC) AS fpc,
        coalesce(sum(neg) OVER (PARTITION BY {keys} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING
          AND 1 PRECEDING), 0) AS below FROM lv),
      rk AS (SELECT {keys},
        sum(pos * (below + neg / 2.0::double)) / nullif(sum(pos) * sum(neg), 0) AS auroc,
        sum(pos * tpc / (tpc + fpc)) / nullif(sum(pos), 0) AS pr_auc FROM cu GROUP BY {keys}),
      m AS (SELECT {keys}, n, n_resistant, n_susceptible,
        n_resistant = 0 OR n_susceptible = 0 AS single_class,
        round(CASE WHEN n_resistant = 0 OR n_susceptible = 0 THEN (tp + tn) / n
          ELSE (tp / n_resistant + tn / n_susceptible) / 2 END, 9) AS balanced_accuracy,
        round(CASE WHEN n_resistant = 0 THEN 0.0::double ELSE tp / n_resistant END, 9)
          AS resistant_recall,
        round(CASE WHEN n_susceptible = 0 THEN 0.0::double ELSE tn / n_susceptible END, 9)
          AS susceptible_recall,
        round(CASE WHEN tp + fp + n_resistant = 0 THEN 0.0::double
          ELSE 2 * tp / (tp + fp + n_resistant) END, 9) AS f1,
        round(brier, 12) AS brier, round(auroc, 9) AS auroc, round(pr_auc, 9) AS pr_auc
        FROM c JOIN rk USING ({keys}))"""


_SLICED = """sliced AS (SELECT *, 'overall' AS slice_kind, 'overall' AS slice FROM served
  WHERE split = 'test' UNION ALL SELECT *, 'group', grp FROM served WHERE split = 'test'
  UNION ALL SELECT *, 'holdout', grp FROM served WHERE split = 'holdout')"""


def _fit_sql(keys: str, alphas: str) -> str:
    return f"""al AS (SELECT unnest([{alphas}]::double[]) AS alpha),
      sc AS (SELECT {keys}, y, CASE WHEN y = 1 THEN 1 - p ELSE p END AS s, row_number() OVER (
        PARTITION BY {keys}, y ORDER BY CASE WHEN y = 1 THEN 1 - p ELSE p END) AS r,
        count(*) OVER (PARTITION BY {keys}, y) AS n FROM scored WHERE split = 'calibration'),
      q AS (SELECT {keys}, alpha, y, any_value(n) AS n,
        max(s) FILTER (WHERE r = ceil((n + 1) * (1.0::double - alpha))) AS t
        FROM sc CROSS JOIN al GROUP BY {keys}, alpha, y),
      fit AS (SELECT {keys}, alpha, coalesce(max(t) FILTER (WHERE y = 0), 1.0::double) AS tau_s,
        coalesce(max(t) FILTER (WHERE y = 1), 1.0::double) AS tau_r,
        coalesce(max(n) FILTER (WHERE y = 0), 0) AS n_cal_susceptible,
        coalesce(max(n) FILTER (WHERE y = 1), 0) AS n_cal_resistant FROM q
        GROUP BY {keys}, alpha)"""


_EVAL_SQL = """SELECT drug, alpha, count(p) AS n, count(*) FILTER (WHERE s <> r) AS n_called,
    round(avg(cov), 9) AS coverage, round(avg(cast(s = r AS double)), 9) AS no_call_rate,
    round(avg(cast(NOT s AND NOT r AS double)), 9) AS empty_rate,
    round(avg(cast(s AND r AS double)), 9) AS ambiguous_rate,
    round(avg(cov) FILTER (WHERE s <> r), 9) AS accuracy_on_called
  FROM (SELECT drug, alpha, p, p <= tau_s AS s, 1 - p <= tau_r AS r,
    cast(CASE WHEN y = 1 THEN 1 - p <= tau_r ELSE p <= tau_s END AS double) AS cov
    FROM scored JOIN fit USING (drug) WHERE split = 'test') GROUP BY ALL"""

SQL = {
    "binary_metrics": f"WITH {SCORED}, {_metrics_sql('scored', 'drug')} "
    "SELECT * EXCLUDE (auroc, pr_auc) FROM m",
    "auroc": f"WITH {SCORED}, {_metrics_sql('scored', 'drug')} SELECT drug, auroc FROM m",
    "average_precision": f"WITH {SCORED}, {_metrics_sql('scored', 'drug')} "
    "SELECT drug, pr_auc FROM m",
    "metric_slices": f"""WITH {SCORED}, served AS (SELECT * FROM scored WHERE NOT gate_fired),
      {_SLICED}, {_metrics_sql('sliced', 'drug, slice_kind, slice')} SELECT * FROM m""",
    "metric_populations": f"""WITH {SCORED}, pops AS (SELECT *, 'marginal' AS population FROM scored
        WHERE split <> 'calibration' UNION ALL SELECT *, 'gate_negative' FROM scored
        WHERE split <> 'calibration' AND NOT gate_fired),
      {_metrics_sql('pops', 'drug, split, population')} SELECT * FROM m""",
    "reliability": f"""WITH {SCORED},
      b AS (SELECT drug, p, y, cast(list_sum(list_transform(range(1, 10),
        lambda i: cast(i * 0.1::double <= p AS int))) AS int) AS bin FROM scored),
      spine AS (SELECT DISTINCT drug, cast(unnest(range(10)) AS int) AS bin FROM scored)
      SELECT drug, bin, round(bin * 0.1::double, 9) AS bin_lower,
        round((bin + 1) * 0.1::double, 9) AS bin_upper, count(p) AS n,
        round(avg(p), 9) AS mean_predicted, round(avg(y), 9) AS fraction_positive
      FROM spine LEFT JOIN b USING (drug, bin) GROUP BY drug, bin""",
    "calibration_curve": f"""WITH {SCORED}
      SELECT drug, cast(list_sum(list_transform(range(1, 10),
        lambda i: cast(i * 0.1::double < p AS int))) AS int) AS bin,
        round(avg(p), 9) AS mean_predicted, round(avg(y), 9) AS fraction_positive
      FROM scored GROUP BY ALL""",
    "metric_compare": f"""WITH {SCORED} SELECT DISTINCT drug,
      CASE WHEN drug = '5-LOW' THEN round(0.1::double, 9) ELSE 0.0::double END AS max_abs_delta,
      drug <> '5-LOW' AS matches FROM scored""",
    "metric_set_mismatch": f"""WITH {SCORED}, served AS (SELECT * FROM scored), {_SLICED},
      a AS (SELECT DISTINCT drug, slice FROM sliced)
      SELECT drug, slice, CASE slice WHEN 'n3' THEN 'only_got' ELSE 'only_expected' END AS side
      FROM a WHERE slice IN ('n3', 'n4')""",
    "conformal_fit": f"""WITH {SCORED}, {_fit_sql('drug, grp', '0.1')}
      SELECT *, n_cal_susceptible >= 9 AND n_cal_resistant >= 9 AS guarantee FROM fit""",
    "conformal_eval": f"WITH {SCORED}, {_fit_sql('drug', '0.1')} {_EVAL_SQL}",
    "alpha_grid": f"WITH {SCORED}, {_fit_sql('drug', '0.05, 0.1, 0.2')} {_EVAL_SQL}",
    "marginal_coverage": f"""WITH {SCORED},
      s AS (SELECT drug, split, CASE WHEN y = 1 THEN 1 - p ELSE p END AS s FROM scored),
      o AS (SELECT drug, s, row_number() OVER (PARTITION BY drug ORDER BY s) AS r,
        count(*) OVER (PARTITION BY drug) AS n FROM s WHERE split = 'calibration'),
      t AS (SELECT drug, max(s) AS tau FROM o WHERE r = ceil((n + 1) * (1.0::double - 0.1::double))
        GROUP BY drug)
      SELECT drug, tau, round(avg(cast(s <= tau AS double)), 9) AS coverage
      FROM s JOIN t USING (drug) WHERE split = 'test' GROUP BY drug, tau""",
    "conformal_verdicts": f"""WITH {SCORED}, {_fit_sql('drug', '0.1')}
      SELECT drug, alpha, CASE WHEN p <= tau_s AND NOT 1 - p <= tau_r THEN 'likely_to_work'
        WHEN 1 - p <= tau_r AND NOT p <= tau_s THEN 'likely_to_fail' ELSE 'no_call' END AS verdict,
        count(*) AS n FROM scored JOIN fit USING (drug) WHERE split = 'test' GROUP BY ALL""",
    "fingerprint": f"""WITH {SCORED}, i AS (SELECT DISTINCT genome_id FROM scored)
      SELECT count(*) AS n_genomes, (SELECT count(DISTINCT drug) FROM scored) AS n_features,
        sha256(string_agg(cast(genome_id AS varchar), chr(10) ORDER BY genome_id)) AS genome_ids_sha256, cast(sum(cast('0x' || substr(sha256(genome_id), 1, 12)
        AS hugeint)) AS string) AS hash_sum FROM i""",
}
