"""Versioned model tables: one folder per drug and version, and a status table."""

from __future__ import annotations

import os

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amrspark import fixed
from amrspark.functions import text

REGISTRY = (
    "antibiotic string, version int, status string, reason string, db_version string, "
    "schema_version string, engineered_version string"
)


def latest(versions: DataFrame, key: str = "antibiotic") -> DataFrame:
    """Highest `v<N>` per drug by number, not by text; other names are ignored."""
    n = F.regexp_extract("version", r"^v(\d+)$", 1).try_cast("int")
    rows = versions.withColumn("_n", n).where(F.col("_n").isNotNull())
    return rows.groupBy(key).agg(F.max_by("version", "_n").alias("version"))


def registry(spark: SparkSession, root: str) -> DataFrame:
    """All registry lines; a store that holds nothing yet has none."""
    try:
        return spark.read.schema(REGISTRY).option("recursiveFileLookup", True).parquet(f"{root}/registry")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], REGISTRY)


def current(registry_rows: DataFrame) -> DataFrame:
    """The newest registry line of each drug."""
    fields = [c for c in registry_rows.columns if c != "antibiotic"]
    newest = F.max_by(F.struct(*fields), "version").alias("r")
    return registry_rows.groupBy("antibiotic").agg(newest).select("antibiotic", "r.*")


def save(
    spark: SparkSession,
    root: str,
    drug: str,
    tables: dict[str, DataFrame],
    *,
    status: str = "trained",
    reason: str | None = None,
    db_version: str | None = None,
) -> int:
    """Write the tables of one drug under a new version and record it.

    The version is claimed by creating a file that must not exist, so writers at the same time get
    different versions. The registry line comes last and in a folder of its own: a version that a
    lost job has claimed but not finished is never seen, and its number is not used again.
    """
    mine = registry(spark, root).where(F.col("antibiotic") == drug)
    version = _claim(spark, f"{root}/claims/{_folder(drug)}", (mine.agg(F.max("version")).first()[0] or 0) + 1)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/{_folder(drug)}/v{version}")
    line = spark.createDataFrame(
        [(drug, version, status, reason, db_version, fixed.SCHEMA_VERSION, fixed.ENGINEERED_VERSION)],
        REGISTRY,
    )
    line.coalesce(1).write.mode("overwrite").parquet(f"{root}/registry/{_folder(drug)}/v{version}")
    return version


def _claim(spark: SparkSession, folder: str, version: int) -> int:
    """The first version from `version` on that nobody has claimed.

    Creating a file without overwriting is atomic on file systems with a name node; it fails where
    the file exists. Spark's local file system looks first and creates then, so on local disks the
    operating system creates the file.
    """
    jvm = spark.sparkContext._jvm
    while True:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/v{version}")
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if system.getUri().getScheme() == "file":
            local = system.makeQualified(path).toUri().getPath()
            os.makedirs(os.path.dirname(local), exist_ok=True)
            try:
                open(local, "x").close()
                return version
            except FileExistsError:
                version += 1
                continue
        try:
            system.create(path, False).close()
            return version
        except Py4JJavaError:
            if not system.exists(path):
                raise
            version += 1


def load(spark: SparkSession, root: str, drug: str, name: str, version: int | None = None) -> DataFrame:
    if version is None:
        row = current(registry(spark, root)).where(F.col("antibiotic") == drug).first()
        if row is None:
            raise LookupError(f"no model for {drug}")
        version = row["version"]
    return spark.read.parquet(f"{root}/{name}/{_folder(drug)}/v{version}")


def _folder(drug: str) -> str:
    return "".join(c if c.isalnum() else "-" for c in drug.lower()).strip("-")


def _fmt(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.format_string("%.3f", c), F.lit("n/a"))


def model_cards(models: DataFrame, metrics: DataFrame, coefficients: DataFrame, top: int = 10) -> DataFrame:
    """One text card per trained drug from its tables.

    `models`: antibiotic, version, best_c, n_resistant, n_susceptible, n_groups, seed, degraded,
    calibration_brier, alpha, tau_s, tau_r, n_cal_susceptible, n_cal_resistant, guarantee.
    `metrics`: per drug, headline row (n, n_resistant, n_susceptible and the rates).
    `coefficients`: antibiotic, feature, coefficient, rank.
    """
    line = F.format_string("- `%s`: %+.3f", "feature", "coefficient")
    heads = (
        coefficients.where(F.col("rank") <= top)
        .groupBy("antibiotic")
        .agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("t")))).alias("_c"))
    )
    measured = metrics.select(
        "antibiotic", F.col("n").alias("_n"), F.col("n_resistant").alias("_r"), F.col("n_susceptible").alias("_s"),
        "resistant_recall", "susceptible_recall", "balanced_accuracy", "auroc", "pr_auc",
    )
    rows = models.join(measured, "antibiotic", "left").join(heads, "antibiotic", "left")

    def section(title: str, *lines: Column) -> Column:
        return F.array(F.lit(""), F.lit(f"## {title}"), *lines)

    none = F.array().cast("array<string>")
    head = F.array(
        F.concat(F.lit("# Model card -- "), F.col("antibiotic"), F.lit(" ("), F.col("version"), F.lit(")")),
        F.lit(""),
        F.lit(fixed.DISCLAIMER),
    )
    provenance = section(
        "Provenance",
        F.format_string("- best C: %s", F.col("best_c").cast("string")),
        F.format_string("- labels: %d R / %d S", "n_resistant", "n_susceptible"),
        F.format_string("- homology groups: %d (seed %d)", "n_groups", "seed"),
        F.concat(F.lit("- split degraded: "), F.col("degraded").cast("string")),
    )
    told = section(
        "Headline metrics (test part, where the model serves)",
        F.format_string("- n: %d (%d R / %d S)", "_n", "_r", "_s"),
        F.concat(F.lit("- resistant recall: "), _fmt("resistant_recall")),
        F.concat(F.lit("- susceptible recall: "), _fmt("susceptible_recall")),
        F.concat(F.lit("- balanced accuracy: "), _fmt("balanced_accuracy")),
        F.concat(F.lit("- AUROC: "), _fmt("auroc"), F.lit(" | PR-AUC: "), _fmt("pr_auc")),
    )
    calibrated = section("Calibration", F.concat(F.lit("- Brier score: "), _fmt("calibration_brier")))
    behaviour = section(
        "No-call behaviour",
        F.concat(F.lit("- alpha: "), F.col("alpha").cast("string")),
        F.concat(F.lit("- tau_s: "), _fmt("tau_s"), F.lit(" | tau_r: "), _fmt("tau_r")),
        F.format_string("- calibration counts: %d S / %d R", "n_cal_susceptible", "n_cal_resistant"),
        F.concat(F.lit("- finite-sample guarantee available: "), F.col("guarantee").cast("string")),
    )
    weights = F.concat(section("Largest coefficients"), F.transform("_c", lambda x: x["t"]))
    lines = F.concat(
        head, provenance, F.when(F.col("_n").isNotNull(), told).otherwise(none), calibrated, behaviour,
        F.coalesce(weights, none), F.array(F.lit("")),
    )
    return rows.select(
        "antibiotic", text.slug("antibiotic").alias("slug"), F.array_join(lines, "\n").alias("card")
    )
