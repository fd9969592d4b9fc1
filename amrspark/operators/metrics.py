"""Metrics of scored rows (`y` 1 or 0, `p` in [0, 1]) per drug and slice.

Threshold metrics are plain conditional sums. Rank metrics first add up equal scores, then use
bucketed running sums, so a drug holding most rows is not ranked by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amrspark import fixed
from amrspark.operators.ranking import cumulative, streamed_digest

METRICS = (
    "balanced_accuracy", "resistant_recall", "susceptible_recall", "f1", "auroc", "pr_auc",
)


def confusion_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    y, hit = F.col("y") == 1, F.col("p") >= 0.5
    c = df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(y).alias("n_resistant"),
        F.count_if(~y).alias("n_susceptible"),
        F.count_if(y & hit).alias("tp"),
        F.count_if(~y & ~hit).alias("tn"),
        F.count_if(~y & hit).alias("fp"),
        F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"),
    )
    zero = F.lit(0.0)
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("n_resistant")), zero)
    spec = F.coalesce(F.try_divide(F.col("tn"), F.col("n_susceptible")), zero)
    single = (F.col("n_resistant") == 0) | (F.col("n_susceptible") == 0)
    f1 = F.coalesce(
        F.try_divide(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("n_resistant")), zero
    )
    return c.select(
        *by,
        "n",
        "n_resistant",
        "n_susceptible",
        single.alias("single_class"),
        F.when(single, (F.col("tp") + F.col("tn")) / F.col("n"))
        .otherwise((recall + spec) / 2)
        .alias("balanced_accuracy"),
        recall.alias("resistant_recall"),
        spec.alias("susceptible_recall"),
        f1.alias("f1"),
        "brier",
    )


def rank_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """AUROC with ties counted half, and average precision as a step sum over distinct scores."""
    rows = df.select(
        *by,
        "p",
        F.col("y").cast("bigint").alias("pos"),
        (1 - F.col("y")).cast("bigint").alias("neg"),
    )
    levels = cumulative(rows, by, "p", ["pos", "neg"])
    tp = F.col("pos_total") - F.col("pos_before")
    fp = F.col("neg_total") - F.col("neg_before")
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    step = F.sum(F.col("pos") * (tp / (tp + fp)))
    return levels.groupBy(*by).agg(
        F.try_divide(wins, F.first("pos_total") * F.first("neg_total")).alias("auroc"),
        F.try_divide(step, F.first("pos_total")).alias("pr_auc"),
    )


def classification_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """Every metric per key. A key without rows has no line; a single class has no AUROC."""
    return confusion_metrics(df, by).join(rank_metrics(df, by), by)


def with_slices(df: DataFrame, group: str = "grp", split: str = "split") -> DataFrame:
    """Repeat each row once per slice it counts in: test rows overall and per group, holdout rows
    in the unseen-lineage slice."""

    def slot(kind: str, name: Column) -> Column:
        return F.struct(F.lit(kind).alias("slice_kind"), name.alias("slice"))

    test = F.array(slot("overall", F.lit("overall")), slot("group", F.col(group)))
    held = F.array(slot("holdout", F.col(group)))
    slots = F.when(F.col(split) == "test", test).when(F.col(split) == "holdout", held)
    return df.select("*", F.inline(slots))


def with_populations(df: DataFrame, fired: str = "gate_fired") -> DataFrame:
    """Repeat each row for the whole population and, where the gate is quiet, the served one."""
    names = F.when(
        F.coalesce(F.col(fired), F.lit(False)), F.array(F.lit("marginal"))
    ).otherwise(F.array(F.lit("marginal"), F.lit("gate_negative")))
    return df.withColumn("population", F.explode(names))


def _edges(n: int) -> list[float]:
    return [i * (1.0 / n) for i in range(n + 1)]


def _bin(n: int, right_closed: bool) -> Column:
    inner = _edges(n)[1:-1]
    p = F.col("p")
    return sum(
        ((F.lit(e) < p) if right_closed else (F.lit(e) <= p)).cast("int") for e in inner
    )


def reliability_bins(df: DataFrame, by: list[str], n_bins: int = 10) -> DataFrame:
    """Uniform left-closed bins; empty bins stay with null rates."""
    edges = _edges(n_bins)
    binned = df.select(*by, "p", "y", _bin(n_bins, False).alias("_b"))
    aggs = []
    for b in range(n_bins):
        here = F.col("_b") == b
        aggs += [
            F.count_if(here).alias(f"_n{b}"),
            F.avg(F.when(here, F.col("p"))).alias(f"_p{b}"),
            F.avg(F.when(here, F.col("y").cast("double"))).alias(f"_y{b}"),
        ]
    entries = [
        F.struct(
            F.lit(b).alias("bin"),
            F.lit(edges[b]).alias("bin_lower"),
            F.lit(edges[b + 1]).alias("bin_upper"),
            F.col(f"_n{b}").alias("n"),
            F.col(f"_p{b}").alias("mean_predicted"),
            F.col(f"_y{b}").alias("fraction_positive"),
        )
        for b in range(n_bins)
    ]
    return binned.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*entries)))


def calibration_curve(df: DataFrame, by: list[str], n_bins: int = 10) -> DataFrame:
    """Right-closed bins, empty ones left out."""
    return df.groupBy(*by, _bin(n_bins, True).alias("bin")).agg(
        F.avg("p").alias("mean_predicted"), F.avg(F.col("y").cast("double")).alias("fraction_positive")
    )


def unpivot(df: DataFrame, keys: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    return df.unpivot([*keys, "n"], list(metrics), "metric", "value")


def compare_metrics(expected: DataFrame, got: DataFrame, keys: list[str]) -> DataFrame:
    """Per set found on both sides: largest difference and whether all agree.

    Sizes must be equal, nulls must meet nulls, and values agree within the tolerance.
    """
    left = unpivot(expected, keys).withColumnsRenamed({"n": "n0", "value": "v0"})
    right = unpivot(got, keys).withColumnsRenamed({"n": "n1", "value": "v1"})
    both = left.join(right, [*keys, "metric"], "inner")
    delta = F.abs(F.col("v0") - F.col("v1"))
    null_mix = F.col("v0").isNull() != F.col("v1").isNull()
    bad = null_mix | F.coalesce(delta > fixed.COMPARE_TOLERANCE, F.lit(False))
    return both.groupBy(*keys).agg(
        F.coalesce(F.max(delta), F.lit(0.0)).alias("max_abs_delta"),
        (~F.bool_or(bad | (F.col("n0") != F.col("n1")))).alias("matches"),
    )


def set_mismatch(expected: DataFrame, got: DataFrame, keys: list[str]) -> DataFrame:
    """Keys present on one side only."""
    a = expected.select(*keys).distinct().withColumn("_a", F.lit(True))
    b = got.select(*keys).distinct().withColumn("_b", F.lit(True))
    both = a.join(b, keys, "full_outer")
    side = F.when(F.col("_a").isNull(), "only_got").when(F.col("_b").isNull(), "only_expected")
    return both.select(*keys, side.alias("side")).where(F.col("side").isNotNull())


def fingerprint(genomes: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """Identity of a data set: n_genomes, n_features (of the feature table `vocab`, if given), the
    SHA-256 of the sorted ids by line breaks, and an order-free sum of hashes that needs no sorting.
    """
    ids = genomes.select("genome_id").distinct()
    sums = ids.agg(
        F.count("*").alias("n_genomes"),
        F.sum(F.conv(F.substring(F.sha2("genome_id", 256), 1, 12), 16, 10).cast("decimal(38,0)"))
        .cast("string")
        .alias("hash_sum"),
    )
    size = F.lit(None if vocab is None else vocab.count()).cast("long")
    ordered = streamed_digest(ids, "genome_id", ["genome_id"]).select(F.col("sha256").alias("genome_ids_sha256"))
    both = sums.withColumn("_one", F.lit(1)).join(ordered.withColumn("_one", F.lit(1)), "_one", "left")
    # Spark may plan nothing at all for an empty table.
    digest = F.coalesce("genome_ids_sha256", F.sha2(F.lit(""), 256)).alias("genome_ids_sha256")
    return both.select("n_genomes", size.alias("n_features"), digest, "hash_sum")
