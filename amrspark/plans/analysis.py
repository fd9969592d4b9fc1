"""Whole runs: build labels, train and store, analyse a batch of genomes, evaluate stored models."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amrspark import fixed
from amrspark.operators import conformal as C
from amrspark.operators import decide as D
from amrspark.operators import features as FE
from amrspark.operators import groups as G
from amrspark.operators import labels as L
from amrspark.operators import metrics as M
from amrspark.operators import models as MO
from amrspark.session import cut
from amrspark.sources import fasta, store, tables


@dataclass
class Prepared:
    """Everything a verdict needs, per genome and drug."""

    gated: DataFrame
    known: DataFrame
    models: DataFrame
    scores: DataFrame
    contributions: DataFrame
    tops: DataFrame


def prepare(
    calls: DataFrame, genomes: DataFrame, models: DataFrame, coefficients: DataFrame
) -> Prepared:
    """Gate and score a batch of genomes. `calls` is read several times: pass a written table.

    `models` holds one row per trained drug: version, alpha, tau_s, tau_r, guarantee, intercept,
    platt_a, platt_b. The vocabulary of the models is the set of their coefficient names.
    """
    names = coefficients.select("feature").distinct()
    symbols = calls.where(F.col("is_amr") | F.col("is_point")).select(
        "genome_id", F.col("gene").alias("feature"), F.lit(1.0).alias("value")
    )
    combined = FE.engineered_rows(FE.engineered(calls, genomes))
    present = symbols.unionByName(combined).join(names, "feature")
    mech = FE.mechanism_hits(calls, genomes)
    drugs = tuple(sorted(r["antibiotic"] for r in models.select("antibiotic").collect()))
    contributions = D.contributions(present, coefficients, drugs)
    linear = models.select("antibiotic", "intercept", "platt_a", "platt_b")
    return Prepared(
        D.gate(mech),
        D.known_evidence(mech),
        models.select("antibiotic", "version", "alpha", "tau_s", "tau_r", "guarantee"),
        D.linear_scores(present, coefficients, linear, genomes, drugs),
        contributions,
        D.top_contributions(contributions),
    )


def verdict_table(p: Prepared) -> DataFrame:
    return D.verdicts(p.gated, p.models, p.scores, p.tops)


def report_table(p: Prepared) -> DataFrame:
    return D.report_rows(p.gated, p.known, p.models, p.scores, p.tops)


def analyse(
    hits: DataFrame,
    genomes: DataFrame,
    models: DataFrame,
    coefficients: DataFrame,
    registry: DataFrame,
    db_version: str,
) -> tuple[DataFrame, DataFrame]:
    """(nested report per genome, genomes set aside as incompatible) for annotated genomes."""
    calls = cut(FE.gene_calls(hits))
    stamped = genomes.select("genome_id").distinct().withColumns(
        {"db_version": F.lit(db_version), "schema_version": F.lit(fixed.SCHEMA_VERSION)}
    )
    usable, aside = D.compatible(stamped, registry)
    kept = calls.join(usable.select("genome_id"), "genome_id", "left_semi")
    prepared = prepare(kept, usable, models, coefficients)
    return D.reports(report_table(prepared)), aside


def build_dataset(
    spark: SparkSession,
    tests_path: str,
    out: str,
    *,
    metadata_path: str | None = None,
    assemblies: str | None = None,
    taxon_id: str = fixed.TAXON_ID,
) -> DataFrame:
    """Tests and metadata to label, working and metadata tables and a manifest below `out`.

    The raw text is landed as Parquet once, so that later passes prune columns and push filters.
    Returns the labels.
    """
    raw_path = f"{out}/raw_rows.parquet"
    tables.read_tests(spark, tests_path, taxon_id).write.mode("overwrite").parquet(raw_path)
    raw = spark.read.parquet(raw_path)
    lab = L.lab_rows(raw)
    L.with_canonical(lab).write.mode("overwrite").parquet(f"{out}/lab_rows.parquet")
    working = spark.read.parquet(f"{out}/lab_rows.parquet")
    _, dropped = L.majority_vote(working)
    if assemblies:
        files = fasta.inventory(spark, assemblies)
    else:
        files = raw.where("false").select("genome_id")
    labels = L.with_fasta_flag(L.label_table(working), files)
    broken = L.contract_violations(labels).limit(1).collect()
    if broken:
        raise ValueError(f"label table breaks its contract: {broken[0].asDict()}")
    tables.write_labels(labels, f"{out}/labels.parquet")
    labels = spark.read.parquet(f"{out}/labels.parquet").select(*fixed.LABEL_COLUMNS)
    meta = None
    if metadata_path:
        meta_path = f"{out}/genome_metadata.parquet"
        tables.read_metadata(spark, metadata_path, taxon_id).write.mode("overwrite").parquet(meta_path)
        meta = spark.read.parquet(meta_path)
    document = L.manifest_document(
        L.manifest_counts(raw, lab, working, labels, dropped, meta),
        L.value_counts(raw, "evidence"),
        L.value_counts(raw, "resistant_phenotype"),
        L.manifest_per_drug(working, dropped),
    )
    tables.write_document(document, f"{out}/dataset_manifest.json")
    return labels


def train_and_store(
    spark: SparkSession,
    root: str,
    hits: DataFrame,
    genomes: DataFrame,
    labels: DataFrame,
    metadata: DataFrame,
    db_version: str,
    **options,
) -> dict[str, MO.Trained]:
    """Train every panel drug and store its tables under the next version of the drug."""
    calls = cut(FE.gene_calls(hits))
    wide = cut(FE.engineered(calls, genomes))
    names = FE.feature_names(FE.vocabulary(calls))
    matrix = FE.matrix_vectors(calls, wide, names)
    group_of = G.assign_groups(genomes.select("genome_id").distinct(), metadata, ["genome_id"])
    fired = D.gate(FE.mechanism_hits(calls, genomes)).select("genome_id", "antibiotic", "gate_fired")
    trained = MO.train_panel(matrix, labels, group_of, fired, names, **options)
    for drug, result in trained.items():
        line = result.status.first()
        kept = {}
        if line["status"] == "trained":
            kept = {
                "model": result.model,
                "coefficients": result.coefficients,
                "metrics": result.metrics,
                "conformal": result.conformal,
                "evaluation": result.evaluation,
                "scores": result.scores,
            }
        store.save(
            spark, root, drug, kept, status=line["status"], reason=line["reason"], db_version=db_version
        )
    return trained


def stored_models(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(models, coefficients, one-row registry) of the newest trained versions."""
    lines = store.current(store.registry(spark, root)).where(F.col("status") == "trained")
    models, weights = [], []
    newest = lines.collect()  # one row per panel drug
    if not newest:
        raise LookupError("no trained model in this store")
    for line in newest:
        drug, n = line["antibiotic"], line["version"]
        head = store.load(spark, root, drug, "model", n)
        tau = store.load(spark, root, drug, "conformal", n)
        models.append(head.join(tau, "antibiotic").withColumn("version", F.lit(f"v{n}")))
        weights.append(store.load(spark, root, drug, "coefficients", n))
    stamp = lines.select("db_version", "schema_version", "engineered_version").distinct()
    if len({(r["db_version"], r["schema_version"], r["engineered_version"]) for r in newest}) > 1:
        told = sorted(f"{r['antibiotic']}: {r['db_version']}, {r['schema_version']}, {r['engineered_version']}" for r in newest)
        raise ValueError(f"models of one store disagree on versions: {'; '.join(told)}")
    return (
        reduce(DataFrame.unionByName, models),
        reduce(DataFrame.unionByName, weights),
        stamp,
    )


def evaluate(
    spark: SparkSession, root: str, rows: DataFrame, seed: int = 0, folds: int = fixed.N_SPLITS
) -> dict[str, DataFrame]:
    """Reproduce the split, compare with the stored metrics, and report the served slices.

    `rows`: antibiotic, genome_id, y (1 or 0), grp, gate_fired, p, every genome scored once.
    """
    sided = rows.withColumnRenamed("y", "_y").withColumn("y", F.when(F.col("_y") == 1, "R").otherwise("S"))
    split, status = G.make_split(sided, ["antibiotic"], k=folds, seed=seed)
    scored = cut(split.drop("y").withColumnRenamed("_y", "y"))
    G.require_no_leakage(scored, ["antibiotic"])
    keys = ["antibiotic", "split", "population"]
    again = M.classification_metrics(
        M.with_populations(scored.where(F.col("split").isin("test", "holdout"))), keys
    )
    drugs = store.current(store.registry(spark, root)).where(F.col("status") == "trained")
    newest = drugs.collect()  # one row per panel drug

    def stored(name: str) -> DataFrame:
        parts = [store.load(spark, root, r["antibiotic"], name, r["version"]) for r in newest]
        return reduce(DataFrame.unionByName, parts)

    published, fitted = stored("metrics"), stored("conformal")
    served = M.with_slices(scored.where(~F.col("gate_fired")))
    by = ["antibiotic", "slice_kind", "slice"]
    slots = served.select(*by).distinct().join(fitted, "antibiotic")
    return {
        "status": status,
        "comparison": M.compare_metrics(published, again, keys),
        "missing": M.set_mismatch(published, again, keys),
        "slices": M.classification_metrics(served, by),
        "selective": C.evaluate(served, slots, by),
        "reliability": M.reliability_bins(served, by),
        "fingerprint": M.fingerprint(scored),
    }


def rescore(
    spark: SparkSession, root: str, hits: DataFrame, genomes: DataFrame, labels: DataFrame, metadata: DataFrame
) -> DataFrame:
    """Every labelled genome scored anew by the stored models: antibiotic, genome_id, y, grp,
    gate_fired, p. Raises when a model's features are not those the annotations give."""
    calls = cut(FE.gene_calls(hits))
    models, coefficients, _ = stored_models(spark, root)
    coefficients = cut(coefficients)
    found = FE.vocabulary(calls).select("feature")
    odd = _feature_differences(coefficients.select("antibiotic", "feature"), found).limit(5).collect()
    if odd:
        raise ValueError(f"stored features differ from the annotations: {[r.asDict() for r in odd]}")
    prepared = prepare(calls, genomes, models, coefficients)
    group_of = G.assign_groups(genomes.select("genome_id").distinct(), metadata, ["genome_id"])
    fired = prepared.gated.select("genome_id", "antibiotic", "gate_fired")
    side = L.binary_labels(labels).select(
        "genome_id", "antibiotic", (F.col("sir_binary") == "R").cast("int").alias("y")
    )
    return (
        side.join(prepared.scores, ["genome_id", "antibiotic"])
        .join(group_of, "genome_id")
        .join(fired, ["genome_id", "antibiotic"], "left")
        .select(
            "antibiotic", "genome_id", "y", "grp",
            F.coalesce("gate_fired", F.lit(False)).alias("gate_fired"), "p",
        )
    )


def _feature_differences(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Features of a model that the annotations lack, and annotated ones a model lacks."""
    models = stored.groupBy("feature").agg(F.count("*").alias("n"))
    n = stored.select("antibiotic").distinct().count()
    joined = models.join(found.withColumn("_f", F.lit(True)), "feature", "full_outer")
    return joined.where(F.col("_f").isNull() | ~F.col("n").eqNullSafe(F.lit(n))).select("feature", "n")


def reevaluate(
    spark: SparkSession,
    root: str,
    hits: DataFrame,
    genomes: DataFrame,
    labels: DataFrame,
    metadata: DataFrame,
    *,
    seed: int = 0,
    folds: int = fixed.N_SPLITS,
) -> dict[str, DataFrame]:
    """`evaluate` on scores made anew from the stored coefficients and calibration, with the panel
    drugs that have no model and why (`skipped`). Wrong stored models show up as differences."""
    rows = cut(rescore(spark, root, hits, genomes, labels, metadata))
    out = evaluate(spark, root, rows, seed, folds)
    lines = store.current(store.registry(spark, root))
    out["skipped"] = lines.where(F.col("status") != "trained").select("antibiotic", "status", "reason")
    return out
