"""Repeated laboratory tests to one label per (genome, drug), and the reports about them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amrspark import fixed
from amrspark.functions import text
from amrspark.operators.ranking import weighted_quantile_rows
from amrspark.session import cut

KEYS = ["genome_id", "antibiotic"]

#: Rows of one key that a task may hold at once; keys with more are spread over tasks.
ROWS_IN_TASK = 100_000
_SLOTS = 1 << 16


def _present(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row of each key. An aggregate, so equal keys combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_r.{c}") for c in rest])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, missing values under a visible bucket."""
    value = F.coalesce(F.col(column), F.lit(fixed.BLANK)).alias("value")
    return df.groupBy(value).agg(F.count("*").alias("n"))


def lab_rows(
    df: DataFrame,
    evidence_values: tuple[str, ...] = (fixed.LAB_EVIDENCE,),
    require_typing_method: bool = True,
) -> DataFrame:
    kept = df.where(F.col("evidence").isin(*evidence_values))
    if require_typing_method:
        kept = kept.where(text.clean("laboratory_typing_method").isNotNull())
    return kept


def with_canonical(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "antibiotic": text.canonical_drug("antibiotic"),
            "sir": text.canonical_sir("resistant_phenotype"),
        }
    )


def votes(df: DataFrame, keys: list[str] = KEYS, cls: str = "sir") -> DataFrame:
    """One row per key with the vote: class counts, winner, and whether the key is dropped.

    A key is dropped when classes of both clinical sides appear, whatever their counts, or when
    the top count is shared. The classes are a closed set, so one pass of five counters suffices.
    """
    counters = [
        F.count_if(F.col(cls) == c).alias(f"_c{i}") for i, c in enumerate(fixed.SIR_CLASSES)
    ]
    counted = df.where(_present(keys) & F.col(cls).isin(*fixed.SIR_CLASSES)).groupBy(*keys)
    return decide_votes(counted.agg(*counters), keys, cls)


def decide_votes(counted: DataFrame, keys: list[str], cls: str) -> DataFrame:
    n = {c: F.col(f"_c{i}") for i, c in enumerate(fixed.SIR_CLASSES)}
    top = F.greatest(*n.values())
    seen = {
        side: reduce(lambda a, b: a | b, [n[c] > 0 for c in classes])
        for side, classes in (("r", fixed.RESISTANT_SIDE), ("s", fixed.SUSCEPTIBLE_SIDE))
    }
    shared = reduce(lambda a, b: a + b, [(x == top).cast("int") for x in n.values()]) > 1
    total = reduce(lambda a, b: a + b, n.values())
    winner = reduce(
        lambda acc, c: acc.when(n[c] == top, c), fixed.SIR_CLASSES, F.when(F.lit(False), "")
    )
    return counted.select(
        *keys,
        winner.alias(cls),
        total.alias("sir_source_rows"),
        top.alias("sir_n_agree"),
        (top / total).alias("sir_majority_fraction"),
        (seen["r"] & seen["s"]).alias("contradicts"),
        shared.alias("ties"),
        *[c for c in counted.columns if c not in keys and not c.startswith("_c")],
    )


def majority_vote(
    df: DataFrame, keys: list[str] = KEYS, cls: str = "sir"
) -> tuple[DataFrame, DataFrame]:
    """(labels, dropped rows): resolved keys, and every voting row of an unresolvable key."""
    voted = votes(df, keys, cls)
    bad = F.col("contradicts") | F.col("ties")
    resolved = voted.where(~bad).drop("contradicts", "ties")
    voting = df.where(F.col(cls).isin(*fixed.SIR_CLASSES))
    dropped = voting.join(voted.where(bad).select(*keys), keys, "left_semi")
    return resolved, dropped


def mode_or_null(c: str | Column) -> Column:
    """Most frequent value, the smallest one on ties, nulls ignored."""
    return F.mode(c, True)


def by_size(df: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of keys of up to `limit` rows, rows of the others or None when there are none).

    Rows are counted by a slot of the key's hash, so the count is one small shuffle. A key that
    shares the slot of a large one goes with it. Keys must not be null.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(_SLOTS))
    sizes = df.groupBy(slot.alias("_slot")).agg(F.count("*").alias("_n"))
    large = cut(sizes.where(F.col("_n") > limit).select("_slot"))
    if large.isEmpty():
        return df, None
    placed, large = df.withColumn("_slot", slot), F.broadcast(large)
    return tuple(placed.join(large, "_slot", how).drop("_slot") for how in ("left_anti", "left_semi"))


def _with_top_unit(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumn("_top", mode_or_null("unit").over(Window.partitionBy(*keys)))


def _measured() -> list[Column]:
    """Median, usual sign and unit of the rows in the top unit of `_with_top_unit`."""
    inside = F.col("unit") == F.col("_top")
    return [
        F.median(F.when(inside, F.col("value"))).alias("value"),
        mode_or_null(F.when(inside, F.col("sign"))).alias("sign"),
        F.max("_top").alias("unit"),
    ]


def dominant_unit_median(
    df: DataFrame, keys: list[str] = KEYS, *, rows_in_task: int = ROWS_IN_TASK
) -> DataFrame:
    """Per key: the most common unit, and the median value and usual sign inside that unit.

    `df` has columns unit, value, sign. The rows of a key meet in one task, but for keys with more
    than `rows_in_task`, which are spread over tasks.
    """
    base = df.where(_present(keys) & F.col("unit").isNotNull()).select(*keys, "unit", "value", "sign")
    small, large = by_size(base, keys, rows_in_task)
    out = _with_top_unit(small, keys).groupBy(*keys).agg(*_measured())
    return out if large is None else out.unionByName(_spread_median(large, keys))


def _spread_median(base: DataFrame, keys: list[str]) -> DataFrame:
    """`dominant_unit_median` of keys of any size.

    Equal rows are counted first, so units, signs and medians all come from one table of counts.
    Medians are ranks over distinct values, dealt by key and value: a key with very many rows is
    spread over tasks like all others.
    """
    counts = cut(base.groupBy(*keys, "unit", "sign", "value").agg(F.count("*").alias("n")))
    signs = counts.groupBy(*keys, "unit", "sign").agg(F.sum("n").alias("n"))
    known = F.col("sign").isNotNull()
    units = signs.groupBy(*keys, "unit").agg(
        F.sum("n").alias("n"),
        F.min_by(F.when(known, F.col("sign")), F.when(known, F.struct(-F.col("n"), "sign"))).alias("sign"),
    )
    best = F.min_by(F.struct("unit", "sign"), F.struct((-F.col("n")).alias("n"), "unit"))
    chosen = units.groupBy(*keys).agg(best.alias("_u")).select(*keys, "_u.unit", "_u.sign")
    inside = counts.drop("sign").join(chosen.select(*keys, "unit"), [*keys, "unit"])
    middle = weighted_quantile_rows(
        inside.where(F.col("value").isNotNull()),
        keys,
        "value",
        "n",
        {"_a": F.floor((F.col("n") + 1) / 2), "_b": F.ceil((F.col("n") + 1) / 2)},
    )
    middle = middle.select(*keys, ((F.col("_a") + F.col("_b")) / 2).alias("value"))
    return chosen.join(middle, keys, "left").select(*keys, "value", "sign", "unit")


def label_table(working: DataFrame, *, rows_in_task: int = ROWS_IN_TASK) -> DataFrame:
    """Vote, measurement and provenance per pair.

    All come from one pass over the rows, whose shuffle is by pair; only pairs with more than
    `rows_in_task` rows are spread over tasks. Measurements use every row of the pair, also those
    without a canonical class.
    """
    rows = working.where(_present(KEYS)).select(
        *KEYS,
        "sir",
        text.clean("testing_standard").alias("standard"),
        text.number("testing_standard_year").cast("int").alias("year"),
        text.clean("laboratory_typing_method").alias("method"),
        text.clean("measurement_unit").alias("unit"),
        text.number("measurement_value").alias("value"),
        text.mic_sign("measurement").alias("sign"),
    )
    small, large = by_size(rows, KEYS, rows_in_task)
    out = _voted(_with_top_unit(small, KEYS).groupBy(*KEYS).agg(*_provenance(), *_measured()))
    if large is not None:
        measured = _spread_median(large.where(F.col("unit").isNotNull()), KEYS)
        votes_of = _voted(large.groupBy(*KEYS).agg(*_provenance()))
        out = out.unionByName(votes_of.join(measured, KEYS, "left"))
    named = {"value": "mic_value", "sign": "mic_sign", "unit": "mic_unit"}
    return out.withColumnsRenamed(named).select(*fixed.LABEL_COLUMNS[:-1])


def _provenance() -> list[Column]:
    """Class counts and provenance of a pair."""
    return [
        *[F.count_if(F.col("sir") == c).alias(f"_c{i}") for i, c in enumerate(fixed.SIR_CLASSES)],
        F.coalesce(mode_or_null("standard"), F.lit("")).alias("dominant_testing_standard"),
        F.min("year").alias("testing_standard_year_min"),
        F.max("year").alias("testing_standard_year_max"),
        F.array_join(F.array_sort(F.collect_set("method")), ";").alias("lab_typing_methods"),
    ]


def _voted(counted: DataFrame) -> DataFrame:
    """The pairs whose vote is resolved."""
    voting = reduce(lambda a, b: a + b, [F.col(f"_c{i}") for i in range(len(fixed.SIR_CLASSES))])
    voted = decide_votes(counted.where(voting > 0), KEYS, "sir")
    return voted.where(~(F.col("contradicts") | F.col("ties")))


def with_fasta_flag(labels: DataFrame, available: DataFrame) -> DataFrame:
    ids = available.select("genome_id").distinct().withColumn("_has", F.lit(True))
    flag = F.coalesce("_has", F.lit(False)).alias("has_fasta")
    return labels.join(ids, "genome_id", "left").select(*labels.columns, flag)


def drug_counts(working: DataFrame) -> DataFrame:
    """Rows per class, total rows and distinct genomes per drug."""
    return working.groupBy("antibiotic").agg(
        *[
            F.count_if(F.col("sir") == c).alias(c.lower().replace("-", "_").replace(" ", "_"))
            for c in fixed.SIR_CLASSES
        ],
        F.count("*").alias("total"),
        F.countDistinct("genome_id").alias("n_unique_genomes"),
    )


def standard_breakdown(working: DataFrame) -> DataFrame:
    std = F.upper(F.trim(F.coalesce("testing_standard", F.lit(""))))
    return working.groupBy("antibiotic").agg(
        F.count_if(std == "CLSI").alias("clsi"),
        F.count_if(std == "EUCAST").alias("eucast"),
        F.count_if(~std.isin("CLSI", "EUCAST")).alias("other_or_blank"),
    )


def manifest_per_drug(working: DataFrame, dropped: DataFrame) -> DataFrame:
    """The two per-drug reports side by side with the rows lost to conflicts."""
    lost = dropped.groupBy("antibiotic").agg(F.count("*").alias("dropped_conflict"))
    joined = drug_counts(working).join(standard_breakdown(working), "antibiotic", "left")
    joined = joined.join(lost, "antibiotic", "left")
    return joined.fillna(0, ["clsi", "eucast", "other_or_blank", "dropped_conflict"])


def manifest_counts(
    raw: DataFrame,
    lab: DataFrame,
    working: DataFrame,
    labels: DataFrame,
    dropped: DataFrame,
    metadata: DataFrame | None = None,
) -> DataFrame:
    """Long table (metric, value) of what each stage kept."""

    def row(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.agg(value.cast("double").alias("value")).select(F.lit(name).alias("metric"), "value")

    parts = [
        row(raw, "raw_rows", F.count("*")),
        row(lab, "lab_rows", F.count("*")),
        row(labels, "labels_after_collapse", F.count("*")),
        row(dropped, "dropped_conflict", F.count("*")),
        row(working, "dropped_uncanonical_sir", F.count_if(F.col("sir").isNull())),
        row(labels, "unique_genomes", F.countDistinct("genome_id")),
    ]
    if "has_fasta" in labels.columns:
        parts.append(row(labels, "genomes_with_fasta", F.count_if("has_fasta")))
    if metadata is not None:
        missing = F.col("mlst_st").isNull()
        parts += [
            row(metadata, "genomes_total", F.count("*")),
            row(metadata, "with_st", F.count_if(~missing)),
            row(metadata, "missing_st", F.count_if(missing)),
            row(
                metadata,
                "missing_fraction",
                F.coalesce(F.try_divide(F.count_if(missing), F.count("*")), F.lit(0.0)),
            ),
        ]
    return reduce(DataFrame.unionByName, parts)


def manifest_document(
    counts: DataFrame, evidence: DataFrame, phenotypes: DataFrame, per_drug: DataFrame
) -> DataFrame:
    """One JSON row. Its parts are bounded: stage counts, vocabularies and one entry per drug."""

    def entry(df: DataFrame, section: str, value: Column) -> DataFrame:
        packed = df.agg(F.to_json(value).alias("body"))
        return packed.select(F.lit(section).alias("section"), "body")

    vocabulary = F.map_from_entries(F.collect_list(F.struct("value", "n")))
    parts = [
        entry(counts, "counts", F.map_from_entries(F.collect_list(F.struct("metric", "value")))),
        entry(evidence, "evidence_vocabulary", vocabulary),
        entry(phenotypes, "sir_vocabulary_raw", vocabulary),
        entry(
            per_drug,
            "per_drug",
            F.array_sort(F.collect_list(F.struct("antibiotic", *per_drug.columns[1:]))),
        ),
    ]
    body = F.concat(F.lit('"'), F.col("section"), F.lit('":'), F.col("body"))
    whole = F.concat(
        F.lit("{"), F.array_join(F.array_sort(F.collect_list(body)), ","), F.lit("}")
    )
    return reduce(DataFrame.unionByName, parts).agg(whole.alias("manifest"))


def binary_labels(labels: DataFrame, cls: str = "sir", out: str = "sir_binary") -> DataFrame:
    return labels.withColumn(out, text.binary_side(cls)).where(F.col(out).isNotNull())


def eligible_ids(
    labels: DataFrame,
    antibiotics: tuple[str, ...] | None = None,
    min_n_per_drug: int | None = None,
) -> DataFrame:
    """Distinct genomes of the wanted drugs that have enough labels.

    Drug sizes are a table of one row per drug joined back, so no drug's rows meet in one task.
    """
    kept = labels if antibiotics is None else labels.where(F.col("antibiotic").isin(*antibiotics))
    if min_n_per_drug is not None:
        sizes = kept.groupBy("antibiotic").agg(F.count("genome_id").alias("_n"))
        enough = sizes.where(F.col("_n") >= min_n_per_drug).select("antibiotic")
        kept = kept.join(enough, "antibiotic", "left_semi")
    return kept.where(F.col("genome_id").isNotNull()).select("genome_id").distinct()


def selected_ids(chosen: DataFrame, extra: DataFrame, limit: int | None = None) -> DataFrame:
    """Union of two id lists without repeats; with a limit, the first ids in order."""
    ids = chosen.select("genome_id").union(extra.select("genome_id")).distinct()
    return ids if limit is None else ids.orderBy("genome_id").limit(limit)


def contract_violations(labels: DataFrame) -> DataFrame:
    """Rows whose class is outside the closed set; raises when a column is missing."""
    missing = sorted(set(fixed.LABEL_COLUMNS) - set(labels.columns))
    if missing:
        raise ValueError(f"label table lacks {missing}")
    return labels.where(F.col("sir").isNotNull() & ~F.col("sir").isin(*fixed.SIR_CLASSES))


def reconcile_counts(local: DataFrame, remote: DataFrame, key: str = "value") -> DataFrame:
    """Compare two count tables (key, n); a key missing on one side counts as zero there."""
    both = local.select(key, F.col("n").alias("local_n")).join(
        remote.select(key, F.col("n").alias("remote_n")), key, "full_outer"
    )
    both = both.fillna(0, ["local_n", "remote_n"])
    delta = F.abs(F.col("local_n") - F.col("remote_n"))
    verdict = F.when(delta == 0, "matches").otherwise("investigate before trusting counts")
    return both.withColumns({"delta": delta, "verdict": verdict})
