"""Laboratory-test, metadata, annotation and catalog tables from tab-separated files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amrspark import fixed
from amrspark.functions import text
from amrspark.operators.groups import with_mlst


class TableFormatError(ValueError):
    """A file lacks required columns."""


def normalise_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def require_columns(df: DataFrame, needed: tuple[str, ...]) -> DataFrame:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise TableFormatError(f"missing columns: {missing}")
    return df


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text. The three spellings of a missing value become null."""
    raw = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', inferSchema=False)
    named = normalise_headers(raw)
    return named.select(*[text.null_spellings(F.col(f"`{c}`")).alias(c) for c in named.columns])


def read_tests(spark: SparkSession, path: str, taxon_id: str | None = fixed.TAXON_ID) -> DataFrame:
    df = require_columns(read_strings(spark, path), fixed.TEST_COLUMNS)
    return df if taxon_id is None else df.where(F.col("taxon_id") == taxon_id)


def read_metadata(spark: SparkSession, path: str, taxon_id: str | None = fixed.TAXON_ID) -> DataFrame:
    df = require_columns(read_strings(spark, path), fixed.METADATA_COLUMNS)
    df = df if taxon_id is None else df.where(F.col("taxon_id") == taxon_id)
    return with_mlst(df)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog rows with `ord`, which follows the row order of the file."""
    raw = normalise_headers(
        spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', inferSchema=False)
    )
    return raw.withColumn("ord", F.monotonically_increasing_id())


HIT_FILE_COLUMNS = (
    "Name", "Protein id", "Contig id", "Start", "Stop", "Strand", "Element symbol",
    "Element name", "Scope", "Type", "Subtype", "Class", "Subclass", "Method", "Target length",
    "Reference sequence length", "% Coverage of reference", "% Identity to reference",
    "Alignment length", "Closest reference accession", "Closest reference name", "HMM accession",
    "HMM description",
)


def hit_file_schema() -> str:
    return ", ".join(f"`{c}` string" for c in HIT_FILE_COLUMNS)


def typed_hits(raw: DataFrame) -> DataFrame:
    """Rename and cast annotation columns; `NA` is null where a value may be absent. A value that
    does not parse becomes null and is caught by `bad_hit`."""
    types = {"pct_coverage": "double", "pct_identity": "double", "start": "long", "stop": "long"}
    optional = (
        "drug_class", "drug_subclass", "closest_reference_accession", "closest_reference_name",
    )

    def column(source: str, name: str):
        c = F.col(f"`{source}`")
        if name in optional:
            c = F.nullif(c, F.lit("NA"))
        return (c.try_cast(types[name]) if name in types else c).alias(name)

    kept = [c for c in ("genome_id", "row_ord") if c in raw.columns]
    return raw.select(*kept, *[column(s, n) for s, n in fixed.HIT_HEADERS.items()])


def read_hit_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Raw lines of annotation files below `path`, one file per genome: the id is the file stem.

    Header lines stay in, so a genome whose file holds nothing else is still seen. Such files are
    far below one split, so a task reads a file whole and in order. A stream cannot number rows;
    `numbered` adds the order to each of its batches.
    """
    reader = spark.readStream if stream else spark.read
    lines = reader.format("text").option("pathGlobFilter", "*.tsv").option("recursiveFileLookup", True).load(path)
    genome = F.regexp_replace(F.col("_metadata.file_name"), r"\.tsv$", "").alias("genome_id")
    named = lines.select(genome, "value")
    return named if stream else numbered(named)


def numbered(lines: DataFrame) -> DataFrame:
    return lines.withColumn("row_ord", F.monotonically_increasing_id())


def parse_hit_lines(lines: DataFrame) -> DataFrame:
    """Typed hits of raw lines, header lines left out."""
    rows = lines.where(~F.col("value").startswith("Name\t") & (F.trim("value") != ""))
    parsed = F.from_csv("value", hit_file_schema(), {"sep": "\t", "mode": "PERMISSIVE"})
    return typed_hits(rows.select("genome_id", "row_ord", parsed.alias("h")).select("genome_id", "row_ord", "h.*"))


def read_hits(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(hits, genomes) of all annotation files below `path`."""
    lines = read_hit_lines(spark, path)
    return parse_hit_lines(lines), lines.select("genome_id").distinct()


def bad_hit():
    """Why a row breaks the closed value sets or ranges; null for a sound row."""
    checks = []
    for name, values in fixed.HIT_VALUES.items():
        checks.append((name, F.col(name).isNull() | ~F.col(name).isin(*values)))
    for name in ("gene_symbol", "sequence_name", "contig_id"):
        checks.append((name, F.col(name).isNull()))
    for name in ("pct_coverage", "pct_identity"):
        checks.append((name, F.col(name).isNull() | ~F.col(name).between(0.0, 100.0)))
    for name in ("start", "stop"):
        checks.append((name, F.col(name).isNull() | (F.col(name) < 1)))
    return F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in checks])


def validated_hits(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits of sound genomes, rejected genomes with the first bad column).

    One bad row rejects its whole genome. Rejected genomes are few; the join keeps their side
    small, and the rows are not regrouped.
    """
    marked = hits.withColumn("_bad", bad_hit())
    rejected = (
        marked.where(F.col("_bad").isNotNull())
        .groupBy("genome_id")
        .agg(F.min_by("_bad", "row_ord").alias("error"), F.count("*").alias("n_bad"))
    )
    good = hits.join(rejected.select("genome_id"), "genome_id", "left_anti")
    return good, rejected


def project_fields(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The given columns in order, absent ones as empty text."""
    return df.select(
        *[F.col(f"`{f}`") if f in df.columns else F.lit("").alias(f) for f in fields]
    )


def write_tsv(df: DataFrame, fields: tuple[str, ...], path: str) -> None:
    project_fields(df, fields).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_labels(labels: DataFrame, path: str) -> None:
    """The label table by drug, ordered by genome within each drug."""
    ordered = labels.repartitionByRange("antibiotic", "genome_id").sortWithinPartitions("antibiotic", "genome_id")
    ordered.write.mode("overwrite").partitionBy("antibiotic").parquet(path)


def write_document(row: DataFrame, path: str) -> None:
    """A one-row document as JSON."""
    row.coalesce(1).write.mode("overwrite").json(path)


def vectors_from_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """Cached vectors, one JSON document per genome."""
    return spark.read.schema(schema).json(path, multiLine=True)
