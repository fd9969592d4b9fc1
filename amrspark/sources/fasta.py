"""Assembly files as record tables, and their quality checks.

A record table has genome_id, ord (an orderable value, record order in the genome), header, body.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from amrspark import fixed

SUFFIX = r"\.(fna|fasta|fa)$"


def read_records(spark: SparkSession, path: str, glob: str = "*.fna") -> DataFrame:
    """One row per record. Files are cut at line starts holding `>`, so a large file is split
    over tasks, and read once. Text before the first record of a file is dropped.

    `ord` orders the records of a file: the byte where their split begins, then the row in it.
    """
    raw = (
        spark.read.option("lineSep", "\n>")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .text(path)
        .select(
            F.regexp_replace(F.col("_metadata.file_name"), SUFFIX, "").alias("genome_id"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
            F.col("value"),
        )
    )
    rows = raw.mapInArrow(
        _begun, "genome_id string, file string, block long, row long, value string, first boolean"
    )
    kept = rows.where(~F.col("first") | F.col("value").startswith(">"))
    whole = F.when(F.col("first"), F.substring("value", 2, 2_000_000_000)).otherwise(F.col("value"))
    at = F.instr(whole, "\n")
    return kept.select(
        "genome_id",
        F.struct("block", "row").alias("ord"),
        F.trim(F.when(at > 0, F.substring(whole, F.lit(1), at - 1)).otherwise(whole)).alias("header"),
        F.when(at > 0, F.substring(whole, at + 1, F.length(whole))).otherwise("").alias("body"),
    )


def _begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mark the row at the begin of each file: the first of a split at byte 0.

    The rows of a split follow each other in a task. The values pass through as they are.
    """
    last = None
    for batch in batches:
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
        first = []
        for split in zip(files, blocks, strict=True):
            first.append(split[1] == 0 and split != last)
            last = split
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.bool_())], [*batch.schema.names, "first"])


def contigs(records: DataFrame) -> DataFrame:
    """Id, description, length and character facts of each record."""
    seq = F.upper(F.regexp_replace("body", r"\s", ""))
    return records.select(
        "genome_id",
        "ord",
        F.regexp_extract("header", r"^\s*(\S*)", 1).alias("contig_id"),
        F.col("header").alias("description"),
        F.length(seq).cast("bigint").alias("length"),
        # Nucleotide and ambiguity codes, and the four bases (fixed values).
        (~seq.rlike("[^ACGTUNRYSWKMBDHV]")).alias("nucleotide"),
        seq.rlike("[ACGT]").alias("canonical"),
    )


def assembly_qc(
    records: DataFrame,
    genomes: DataFrame | None = None,
    *,
    max_contigs: int = fixed.MAX_CONTIGS,
    min_total: int = fixed.MIN_ASSEMBLY,
    max_total: int = fixed.MAX_ASSEMBLY,
) -> DataFrame:
    """Per genome: contigs, total length and the first broken rule, null when usable.

    `genomes` names the files, so that one without any record is reported too. Rules are checked
    in record order; a repeated id comes before the sequence rules of its record.
    """
    rows = contigs(records)
    same = Window.partitionBy("genome_id", "contig_id").orderBy("ord")
    facts = rows.select(
        "genome_id", "ord", "contig_id", "length", "nucleotide", "canonical", F.row_number().over(same).alias("_i")
    )
    # The rules of one record, in their order.
    broken = (
        F.when(F.col("contig_id") == "", "missing_id")
        .when(F.col("_i") > 1, "duplicate_id")
        .when(F.col("length") == 0, "empty_sequence")
        .when(~F.col("nucleotide"), "not_nucleotide")
        .when(~F.col("canonical"), "all_ambiguous")
    )
    per = facts.groupBy("genome_id").agg(
        F.count("*").alias("n_contigs"),
        F.sum("length").alias("total_length"),
        F.min(F.when(broken.isNotNull(), F.struct("ord", broken.alias("e")))).alias("_own"),
    )
    base = per if genomes is None else genomes.select("genome_id").distinct().join(per, "genome_id", "left")
    joined = base.fillna(0, ["n_contigs", "total_length"])
    record_error = F.col("_own")["e"]
    n, total = F.col("n_contigs"), F.col("total_length")
    error = (
        F.when(n == 0, "no_records")
        .when(n > max_contigs, "too_many_contigs")
        .otherwise(
            F.coalesce(record_error, F.when(~total.between(min_total, max_total), "total_length"))
        )
    )
    return joined.select("genome_id", "n_contigs", "total_length", error.alias("error"))


def truncation_problems(
    measured: DataFrame, expected: DataFrame, ceiling: int | None = None, tolerance: float = 0.01
) -> DataFrame:
    """Measured (n_contigs, total_length) against metadata (contigs, genome_length)."""
    joined = measured.join(
        expected.select(
            "genome_id",
            F.col("contigs").try_cast("bigint").alias("_c"),
            F.col("genome_length").try_cast("bigint").alias("_l"),
        ),
        "genome_id",
        "left",
    )
    n, total = F.col("n_contigs"), F.col("total_length")
    off = F.when(F.col("_l") > 0, F.abs(total - F.col("_l")) / F.col("_l"))
    problem = F.when((n == 0) | (total == 0), "empty")
    if ceiling is not None:
        problem = problem.when(n >= ceiling, "at_ceiling")
    problem = problem.when(F.col("_c").isNotNull() & (n != F.col("_c")), "contig_count").when(
        off > tolerance, "length"
    )
    return joined.select("genome_id", "n_contigs", "total_length", problem.alias("problem"))


def inventory(spark: SparkSession, path: str, glob: str = "*.fna") -> DataFrame:
    """Genomes with a non-empty `<id>/<id>.fna`. Only path and size are read, never the content."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", "length")
    )
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), SUFFIX, "")
    found = files.where((F.col("length") > 0) & (folder == stem))
    return found.select(stem.alias("genome_id"), "length")
