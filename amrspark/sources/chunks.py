"""Knowledge chunks: JSON-lines corpus and catalog rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amrspark import fixed
from amrspark.functions import text
from amrspark.operators.labels import first_per_key

SCHEMA = "chunk_id string, gene_family string, drugs array<string>, text string, source string"


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """All chunks below `path`, malformed lines fail the read, the first of a repeated id wins.

    First means by file name, then by offset inside the file. Row ids grow with the offset inside
    one file, since a task reads its splits in order.
    """
    lines = spark.read.text(path).select(
        F.col("value"),
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    parsed = lines.where(F.trim("value") != "").select(
        F.from_json("value", SCHEMA, {"mode": "FAILFAST"}).alias("c"), "file", "block", "line"
    )
    rows = parsed.select("c.*", "file", "block", "line")
    first = first_per_key(rows, ["chunk_id"], ["file", "block", "line"])
    return first.drop("file", "block", "line")


def from_catalog(catalog: DataFrame, order: list[str], limit: int | None = None) -> DataFrame:
    """One chunk per gene family that has a product text; the first row of a family wins."""
    drug = text.lookup(fixed.SUBCLASS_DRUGS, F.upper(F.trim("subclass")))
    rows = catalog.select(
        text.clean("gene_family").alias("gene_family"),
        text.clean("product_name").alias("text"),
        F.when(drug.isNotNull(), F.array(drug)).otherwise(F.array().cast("array<string>")).alias("drugs"),
        *order,
    ).where(F.col("gene_family").isNotNull() & F.col("text").isNotNull())
    first = first_per_key(rows, ["gene_family"], order)
    if limit is not None:
        first = first.orderBy(*order).limit(limit)
    return first.select(
        F.concat(F.lit("catalog:"), F.col("gene_family")).alias("chunk_id"),
        "gene_family",
        "drugs",
        "text",
        F.lit(fixed.CATALOG_SOURCE).alias("source"),
    )


def write_jsonl(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").json(path)
