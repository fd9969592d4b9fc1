"""Documents to training sequences: five stages, each a thin step over one operator.

A stage takes (spark, docs, sf_dir) and all documents that the stage before kept, and returns a
table that is written and read again for the next one. All but the last return the columns of
documents. Columns of any name beside doc_id and text pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amrspark.llm import decontaminate, near_dedup, packing, private_data, quality
from amrspark.llm.queries import tokenizer_file
from amrspark.llm.store import store


def _chunks(docs: DataFrame) -> DataFrame:
    """chunk_id, text, and the whole row, so that columns of any name are carried along."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(F.col("doc_id").alias("chunk_id"), "text", row.alias("row"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the rule ensemble predicts to be of quality 0.

    A null or empty text is scored like any other; each of several rows of an id by its own text.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("chunk_id"), "quality")
    scored = quality.score_chunks(_chunks(docs), labels, carry=["row"])
    return scored.where("predicted = 1").select("row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each group of near duplicates, by five-word shingles.

    Documents without words or without an id are no duplicates. Rows of one id are one document:
    they stay if one of them is kept.
    """
    kept = near_dedup.group_chunks(_chunks(docs)).where("kept and chunk_id is not null")
    ids = kept.select(F.col("chunk_id").alias("doc_id")).distinct()
    known = docs.join(ids, "doc_id", "left_semi").select([F.col(f"`{c}`") for c in docs.columns])
    return known.unionAll(docs.where(F.col("doc_id").isNull()))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that benchmark passages contaminate; a null text is clean."""
    tests = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        F.col("item_id").alias("genome_id"), F.col("text").alias("summary")
    )
    scanned = decontaminate.scan_chunks(_chunks(docs), tests, carry=["row"])
    return scanned.where("not contaminated").select("row.*")


def private_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in every text by its kind in brackets, and count n_chars anew.

    A null text stays null with the n_chars it had.
    """
    found = private_data.find_private(_chunks(docs).select(F.col("row").alias("chunk_id"), "text"))
    clean = private_data.redact(found)
    text = F.when(F.col("chunk_id.text").isNotNull(), F.col("clean_text"))
    size = F.coalesce(F.length(text).cast(docs.schema["n_chars"].dataType), F.col("chunk_id.n_chars"))
    new = {"text": text, "n_chars": size}
    return clean.select([new.get(c, F.col(f"chunk_id.`{c}`")).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids; a null text is its end id."""
    placed = packing.pack_chunks(_chunks(docs), tokenizer_file("word_bpe_49k.json"), end_id=1)
    return placed.withColumnsRenamed({"chunk_id": "doc_id", "chunk_tokens": "doc_tokens"})


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicate removal", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("personal data", private_data_stage),
    ("packing", packing_stage),
]

#: Trees, tokenizers and packing are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
