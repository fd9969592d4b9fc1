"""Resumable ingestion of annotation files with Structured Streaming.

A genome arrives as one file. The file-source checkpoint skips files already taken; each batch
overwrites its own folder, so a batch repeated after a failure leaves no second copy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amrspark.operators.features import gene_calls
from amrspark.sources.tables import (
    numbered,
    parse_hit_lines,
    read_hit_lines,
    validated_hits,
)

Parse = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def parse_files(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sound hits, rejected genomes) of raw lines."""
    return validated_hits(parse_hit_lines(numbered(lines)))


def ingest_stream(source: DataFrame, out: str, checkpoint: str, parse: Parse = parse_files) -> None:
    """Take every new file once and return when none is left.

    Calls go below `out/calls`, rejected genomes to `out/rejected`, and the other genomes seen, also
    those without any hit, to `out/genomes`. Arrival order does not matter: calls are per genome.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            good, rejected = parse(batch)
            where = f"batch={batch_id}"
            seen = batch.select("genome_id").distinct()
            seen = seen.join(rejected.select("genome_id"), "genome_id", "left_anti")
            seen.write.mode("overwrite").parquet(f"{out}/genomes/{where}")
            rejected.write.mode("overwrite").parquet(f"{out}/rejected/{where}")
            gene_calls(good).write.mode("overwrite").parquet(f"{out}/calls/{where}")
        finally:
            batch.unpersist()

    query = (
        source.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def ingest_folder(spark: SparkSession, folder: str, out: str, checkpoint: str) -> None:
    ingest_stream(read_hit_lines(spark, folder, stream=True), out, checkpoint)


def unfinished(inventory: DataFrame, done: DataFrame) -> DataFrame:
    """Batch form: genomes with a file that are not in the finished table yet."""
    return inventory.join(done.select("genome_id").distinct(), "genome_id", "left_anti")


def _newest(spark: SparkSession, out: str) -> DataFrame:
    """The newest batch of each genome, whether it was sound or rejected there."""
    seen = [spark.read.parquet(f"{out}/{t}").select("genome_id", "batch") for t in ("genomes", "rejected")]
    return seen[0].unionByName(seen[1]).groupBy("genome_id").agg(F.max("batch").alias("batch"))


def stored(spark: SparkSession, out: str, table: str = "calls") -> DataFrame:
    """A stored table (calls, genomes or rejected) as of now.

    Of a genome sent again only the newest batch counts, in which it may have other calls, none at
    all, or be rejected: then its earlier calls are gone.
    """
    rows = spark.read.parquet(f"{out}/{table}")
    return rows.join(_newest(spark, out), ["genome_id", "batch"]).drop("batch")


def compact(spark: SparkSession, out: str, target: str) -> None:
    """Write what counts now to the folder `target`, one batch folder per table.

    It keeps the highest batch number, so a stream that goes on with the same checkpoint and
    `target` as its output adds newer ones. Nothing below `out` is changed.
    """
    newest = _newest(spark, out)
    highest = newest.agg(F.max("batch")).first()[0]
    for table in ("genomes", "rejected", "calls"):
        rows = stored(spark, out, table)
        rows.write.mode("overwrite").parquet(f"{target}/{table}/batch={0 if highest is None else highest}")
