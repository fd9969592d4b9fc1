"""Session settings and lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Checkpoints that no table refers to any more are removed.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, app: str = "amrspark", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """Write `df` once and read it back, so that later actions do not recompute it.

    The folder is the shared one the cluster names in `spark.checkpoint.dir`. Only a local
    master without that setting (tests) gets a folder of its own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can read")
            folder = tempfile.mkdtemp(prefix="amrspark-", dir=os.environ.get("TMPDIR", "/tmp"))
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can read")
        base = tempfile.mkdtemp(prefix="amrspark-", dir=os.environ.get("TMPDIR", "/tmp"))
    return f"{base}/{name}-{uuid.uuid4().hex}"
