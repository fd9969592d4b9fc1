"""Tables written once into the shared work folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame

from amrspark.session import work_folder


def store(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table below `spark.checkpoint.dir`.

    It cuts the lineage: a lost executor costs a re-read, never a recomputation, and later plans
    read only the columns they need.
    """
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
