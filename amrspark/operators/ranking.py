"""Running sums and ranks inside groups of any size.

A plain ordered window sends a whole group to one task. Here the rows are dealt to ranges of equal
size in the order asked for, whatever their values are: Spark samples the keys, so a group holding a
third of all rows, or values crowded near one end, are spread over many tasks all the same. The sums
per range (a small table) give each range its offset, and the ordered window runs inside one range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amrspark.session import cut


def ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """`df` with `_range`, the number of its range in ascending `order`. Written once, since a range
    is only known where the rows were dealt. Equal keys share a range."""
    return cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def _offsets(placed: DataFrame, part: list[str], sums: dict[str, Column]) -> DataFrame:
    """Per (part, range): each sum over the earlier ranges of the part, and over the whole part."""
    per_range = placed.groupBy(*part, "_range").agg(*[s.alias(f"_{n}") for n, s in sums.items()])
    whole = Window.partitionBy(*part)
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return per_range.select(
        *part,
        "_range",
        *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums],
        *[F.sum(f"_{n}").over(whole).alias(f"{n}_total") for n in sums],
    )


def cumulative(df: DataFrame, part: list[str], key: str, weights: list[str]) -> DataFrame:
    """One row per (part, key) with each weight summed, plus for each weight `w`:
    `w_before` (sum over smaller keys of the part) and `w_total` (sum over the part).

    Equal keys are summed before anything is dealt. Part columns and keys must not be null.
    """
    sums = df.groupBy(*part, key).agg(*[F.sum(w).alias(w) for w in weights])
    placed = ranges(sums, [*part, key])
    offsets = _offsets(placed, part, {w: F.sum(w) for w in weights})
    inside = (
        Window.partitionBy(*part, "_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    )
    return placed.join(offsets, [*part, "_range"]).select(
        *part,
        key,
        *weights,
        *[
            (F.col(f"_{w}") + F.coalesce(F.sum(w).over(inside), F.lit(0))).alias(f"{w}_before")
            for w in weights
        ],
        *[f"{w}_total" for w in weights],
    )


def numbered(df: DataFrame, part: list[str], order: list[str], out: str = "rank") -> DataFrame:
    """Add the number (from 1) of each row of its part in ascending `order`, which must tell the
    rows of a part apart, and `_n`, the rows of the part."""
    placed = ranges(df, [*part, *order])
    offsets = _offsets(placed, part, {"n": F.count("*")})
    inside = F.row_number().over(Window.partitionBy(*part, "_range").orderBy(*order))
    return placed.join(offsets, [*part, "_range"]).select(
        *df.columns, (F.col("_n") + inside).cast("bigint").alias(out), F.col("n_total").alias("_n")
    )


def ranked(df: DataFrame, part: list[str], score: str, tie: str, *, out: str = "rank") -> DataFrame:
    """Add the rank (from 1) of each row by score descending, then tie ascending.

    (part, tie) must identify a row.
    """
    rows = df.withColumn("_down", -F.col(score))
    return numbered(rows, part, ["_down", tie], out).select(*df.columns, out)


def weighted_quantile_rows(
    df: DataFrame, part: list[str], key: str, weight: str, ranks: dict[str, Column]
) -> DataFrame:
    """Per part, the key at each 1-based rank. A rank is an expression over `n` (rows in the part);
    the result is null where the rank is outside 1..n."""
    rows = df.select(*part, key, F.col(weight).alias("w"))
    summed = cumulative(rows, part, key, ["w"]).withColumn("n", F.col("w_total"))
    low, high = F.col("w_before"), F.col("w_before") + F.col("w")
    return summed.groupBy(*part).agg(
        F.first("n").alias("n"),
        *[
            F.max(F.when((rank > low) & (rank <= high), F.col(key))).alias(name)
            for name, rank in ranks.items()
        ],
    )


def streamed_digest(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """One row (n, sha256): the number of texts in `column` and the SHA-256 of them all in `order`,
    joined by line breaks.

    The digest depends on the order, so one task reads the texts as a stream, sorted outside its
    memory if need be, and holds only the state of the hash.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, n = hashlib.sha256(), 0
        for batch in batches:
            for text in batch.column(column).to_pylist():
                state.update(b"\n" * (n > 0) + text.encode())
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "sha256": [state.hexdigest()]})

    ordered = df.select(*dict.fromkeys([column, *order])).repartition(1).sortWithinPartitions(*order)
    return ordered.mapInArrow(digest, "n long, sha256 string")
