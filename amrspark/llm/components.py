"""Connected components of a link table, by joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amrspark.llm.store import store


def connected(links: DataFrame) -> DataFrame:
    """(id, component) for every id in `links` (a, b); component is the smallest id reachable.

    Rounds of two steps shrink each component to a star around its smallest id. The large step
    moves every larger neighbour of a node to the node's smallest neighbour, the small step does
    the same for the smaller ones. Only minima are aggregated, so a node with very many links is
    combined map-side and its join may be split. Null ids, self links and repeated links have no
    effect; no links give an empty table.
    """
    a, b = F.col("a"), F.col("b")
    pairs = links.where(a.isNotNull() & b.isNotNull() & (a != b))
    edges = store(
        pairs.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "links"
    )
    seen = _print(edges)
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where(F.col("v") > F.col("u"))
            .join(least, "u")
            .select(F.col("v").alias("hi"), F.col("m").alias("lo"))
            .distinct()
        )
        large = store(large, "large")
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").where(F.col("lo") != F.col("m")).select(
            F.col("lo").alias("hi"), F.col("m").alias("lo")
        )
        edges = store(
            small.unionAll(root.select("hi", F.col("m").alias("lo"))).distinct(), "links"
        )
        now = _print(edges)
        if now == seen:
            break
        seen = now
    stars = edges.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    roots = edges.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    return stars.unionAll(roots)


def _print(edges: DataFrame) -> tuple:
    """Row count and an order-free sum of hashes: two numbers to the driver."""
    hashed = F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), hashed).first())
