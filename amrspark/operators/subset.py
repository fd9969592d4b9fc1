"""A capped genome subset that fills per-drug quotas and spreads over homology groups.

The rule takes one genome at a time: the one that closes most open quota cells, lowest id first.
Between two moments at which a cell fills up nothing changes but the groups' room, so whole runs of
choices are made at once, each by a few ordered windows over a table of the candidates. The number
of runs follows from the drugs, not from the cap or the data; only counts per cell reach the driver.
Candidates are first cut to a set that provably holds every genome the rule can take.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from amrspark.operators.labels import first_per_key
from amrspark.session import cut


@dataclass
class Subset:
    genomes: DataFrame  # genome_id, cells, grp
    cells: DataFrame  # cell, n
    groups: DataFrame  # grp, n
    drugs: DataFrame  # antibiotic, resistant, susceptible, met


def candidates(binary: DataFrame, groups: DataFrame, drugs: tuple[str, ...]) -> DataFrame:
    """genome_id, sorted cells `drug|side`, grp. A genome without a group is its own."""
    cell = F.concat_ws("|", "antibiotic", "sir_binary")
    rows = binary.where(F.col("antibiotic").isin(*drugs))
    per = rows.groupBy("genome_id").agg(F.array_sort(F.collect_set(cell)).alias("cells"))
    known = first_per_key(groups.select("genome_id", "grp"), ["genome_id"], ["grp"])
    alone = F.concat(F.lit("singleton:"), F.col("genome_id"))
    joined = per.join(known, "genome_id", "left")
    return joined.select("genome_id", "cells", F.coalesce("grp", alone).alias("grp"))


def pruned(rows: DataFrame, cap: int, group_cap: int) -> DataFrame:
    """Candidates the quota phase can reach. Both rank filters also run before their shuffle."""
    sig = F.array_join("cells", ",")
    inner = Window.partitionBy("_sig", "grp").orderBy("genome_id")
    outer = Window.partitionBy("_sig").orderBy("genome_id")
    bound = cap + (cap // group_cap) * group_cap
    kept = (
        rows.withColumn("_sig", sig)
        .withColumn("_i", F.row_number().over(inner))
        .where(F.col("_i") <= group_cap)
        .withColumn("_o", F.row_number().over(outer))
        .where(F.col("_o") <= bound)
    )
    return kept.select("genome_id", "cells", "grp")


_TAKEN = "genome_id string, cells array<string>, grp string"


def fill_quotas(pool: DataFrame, cap: int, target: int, group_cap: int) -> DataFrame:
    """The genomes of `pool` (genome_id, cells, grp) that the quota rule takes.

    Each round takes a run: the allowed genomes of the best score, in id order, up to the first one
    that fills a cell, or to the cap. A group gives no more than its room, lowest ids first. The
    ordered part of a round has at most `cap` rows.
    """
    cells = [r["cell"] for r in pool.select(F.explode("cells").alias("cell")).distinct().collect()]
    counts = dict.fromkeys(sorted(cells), 0)
    taken = pool.sparkSession.createDataFrame([], _TAKEN)
    size = 0
    while size < cap:
        missing = [c for c, n in counts.items() if n < target]
        if not missing:
            break
        run = cut(_run(pool, taken, cap - size, {c: target - counts[c] for c in missing}, group_cap))
        sums = [F.count_if(F.array_contains("cells", c)).alias(f"c{i}") for i, c in enumerate(counts)]
        found = run.agg(F.count("*").alias("n"), *sums).first()
        if not found["n"]:
            break
        taken = taken.unionByName(run)
        size += found["n"]
        counts = {c: n + found[f"c{i}"] for i, (c, n) in enumerate(counts.items())}
    return taken


def _run(pool: DataFrame, taken: DataFrame, most: int, room: dict[str, int], group_cap: int) -> DataFrame:
    """The next run: `room` has, per open cell, how many more it takes."""
    used = taken.groupBy("grp").agg(F.count("*").alias("_used"))
    score = F.size(F.array_intersect("cells", F.array(*[F.lit(c) for c in room])))
    rows = pool.join(taken.select("genome_id"), "genome_id", "left_anti").withColumn("_score", score)
    rows = rows.where(F.col("_score") > 0).join(used, "grp", "left")
    inside = F.row_number().over(Window.partitionBy("grp", "_score").orderBy("genome_id"))
    rows = rows.withColumn("_i", inside).where(F.col("_i") <= group_cap - F.coalesce("_used", F.lit(0)))
    ahead = rows.orderBy(F.col("_score").desc(), "genome_id").limit(most)
    # From here on at most `most` rows, those of the best score first.
    best = F.max("_score").over(Window.partitionBy(F.lit(0)))
    before = Window.partitionBy("_score").orderBy("genome_id").rowsBetween(Window.unboundedPreceding, -1)
    full = [F.coalesce(F.count_if(F.array_contains("cells", c)).over(before), F.lit(0)) >= n for c, n in room.items()]
    flags = ahead.withColumn("_best", best).withColumn("_full", F.exists(F.array(*full), lambda x: x))
    return flags.where((F.col("_score") == F.col("_best")) & ~F.col("_full")).select("genome_id", "cells", "grp")


def capped_subset(
    binary: DataFrame,
    groups: DataFrame,
    *,
    cap: int,
    drugs: tuple[str, ...],
    per_drug_target: int = 40,
    max_group_fraction: float = 0.15,
) -> Subset:
    """Quotas first, then genomes of the least represented groups up to the cap."""
    if cap <= 0:
        raise ValueError("cap must be positive")
    spark = binary.sparkSession
    group_cap = max(1, int(max_group_fraction * cap))
    rows = cut(candidates(binary, groups, drugs))
    picked = cut(fill_quotas(cut(pruned(rows, cap, group_cap)), cap, per_drug_target, group_cap))
    chosen = picked.select("genome_id")
    taken = picked.groupBy("grp").agg(F.count("*").alias("_taken"))
    rest = rows.join(chosen, "genome_id", "left_anti").join(taken, "grp", "left")
    rest = rest.fillna(0, ["_taken"])
    rank = F.row_number().over(Window.partitionBy("grp").orderBy("genome_id"))
    # The fixed bound comes first: Spark then cuts large groups before their shuffle.
    room = rest.withColumn("_i", rank).where(F.col("_i") <= group_cap)
    room = room.where(F.col("_i") <= group_cap - F.col("_taken"))
    extra = room.orderBy("_taken", "genome_id").limit(cap - picked.count())
    genomes = picked.unionByName(extra.select("genome_id", "cells", "grp"))
    cells = genomes.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    seen = rows.select(F.explode("cells").alias("cell")).distinct()
    cells = seen.join(cells, "cell", "left").fillna(0, ["n"])
    sides = cells.select(
        F.split_part("cell", F.lit("|"), F.lit(1)).alias("antibiotic"),
        F.split_part("cell", F.lit("|"), F.lit(2)).alias("side"),
        "n",
    )
    per_drug = sides.groupBy("antibiotic").agg(
        F.coalesce(F.max(F.when(F.col("side") == "R", F.col("n"))), F.lit(0)).alias("resistant"),
        F.coalesce(F.max(F.when(F.col("side") == "S", F.col("n"))), F.lit(0)).alias("susceptible"),
    )
    all_drugs = spark.createDataFrame([(d,) for d in drugs], "antibiotic string")
    per_drug = all_drugs.join(per_drug, "antibiotic", "left").fillna(0, ["resistant", "susceptible"])
    met = F.least("resistant", "susceptible") >= per_drug_target
    return Subset(
        genomes,
        cells,
        genomes.groupBy("grp").agg(F.count("*").alias("n")),
        per_drug.withColumn("met", met),
    )
