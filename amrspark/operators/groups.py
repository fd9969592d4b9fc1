"""Homology groups, minimum counts, group-disjoint folds, and the capped subset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amrspark import fixed
from amrspark.functions import text
from amrspark.operators.labels import first_per_key
from amrspark.operators.ranking import numbered
from amrspark.session import cut


def with_mlst(metadata: DataFrame) -> DataFrame:
    """Split the sequence-type text; a table without it gets two null columns."""
    if "mlst" in metadata.columns:
        scheme, st = text.mlst("mlst")
    else:
        scheme, st = F.lit(None).cast("string"), F.lit(None).cast("int")
    return metadata.withColumns({"mlst_scheme": scheme, "mlst_st": st})


def assign_groups(genomes: DataFrame, metadata: DataFrame, order: list[str]) -> DataFrame:
    """Add `grp`. The first metadata row of a genome counts; a genome without one is alone."""
    first = first_per_key(
        metadata.select("genome_id", "mlst_scheme", "mlst_st", *[c for c in order if c not in ("genome_id", "mlst_scheme", "mlst_st")]),
        ["genome_id"],
        order,
    ).select("genome_id", "mlst_scheme", "mlst_st")
    joined = genomes.join(first, "genome_id", "left")
    group = text.group_id("mlst_scheme", "mlst_st", "genome_id").alias("grp")
    return joined.select(*genomes.columns, group)


def min_n(df: DataFrame, by: list[str], y: str = "y") -> DataFrame:
    """Whether each drug has enough of both sides, and the wording when it has not."""
    counted = df.groupBy(*by).agg(
        F.count_if(F.col(y) == "R").alias("n_resistant"),
        F.count_if(F.col(y) == "S").alias("n_susceptible"),
    )
    return _min_n_columns(counted)


def _min_n_columns(counted: DataFrame) -> DataFrame:
    n_r, n_s = F.col("n_resistant"), F.col("n_susceptible")
    ok = (n_r >= fixed.MIN_RESISTANT) & (n_s >= fixed.MIN_SUSCEPTIBLE)
    reason = F.format_string(
        f"insufficient data: need >={fixed.MIN_RESISTANT} R and "
        f">={fixed.MIN_SUSCEPTIBLE} S, have %d R / %d S",
        n_r,
        n_s,
    )
    return counted.withColumns({"ok": ok, "reason": F.when(~ok, reason)})


def group_sizes(df: DataFrame, by: list[str], group: str = "grp", y: str = "y") -> DataFrame:
    return df.groupBy(*by, group).agg(
        F.count("*").alias("n"),
        F.count_if(F.col(y) == "R").alias("n_r"),
        F.count_if(F.col(y) == "S").alias("n_s"),
    )


def holdout_group(df: DataFrame, by: list[str], group: str = "grp", y: str = "y") -> DataFrame:
    """Per drug the group kept aside: both classes first, then the largest, then the smallest id."""
    return _holdout(group_sizes(df, by, group, y), by, group)


def _holdout(sizes: DataFrame, by: list[str], group: str) -> DataFrame:
    one_sided = ((F.col("n_r") == 0) | (F.col("n_s") == 0)).cast("int")
    best = F.min_by(
        F.struct(group, "n"),
        F.struct(one_sided.alias("a"), (-F.col("n")).alias("b"), F.col(group).alias("c")),
    )
    return sizes.groupBy(*by).agg(best.alias("_g")).select(
        *by, F.col(f"_g.{group}").alias("holdout_group"), F.col("_g.n").alias("n")
    )


def leaking_groups(df: DataFrame, by: list[str], group: str = "grp", split: str = "split") -> DataFrame:
    """Groups found in more than one split; empty when the split is sound."""
    seen = df.where(F.col(split).isNotNull()).groupBy(*by, group).agg(
        F.countDistinct(split).alias("n_splits")
    )
    return seen.where(F.col("n_splits") > 1)


class LeakageError(RuntimeError):
    """A homology group lies on both sides of a split."""


def require_no_leakage(df: DataFrame, by: list[str]) -> None:
    found = leaking_groups(df, by).limit(1).collect()
    if found:
        raise LeakageError(f"group in several splits: {found[0].asDict()}")


def hash_fold(group: str | Column, k: int | Column, seed: int = 0) -> Column:
    """Fold of a group from its name alone: no shuffle, the same on every run."""
    group = F.col(group) if isinstance(group, str) else group
    k = F.lit(k) if isinstance(k, int) else k
    return F.pmod(text.hash32(F.concat(F.lit(f"{seed}:"), group)), k).cast("int")


def fold_balance(df: DataFrame, by: list[str], fold: str = "fold", y: str = "y") -> DataFrame:
    """Class counts inside and outside each fold; degraded when any of the four is zero."""
    inside = df.groupBy(*by, fold).agg(
        F.count("*").alias("n_test"),
        F.count_if(F.col(y) == "R").alias("test_resistant"),
        F.count_if(F.col(y) == "S").alias("test_susceptible"),
    )
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    names = {"n": "n_test", "resistant": "test_resistant", "susceptible": "test_susceptible"}
    out = inside.withColumns(
        {f"train_{k}" if k != "n" else "n_train": F.sum(v).over(whole) - F.col(v) for k, v in names.items()}
    )
    cells = F.least("train_resistant", "train_susceptible", "test_resistant", "test_susceptible")
    return out.withColumn("degraded", cells == 0)


def fold_groups(
    sizes: DataFrame,
    by: list[str],
    *,
    k: int = fixed.N_SPLITS,
    seed: int = 0,
    group: str = "grp",
    out: str = "fold",
) -> DataFrame:
    """Add a fold number to a table of groups (n, n_r, n_s), classes spread evenly over folds.

    The fold count falls to the number of groups or of the rarer class, but not below two. All
    groups follow one rule: in the order of resistant rows, then rows, both falling, then a seeded
    hash, they are dealt to the folds back and forth (0 .. k-1, k-1 .. 0, ...).
    """
    drug = sizes.groupBy(*by).agg(
        F.sum("n_r").alias("_r"), F.sum("n_s").alias("_s"), F.count("*").alias("_g")
    )
    one_class = F.greatest("_r", "_s")
    rarer = F.when(F.least("_r", "_s") == 0, one_class).otherwise(F.least("_r", "_s"))
    drug = drug.select(
        *by, F.greatest(F.lit(2), F.least(F.lit(k), F.col("_g"), rarer)).cast("int").alias("_k")
    )
    keyed = sizes.withColumns(
        {
            "_o1": -F.col("n_r"),
            "_o2": -F.col("n"),
            "_o3": text.hash32(F.concat(F.lit(f"{seed}:"), F.col(group))),
        }
    )
    placed = numbered(keyed, by, ["_o1", "_o2", "_o3", group], "_at").join(drug, by)
    turn = F.pmod(F.col("_at") - 1, 2 * F.col("_k"))
    fold = F.least(turn, 2 * F.col("_k") - 1 - turn).cast("int")
    return placed.select(*sizes.columns, fold.alias(out))


def grouped_folds(df: DataFrame, by: list[str], *, group: str = "grp", y: str = "y", out: str = "fold", **kw) -> DataFrame:
    """Add a fold number per row; rows of one group share it."""
    placed = fold_groups(group_sizes(df, by, group, y), by, group=group, out=out, **kw)
    return df.join(placed.select(*by, group, out), [*by, group])


def split_groups(
    sizes: DataFrame, by: list[str], *, k: int = fixed.N_SPLITS, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """(groups with `split`, status per drug) from the table of group sizes.

    Drugs with too few rows of a class or too few groups get a reason and no split. Otherwise one
    whole group is held out, fold 0 of the rest is the test part, and fold 0 of what then remains
    (next seed) is the calibration part.
    """
    totals = sizes.groupBy(*by).agg(
        F.sum("n_r").alias("n_resistant"),
        F.sum("n_s").alias("n_susceptible"),
        F.count("*").alias("n_groups"),
    )
    clonal = F.format_string(
        f"insufficient homology-group diversity: %d distinct group(s) < {fixed.MIN_GROUPS} needed",
        "n_groups",
    )
    status = _min_n_columns(totals).withColumn(
        "reason", F.coalesce("reason", F.when(F.col("n_groups") < fixed.MIN_GROUPS, clonal))
    )
    usable = sizes.join(status.where(F.col("reason").isNull()).select(*by), by, "left_semi")
    held = _holdout(usable, by, "grp").select(*by, F.col("holdout_group").alias("grp"))
    rest = usable.join(held, [*by, "grp"], "left_anti")
    outer = fold_groups(rest, by, k=k, seed=seed)
    test = outer.where(F.col("fold") == 0).withColumn("split", F.lit("test"))
    inner = fold_groups(outer.where(F.col("fold") != 0).drop("fold"), by, k=k, seed=seed + 1)
    inner = inner.withColumn("split", F.when(F.col("fold") == 0, "calibration").otherwise("train"))
    out = held.withColumn("split", F.lit("holdout"))
    parts = [p.select(*by, "grp", "split") for p in (test, inner, out)]
    return reduce(DataFrame.unionByName, parts), status


def make_split(df: DataFrame, by: list[str], *, k: int = fixed.N_SPLITS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows with `split`, status per drug) for rows with genome_id, y, grp.

    Decided on the table of groups, which is written once; the rows are only counted and joined.
    """
    sizes = cut(group_sizes(df, by))
    groups, status = split_groups(sizes, by, k=k, seed=seed)
    return df.join(groups, [*by, "grp"]), status


def split_balance(split: DataFrame, by: list[str], *, y: str = "y") -> DataFrame:
    """Rows and classes of each part of a split against all other rows of the drug, and whether
    any of these cells is empty: the balance report that belongs to a split."""
    return fold_balance(split, by, fold="split", y=y)
