"""Homology groups and splits over `orders` and `customer` seen as genomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from amrspark.operators import groups as G
from amrspark.plans import bindings as B
from amrspark.plans.bindings import GROUPS_SQL

# One drug per order priority; the class comes from the status, the group from the metadata.
COHORT = [
    "cast(o_orderkey as string) AS genome_id",
    "o_orderpriority AS drug",
    "case o_orderstatus when 'F' then 'R' when 'O' then 'S' end AS y",
]
COHORT_SQL = f"""{GROUPS_SQL},
base AS (SELECT {', '.join(COHORT)} FROM orders WHERE o_orderstatus IN ('F', 'O')),
cohort AS (SELECT b.*, grp FROM base b JOIN grouped USING (genome_id))"""


def cohort(spark, sf_dir):
    orders = B.table(spark, sf_dir, "orders").where("o_orderstatus IN ('F', 'O')")
    meta = G.with_mlst(B.metadata(spark, sf_dir))
    return G.assign_groups(orders.selectExpr(*COHORT), meta, ["genome_id"])


def mlst_groups(spark, sf_dir):
    orders = B.table(spark, sf_dir, "orders").selectExpr("cast(o_orderkey as string) AS genome_id")
    meta = G.with_mlst(B.metadata(spark, sf_dir))
    return G.assign_groups(orders, meta, ["genome_id"])


def group_sizes(spark, sf_dir):
    return G.group_sizes(cohort(spark, sf_dir), ["drug"])


def min_n(spark, sf_dir):
    fine = cohort(spark, sf_dir).withColumn(
        "drug", F.concat_ws("|", "drug", F.regexp_extract("grp", "^[a-z]+:[a-z]*", 0))
    )
    return G.min_n(fine, ["drug"])


def holdout_group(spark, sf_dir):
    return G.holdout_group(cohort(spark, sf_dir), ["drug"])


def hash_folds(spark, sf_dir):
    rows = cohort(spark, sf_dir).withColumn("fold", G.hash_fold("grp", 5))
    return rows.groupBy("drug", "fold").agg(
        F.count("*").alias("n"), F.countDistinct("grp").alias("n_groups")
    )


def fold_balance(spark, sf_dir):
    rows = cohort(spark, sf_dir).withColumn("fold", G.hash_fold("grp", 5))
    return G.fold_balance(rows, ["drug"])


def leakage_check(spark, sf_dir):
    """A split by genome instead of by group leaks; every leaking group is listed."""
    rows = cohort(spark, sf_dir).withColumn("split", G.hash_fold("genome_id", 3))
    return G.leaking_groups(rows, ["drug"])


def grouped_folds(spark, sf_dir):
    rows = G.grouped_folds(cohort(spark, sf_dir), ["drug"])
    return G.fold_balance(rows, ["drug"])


def split_rows(spark, sf_dir):
    rows, _ = G.make_split(cohort(spark, sf_dir), ["drug"])
    return rows


def split_status(spark, sf_dir):
    _, status = G.make_split(cohort(spark, sf_dir), ["drug"])
    return status


def split_balance(spark, sf_dir):
    rows, _ = G.make_split(cohort(spark, sf_dir), ["drug"])
    return G.split_balance(rows, ["drug"])


def split_leakage(spark, sf_dir):
    """Groups of the split, and how many of them leak; then the same with a damaged split, where
    every seventh genome of the test part is moved to the training part."""
    rows, _ = G.make_split(cohort(spark, sf_dir), ["drug"])
    seventh = (F.col("genome_id").cast("bigint") % 7 == 0) & (F.col("split") == "test")
    damaged = rows.withColumn("split", F.when(seventh, "train").otherwise(F.col("split")))
    out = []
    for name, split in (("made", rows), ("damaged", damaged)):
        leaking = G.leaking_groups(split, ["drug"]).groupBy("drug").agg(F.count("*").alias("n_leaking"))
        groups = split.groupBy("drug").agg(F.countDistinct("grp").alias("n_groups"))
        out.append(
            groups.join(leaking, "drug", "left")
            .fillna(0, ["n_leaking"])
            .select("drug", F.lit(name).alias("input"), "n_groups", "n_leaking")
        )
    return out[0].unionByName(out[1])


QUERIES = {
    f.__name__: f
    for f in (
        mlst_groups, group_sizes, min_n, holdout_group, hash_folds, fold_balance, leakage_check,
        grouped_folds, split_rows, split_balance, split_status, split_leakage,
    )
}

_H = B.duck_hash


def _folds(groups: str, seed: int) -> str:
    """The dealing rule over a table of groups (drug, grp, n, n_r, n_s)."""
    return f"""SELECT drug, grp, n, n_r, n_s, cast(least(place % (2 * k), 2 * k - 1 - place % (2 * k)) AS int) AS fold
      FROM (SELECT *, greatest(2, least(5, g, CASE WHEN least(r, s) = 0 THEN greatest(r, s)
        ELSE least(r, s) END)) AS k FROM (SELECT *, count(*) OVER d AS g, sum(n_r) OVER d AS r,
          sum(n_s) OVER d AS s, row_number() OVER (PARTITION BY drug ORDER BY n_r DESC, n DESC,
          {_H(f"'{seed}:' || grp")}, grp) - 1 AS place FROM ({groups}) WINDOW d AS (PARTITION BY drug)))"""


_SIZES = """SELECT drug, grp, count(*) AS n, count(*) FILTER (WHERE y = 'R') AS n_r,
      count(*) FILTER (WHERE y = 'S') AS n_s, count(DISTINCT y) AS c FROM cohort GROUP BY drug, grp"""
SPLIT_BASE = f"""{COHORT_SQL},
      sizes AS ({_SIZES}),
      fit AS (SELECT drug FROM sizes GROUP BY drug
        HAVING sum(n_r) >= 20 AND sum(n_s) >= 20 AND count(*) >= 4),
      ordered AS (SELECT *, row_number() OVER (PARTITION BY drug ORDER BY c DESC, n DESC, grp) AS h
        FROM sizes JOIN fit USING (drug))"""


def split_sql(seed: int, name: str = "split") -> str:
    """The split of a seed as `<name>_rows`, after SPLIT_BASE."""
    return f"""{name}_outer AS ({_folds('SELECT drug, grp, n, n_r, n_s FROM ordered WHERE h > 1', seed)}),
      {name}_inner AS ({_folds(f'SELECT drug, grp, n, n_r, n_s FROM {name}_outer WHERE fold > 0', seed + 1)}),
      {name}_parts AS (SELECT drug, grp, 'holdout' AS split FROM ordered WHERE h = 1
        UNION ALL SELECT drug, grp, 'test' FROM {name}_outer WHERE fold = 0
        UNION ALL SELECT drug, grp, CASE fold WHEN 0 THEN 'calibration' ELSE 'train' END
        FROM {name}_inner),
      {name}_rows AS (SELECT c.*, split FROM cohort c JOIN {name}_parts USING (drug, grp))"""


_SPLIT = f"{SPLIT_BASE}, {split_sql(0)}"


def _balance(rows: str, fold: str) -> str:
    return f"""f AS (SELECT drug, {fold}, count(*) AS n_test,
        count(*) FILTER (WHERE y = 'R') AS test_resistant,
        count(*) FILTER (WHERE y = 'S') AS test_susceptible FROM {rows} GROUP BY ALL),
      t AS (SELECT *, cast(sum(n_test) OVER (PARTITION BY drug) AS bigint) - n_test AS n_train,
        cast(sum(test_resistant) OVER (PARTITION BY drug) AS bigint) - test_resistant
          AS train_resistant,
        cast(sum(test_susceptible) OVER (PARTITION BY drug) AS bigint) - test_susceptible
          AS train_susceptible FROM f)
      SELECT *, least(train_resistant, train_susceptible, test_resistant, test_susceptible) = 0
        AS degraded FROM t"""


SQL = {
    "mlst_groups": f"WITH {GROUPS_SQL} SELECT genome_id, grp FROM grouped",
    "group_sizes": f"""WITH {COHORT_SQL} SELECT drug, grp, count(*) AS n,
      count(*) FILTER (WHERE y = 'R') AS n_r, count(*) FILTER (WHERE y = 'S') AS n_s
      FROM cohort GROUP BY drug, grp""",
    "min_n": f"""WITH {COHORT_SQL},
      c AS (SELECT drug || '|' || regexp_extract(grp, '^[a-z]+:[a-z]*') AS drug,
        count(*) FILTER (WHERE y = 'R') AS r, count(*) FILTER (WHERE y = 'S') AS s
        FROM cohort GROUP BY ALL)
      SELECT drug, r AS n_resistant, s AS n_susceptible, r >= 20 AND s >= 20 AS ok,
        CASE WHEN NOT (r >= 20 AND s >= 20) THEN 'insufficient data: need >=20 R and >=20 S, have '
          || r || ' R / ' || s || ' S' END AS reason FROM c""",
    "holdout_group": f"""WITH {COHORT_SQL},
      g AS (SELECT drug, grp, count(*) AS n, count(DISTINCT y) AS c FROM cohort GROUP BY drug, grp)
      SELECT drug, grp AS holdout_group, n FROM (SELECT *, row_number() OVER (PARTITION BY drug
        ORDER BY c DESC, n DESC, grp) AS r FROM g) WHERE r = 1""",
    "hash_folds": f"""WITH {COHORT_SQL}
      SELECT drug, cast({_H("'0:' || grp")} % 5 AS int) AS fold, count(*) AS n,
        count(DISTINCT grp) AS n_groups FROM cohort GROUP BY ALL""",
    "fold_balance": f"""WITH {COHORT_SQL},
      hashed AS (SELECT drug, y, cast({_H("'0:' || grp")} % 5 AS int) AS fold FROM cohort), {_balance('hashed', 'fold')}""",
    "leakage_check": f"""WITH {COHORT_SQL}
      SELECT drug, grp, count(DISTINCT {_H("'0:' || genome_id")} % 3) AS n_splits FROM cohort
      GROUP BY drug, grp HAVING n_splits > 1""",
    "split_status": f"""WITH {COHORT_SQL},
      c AS (SELECT drug, count(*) FILTER (WHERE y = 'R') AS r,
        count(*) FILTER (WHERE y = 'S') AS s, count(DISTINCT grp) AS g FROM cohort GROUP BY drug)
      SELECT drug, r AS n_resistant, s AS n_susceptible, r >= 20 AND s >= 20 AS ok,
        CASE WHEN NOT (r >= 20 AND s >= 20)
          THEN 'insufficient data: need >=20 R and >=20 S, have ' || r || ' R / ' || s || ' S'
          WHEN g < 4 THEN 'insufficient homology-group diversity: ' || g ||
            ' distinct group(s) < 4 needed' END AS reason, g AS n_groups FROM c""",
    "grouped_folds": f"""WITH {COHORT_SQL},
      dealt AS ({_folds(_SIZES, 0)}),
      rows_ AS (SELECT c.drug, c.y, fold FROM cohort c JOIN dealt USING (drug, grp)), {_balance('rows_', 'fold')}""",
    "split_rows": f"WITH {_SPLIT} SELECT * FROM split_rows",
    "split_balance": f"WITH {_SPLIT}, {_balance('split_rows', 'split')}",
    "split_leakage": f"""WITH {_SPLIT},
      both_ AS (SELECT 'made' AS input, drug, grp, split FROM split_rows UNION ALL
        SELECT 'damaged', drug, grp, CASE WHEN cast(genome_id AS bigint) % 7 = 0 AND split = 'test'
          THEN 'train' ELSE split END FROM split_rows),
      g AS (SELECT input, drug, grp, count(DISTINCT split) AS n FROM both_ GROUP BY ALL)
      SELECT drug, input, count(*) AS n_groups, count(*) FILTER (WHERE n > 1) AS n_leaking
      FROM g GROUP BY ALL""",
}
