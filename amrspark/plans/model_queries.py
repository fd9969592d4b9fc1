"""Models on `embeddings`, the capped subset, and split reproduction."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Window
from pyspark.sql import functions as F

from amrspark import fixed
from amrspark.operators import groups as G
from amrspark.operators import labels as L
from amrspark.operators import models as MO
from amrspark.operators import subset as S
from amrspark.plans import bindings as B
from amrspark.plans import label_queries
from amrspark.sources import store
from amrspark.plans.bindings import CANON_SQL, GROUPS_SQL
from amrspark.plans.group_queries import SPLIT_BASE, cohort, split_sql

_DIM = 64


def _rows(spark, sf_dir):
    """Vectors as genomes, low and high labels as sides, groups from a hash of the id."""
    emb = B.table(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("vec_id").cast("string").alias("genome_id"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
        F.when(F.col("label") >= 5, "R").otherwise("S").alias("side"),
        F.concat(F.lit("g"), F.expr(B.spark_hash("cast(vec_id as string)")) % 40).alias("grp"),
        (F.col("label") == 9).alias("gate_fired"),
    )


def _trained(spark, sf_dir):
    names = [f"d{i:02d}" for i in range(_DIM)]
    return MO.train_drug(_rows(spark, sf_dir), "vectors", names)


def model_scores(spark, sf_dir):
    return _trained(spark, sf_dir).scores


def model_metrics(spark, sf_dir):
    return _trained(spark, sf_dir).metrics


def train_summary(spark, sf_dir):
    """The summary of a run over two drugs: one trained, one without enough rows."""
    trained = _trained(spark, sf_dir)
    names = [f"d{i:02d}" for i in range(_DIM)]
    few = MO.train_drug(_rows(spark, sf_dir).where("side = 'S'"), "one side", names)
    return MO.summary({"vectors": trained, "one side": few})


def model_cards(spark, sf_dir):
    trained = _trained(spark, sf_dir)
    head = trained.model.join(trained.conformal, "antibiotic").withColumn("version", F.lit("v1"))
    order = Window.partitionBy("antibiotic").orderBy(F.abs("coefficient").desc(), "feature")
    ranked = trained.coefficients.withColumn("rank", F.row_number().over(order))
    return store.model_cards(head, MO.headline(trained.metrics), ranked)


def capped_subset(spark, sf_dir):
    labels, _ = L.majority_vote(label_queries.working(spark, sf_dir))
    meta = G.with_mlst(B.metadata(spark, sf_dir))
    binary = L.binary_labels(labels)
    grouped = G.assign_groups(binary.select("genome_id").distinct(), meta, ["genome_id"])
    return S.capped_subset(binary, grouped, cap=60, drugs=fixed.PANEL, per_drug_target=8).genomes.select(
        "genome_id", F.array_join("cells", ",").alias("cells"), "grp"
    )


def subset_candidates(spark, sf_dir):
    labels, _ = L.majority_vote(label_queries.working(spark, sf_dir))
    meta = G.with_mlst(B.metadata(spark, sf_dir))
    binary = L.binary_labels(labels)
    grouped = G.assign_groups(binary.select("genome_id").distinct(), meta, ["genome_id"])
    rows = S.candidates(binary, grouped, fixed.PANEL)
    return rows.select("genome_id", F.array_join("cells", ",").alias("cells"), "grp")


def split_reproduction(spark, sf_dir):
    """The same seed gives the same split: genomes compared with a second run, and how many differ;
    then against a run of another seed, where many do."""
    one, _ = G.make_split(cohort(spark, sf_dir), ["drug"])
    out = []
    for seed in (0, 4):
        two, _ = G.make_split(cohort(spark, sf_dir), ["drug"], seed=seed)
        both = one.select("genome_id", "drug", F.col("split").alias("a")).join(
            two.select("genome_id", "drug", F.col("split").alias("b")), ["genome_id", "drug"], "full_outer"
        )
        differs = ~F.col("a").eqNullSafe(F.col("b"))
        counted = both.groupBy("drug").agg(F.count("*").alias("n"), F.count_if(differs).alias("n_different"))
        out.append(counted.withColumn("seed", F.lit(seed)))
    return out[0].unionByName(out[1])


QUERIES = {
    f.__name__: f
    for f in (model_scores, model_metrics, train_summary, model_cards, capped_subset, subset_candidates, split_reproduction)
}

# One genome a step: the one closing most cells below 8, then the lowest id, no group beyond 9 of 60.
_GREEDY = f"""WITH RECURSIVE {CANON_SQL}, {GROUPS_SQL},
  b AS (SELECT genome_id, list_sort(list(antibiotic || '|' || substr(sir, 1, 1))) AS cells FROM labels0
    WHERE sir IN ('Resistant', 'Susceptible') AND list_contains({list(fixed.PANEL)!r}, antibiotic)
    GROUP BY genome_id),
  cand AS MATERIALIZED (SELECT genome_id, cells, coalesce(grp, 'singleton:' || genome_id) AS grp
    FROM b LEFT JOIN grouped USING (genome_id)),
  pick(n, ids, grps, full_cells) AS (
    SELECT 0, []::varchar[], []::varchar[], []::varchar[]
    UNION ALL
    SELECT n + 1, list_append(ids, b.genome_id), list_append(grps, b.grp), list_concat(full_cells, b.cells)
    FROM (SELECT any_value(n) AS n, any_value(ids) AS ids, any_value(grps) AS grps,
        any_value(full_cells) AS full_cells, arg_min({{genome_id: genome_id, grp: grp, cells: cells}},
          {{s: -score, genome_id: genome_id}}) AS b FROM (
      SELECT p.n, p.ids, p.grps, p.full_cells, c.genome_id, c.grp, c.cells,
        len(list_filter(c.cells, lambda x: len(list_filter(p.full_cells, lambda y: y = x)) < 8)) AS score
      FROM pick p, cand c WHERE p.n < 60 AND NOT list_contains(p.ids, c.genome_id)
        AND len(list_filter(p.grps, lambda g: g = c.grp)) < 9) s
    WHERE score > 0 HAVING count(*) > 0) t),
  last AS (SELECT * FROM pick ORDER BY n DESC LIMIT 1),
  rest AS (SELECT c.*, n, len(list_filter(grps, lambda g: g = c.grp)) AS used,
      row_number() OVER (PARTITION BY c.grp ORDER BY c.genome_id) AS i
    FROM cand c, last WHERE NOT list_contains(ids, c.genome_id)),
  more AS (SELECT genome_id, n, row_number() OVER (ORDER BY used, genome_id) AS k FROM rest
    WHERE i <= 9 - used)
  SELECT genome_id, array_to_string(cells, ',') AS cells, grp FROM cand
  WHERE genome_id IN (SELECT unnest(ids) FROM last) OR genome_id IN (SELECT genome_id FROM more WHERE k <= 60 - n)"""

SQL = {
    "capped_subset": _GREEDY,
    "subset_candidates": f"""WITH {CANON_SQL}, {GROUPS_SQL},
      b AS (SELECT genome_id, string_agg(antibiotic || '|' || substr(sir, 1, 1), ','
        ORDER BY antibiotic || '|' || substr(sir, 1, 1)) AS cells FROM labels0
        WHERE sir IN ('Resistant', 'Susceptible') GROUP BY genome_id)
      SELECT genome_id, cells, coalesce(grp, 'singleton:' || genome_id) AS grp
      FROM b LEFT JOIN grouped USING (genome_id)""",
    "split_reproduction": f"""WITH {SPLIT_BASE}, {split_sql(0)}, {split_sql(4, "again")}
      SELECT drug, count(*) AS n, cast(0 AS bigint) AS n_different, 0 AS seed FROM split_rows GROUP BY drug
      UNION ALL SELECT drug, count(*), count(*) FILTER (WHERE a.split <> b.split), 4
      FROM split_rows a JOIN again_rows b USING (drug, genome_id) GROUP BY drug""",
}
