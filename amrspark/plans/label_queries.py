"""Label pipeline over `lineitem` seen as laboratory tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from amrspark import fixed
from amrspark.functions import text
from amrspark.operators import labels as L
from amrspark.plans import bindings as B
from amrspark.plans.bindings import CANON_SQL


def working(spark, sf_dir):
    return L.with_canonical(L.lab_rows(B.tests(spark, sf_dir)))


def label_table(spark, sf_dir):
    return L.label_table(working(spark, sf_dir)).withColumn(
        "sir_majority_fraction", F.round("sir_majority_fraction", 9)
    )


def label_votes(spark, sf_dir):
    resolved, _ = L.majority_vote(working(spark, sf_dir))
    return resolved.withColumn("sir_majority_fraction", F.round("sir_majority_fraction", 9))


def label_conflicts(spark, sf_dir):
    _, dropped = L.majority_vote(working(spark, sf_dir))
    return dropped.groupBy("genome_id", "antibiotic", "sir").agg(F.count("*").alias("n"))


def canonical_terms(spark, sf_dir):
    rows = L.with_canonical(B.tests(spark, sf_dir)).select(
        "antibiotic",
        F.coalesce("sir", F.lit("none")).alias("sir"),
        F.coalesce(text.mic_sign("measurement"), F.lit("none")).alias("sign"),
        F.coalesce(text.binary_side("sir"), F.lit("none")).alias("side"),
        text.number("measurement_value").alias("v"),
    )
    return rows.groupBy("antibiotic", "sir", "sign", "side").agg(
        F.count("*").alias("n"), F.count("v").alias("n_value"), F.sum("v").alias("sum_value")
    )


def evidence_counts(spark, sf_dir):
    return L.value_counts(B.tests(spark, sf_dir), "evidence")


def phenotype_counts(spark, sf_dir):
    return L.value_counts(B.tests(spark, sf_dir), "resistant_phenotype")


def taxon_filter(spark, sf_dir):
    kept = B.tests(spark, sf_dir).where(F.col("taxon_id") == fixed.TAXON_ID)
    return L.value_counts(kept, "evidence")


def drug_counts(spark, sf_dir):
    return L.drug_counts(working(spark, sf_dir))


def standard_breakdown(spark, sf_dir):
    return L.standard_breakdown(working(spark, sf_dir))


def manifest_per_drug(spark, sf_dir):
    rows = working(spark, sf_dir)
    _, dropped = L.majority_vote(rows)
    return L.manifest_per_drug(rows, dropped)


def _flagged(spark, sf_dir):
    labels, _ = L.majority_vote(working(spark, sf_dir))
    with_file = B.table(spark, sf_dir, "orders").where("o_orderstatus <> 'O'")
    return L.with_fasta_flag(
        labels, with_file.select(F.col("o_orderkey").cast("string").alias("genome_id"))
    )


def fasta_flags(spark, sf_dir):
    return _flagged(spark, sf_dir).groupBy("antibiotic", "has_fasta").agg(F.count("*").alias("n"))


def manifest(spark, sf_dir):
    from amrspark.operators import groups as G

    raw = B.tests(spark, sf_dir)
    lab = L.lab_rows(raw)
    rows = L.with_canonical(lab)
    _, dropped = L.majority_vote(rows)
    meta = G.with_mlst(B.metadata(spark, sf_dir))
    counts = L.manifest_counts(raw, lab, rows, _flagged(spark, sf_dir), dropped, meta)
    return counts.withColumn("value", F.round("value", 9))


def binary_labels(spark, sf_dir):
    labels, _ = L.majority_vote(working(spark, sf_dir))
    return L.binary_labels(labels).select("genome_id", "antibiotic", "sir_binary")


def eligible_ids(spark, sf_dir):
    labels, _ = L.majority_vote(working(spark, sf_dir))
    sizes = L.binary_labels(labels)
    return L.eligible_ids(sizes, fixed.PANEL[:3], 10)


def label_contract(spark, sf_dir):
    """The contract check on labels of which every seventh genome has a damaged class."""
    rows = working(spark, sf_dir)
    labels = L.with_fasta_flag(L.label_table(rows), rows.select("genome_id"))
    seventh = F.col("genome_id").cast("bigint") % 7 == 0
    damaged = labels.withColumn("sir", F.when(seventh, F.concat(F.lit("?"), "sir")).otherwise(F.col("sir")))
    return L.contract_violations(damaged).groupBy("sir").agg(F.count("*").alias("n"))


def source_reconcile(spark, sf_dir):
    events = B.table(spark, sf_dir, "events")
    local = events.groupBy(F.col("event_type").alias("value")).agg(F.count("*").alias("n"))
    remote = (
        events.where("event_type <> 'error'")
        .groupBy(F.col("event_type").alias("value"))
        .agg(F.count_if(F.col("value") < 100).alias("n"))
    )
    return L.reconcile_counts(local, remote)


def selected_ids(spark, sf_dir):
    orders = B.table(spark, sf_dir, "orders")
    lines = B.table(spark, sf_dir, "lineitem")
    return L.selected_ids(
        orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("genome_id")),
        lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("genome_id")),
    )


def capped_ids(spark, sf_dir):
    return L.selected_ids(
        B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("genome_id")),
        B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("genome_id")),
        limit=25,
    )


def dedupe_first(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("text", "doc_id", "lang", "source")
    first = L.first_per_key(docs, ["text"], ["doc_id"])
    return first.select("doc_id", "lang", "source")


QUERIES = {
    f.__name__: f
    for f in (
        label_table, label_votes, label_conflicts, canonical_terms, evidence_counts,
        phenotype_counts, taxon_filter, drug_counts, standard_breakdown, manifest_per_drug,
        fasta_flags, manifest, binary_labels, eligible_ids, label_contract, source_reconcile,
        selected_ids, capped_ids, dedupe_first,
    )
}

_FLAGGED = """flagged AS (SELECT l.*, o.o_orderkey IS NOT NULL AS has_fasta FROM labels0 l
  LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O') o
  ON l.genome_id = cast(o.o_orderkey AS string))"""

_CLASS_COUNTS = """count(*) FILTER (WHERE sir = 'Resistant') AS resistant,
  count(*) FILTER (WHERE sir = 'Susceptible') AS susceptible,
  count(*) FILTER (WHERE sir = 'Intermediate') AS intermediate,
  count(*) FILTER (WHERE sir = 'Nonsusceptible') AS nonsusceptible,
  count(*) FILTER (WHERE sir = 'Susceptible-dose dependent') AS susceptible_dose_dependent,
  count(*) AS total, count(DISTINCT genome_id) AS n_unique_genomes"""

_STD_COUNTS = """count(*) FILTER (WHERE upper(std) = 'CLSI') AS clsi,
  count(*) FILTER (WHERE upper(std) = 'EUCAST') AS eucast,
  count(*) FILTER (WHERE coalesce(upper(std), '') NOT IN ('CLSI', 'EUCAST')) AS other_or_blank"""

SQL = {
    "label_votes": f"""WITH {CANON_SQL}
      SELECT genome_id, antibiotic, sir, sir_source_rows, sir_n_agree,
        round(sir_majority_fraction, 9) AS sir_majority_fraction FROM labels0""",
    "label_conflicts": f"""WITH {CANON_SQL}
      SELECT genome_id, antibiotic, sir, count(*) AS n FROM dropped GROUP BY ALL""",
    "label_table": f"""WITH {CANON_SQL},
      units AS (SELECT genome_id, antibiotic, unit, row_number() OVER (
          PARTITION BY genome_id, antibiotic ORDER BY count(*) DESC, unit) AS r
        FROM working WHERE unit IS NOT NULL GROUP BY genome_id, antibiotic, unit),
      mine AS (SELECT w.* FROM working w JOIN units u USING (genome_id, antibiotic, unit)
        WHERE r = 1),
      med AS (SELECT genome_id, antibiotic, unit, median(value) AS mic_value FROM mine
        GROUP BY ALL),
      signs AS (SELECT genome_id, antibiotic, sign, row_number() OVER (
          PARTITION BY genome_id, antibiotic ORDER BY count(*) DESC, sign) AS r
        FROM mine WHERE sign IS NOT NULL GROUP BY genome_id, antibiotic, sign),
      stds AS (SELECT genome_id, antibiotic, std, row_number() OVER (
          PARTITION BY genome_id, antibiotic ORDER BY count(*) DESC, std) AS r
        FROM working WHERE std IS NOT NULL GROUP BY genome_id, antibiotic, std),
      prov AS (SELECT genome_id, antibiotic, min(yr) AS y0, max(yr) AS y1,
        coalesce(string_agg(DISTINCT method, ';' ORDER BY method), '') AS methods
        FROM working GROUP BY ALL)
      SELECT l.genome_id, l.antibiotic, l.sir, l.sir_source_rows, l.sir_n_agree,
        round(l.sir_majority_fraction, 9) AS sir_majority_fraction,
        m.mic_value, g.sign AS mic_sign, m.unit AS mic_unit,
        coalesce(s.std, '') AS dominant_testing_standard,
        p.y0 AS testing_standard_year_min, p.y1 AS testing_standard_year_max,
        p.methods AS lab_typing_methods
      FROM labels0 l JOIN prov p USING (genome_id, antibiotic)
      LEFT JOIN med m USING (genome_id, antibiotic)
      LEFT JOIN (SELECT * FROM signs WHERE r = 1) g USING (genome_id, antibiotic)
      LEFT JOIN (SELECT * FROM stds WHERE r = 1) s USING (genome_id, antibiotic)""",
    "canonical_terms": f"""WITH {CANON_SQL.replace("WHERE evidence = 'Laboratory Method'", "WHERE true").replace("AND trim(coalesce(laboratory_typing_method, '')) <> ''", "")}
      SELECT antibiotic, coalesce(sir, 'none') AS sir, coalesce(sign, 'none') AS sign,
        CASE sir WHEN 'Resistant' THEN 'R' WHEN 'Susceptible' THEN 'S' ELSE 'none' END AS side,
        count(*) AS n, count(value) AS n_value, sum(value) AS sum_value
      FROM working GROUP BY ALL""",
    "evidence_counts": f"""WITH raw AS ({B.TESTS_SQL})
      SELECT coalesce(evidence, '<blank>') AS value, count(*) AS n FROM raw GROUP BY ALL""",
    "phenotype_counts": f"""WITH raw AS ({B.TESTS_SQL})
      SELECT coalesce(resistant_phenotype, '<blank>') AS value, count(*) AS n FROM raw
      GROUP BY ALL""",
    "taxon_filter": f"""WITH raw AS ({B.TESTS_SQL})
      SELECT coalesce(evidence, '<blank>') AS value, count(*) AS n FROM raw
      WHERE taxon_id = '573' GROUP BY ALL""",
    "drug_counts": f"""WITH {CANON_SQL}
      SELECT antibiotic, {_CLASS_COUNTS} FROM working GROUP BY antibiotic""",
    "standard_breakdown": f"""WITH {CANON_SQL}
      SELECT antibiotic, {_STD_COUNTS} FROM working GROUP BY antibiotic""",
    "manifest_per_drug": f"""WITH {CANON_SQL},
      lost AS (SELECT antibiotic, count(*) AS d FROM dropped GROUP BY ALL)
      SELECT antibiotic, {_CLASS_COUNTS}, {_STD_COUNTS},
        coalesce(any_value(d), 0) AS dropped_conflict
      FROM working LEFT JOIN lost USING (antibiotic) GROUP BY antibiotic""",
    "fasta_flags": f"""WITH {CANON_SQL}, {_FLAGGED}
      SELECT antibiotic, has_fasta, count(*) AS n FROM flagged GROUP BY ALL""",
    "manifest": f"""WITH {CANON_SQL}, {_FLAGGED}, {B.GROUPS_SQL},
      m AS (SELECT count(*) AS t, count(st) AS w FROM grouped)
      SELECT 'raw_rows' AS metric, cast(count(*) AS double) AS value FROM raw
      UNION ALL SELECT 'lab_rows', count(*) FROM lab
      UNION ALL SELECT 'labels_after_collapse', count(*) FROM labels0
      UNION ALL SELECT 'dropped_conflict', count(*) FROM dropped
      UNION ALL SELECT 'dropped_uncanonical_sir', count(*) FROM working WHERE sir IS NULL
      UNION ALL SELECT 'unique_genomes', count(DISTINCT genome_id) FROM labels0
      UNION ALL SELECT 'genomes_with_fasta', count(*) FROM flagged WHERE has_fasta
      UNION ALL SELECT 'genomes_total', t FROM m
      UNION ALL SELECT 'with_st', w FROM m
      UNION ALL SELECT 'missing_st', t - w FROM m
      UNION ALL SELECT 'missing_fraction', round((t - w) / t, 9) FROM m""",
    "binary_labels": f"""WITH {CANON_SQL}
      SELECT genome_id, antibiotic, substr(sir, 1, 1) AS sir_binary FROM labels0
      WHERE sir IN ('Resistant', 'Susceptible')""",
    "eligible_ids": f"""WITH {CANON_SQL},
      kept AS (SELECT * FROM labels0 WHERE sir IN ('Resistant', 'Susceptible')
        AND antibiotic IN ('meropenem', 'ceftriaxone', 'ciprofloxacin'))
      SELECT DISTINCT genome_id FROM kept JOIN (SELECT antibiotic FROM kept GROUP BY antibiotic
        HAVING count(*) >= 10) USING (antibiotic)""",
    "label_contract": f"""WITH {B.CANON_SQL} SELECT '?' || sir AS sir, count(*) AS n FROM labels0
      WHERE cast(genome_id AS bigint) % 7 = 0 GROUP BY ALL""",
    "source_reconcile": """WITH l AS (SELECT event_type AS value, count(*) AS local_n FROM events
        GROUP BY ALL),
      r AS (SELECT event_type AS value, count(*) FILTER (WHERE value < 100) AS remote_n FROM events
        WHERE event_type <> 'error' GROUP BY event_type)
      SELECT coalesce(l.value, r.value) AS value, coalesce(local_n, 0) AS local_n,
        coalesce(remote_n, 0) AS remote_n,
        abs(coalesce(local_n, 0) - coalesce(remote_n, 0)) AS delta,
        CASE WHEN coalesce(local_n, 0) = coalesce(remote_n, 0) THEN 'matches'
          ELSE 'investigate before trusting counts' END AS verdict
      FROM l FULL OUTER JOIN r ON l.value = r.value""",
    "selected_ids": """SELECT o_orderkey AS genome_id FROM orders WHERE o_orderstatus = 'F'
      UNION SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'""",
    "capped_ids": """SELECT genome_id FROM (SELECT o_orderkey AS genome_id FROM orders
      UNION SELECT l_orderkey FROM lineitem) ORDER BY genome_id LIMIT 25""",
    "dedupe_first": """SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (
      PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1""",
}
