"""Hits, vectors, vocabulary and gate over `events`; catalog over `part`."""

from __future__ import annotations

from pyspark.sql import functions as F

from amrspark import fixed
from amrspark.operators import decide as D
from amrspark.operators import features as FE
from amrspark.plans import bindings as B
from amrspark.plans.feature_bindings import CALLS_SQL, GATE_SQL, HITS_SQL, events_hits

DB_VERSION = "2026-05-15.1"


def _base(spark, sf_dir):
    hits = events_hits(spark, sf_dir)
    return hits, hits.select("genome_id").distinct(), FE.gene_calls(hits)


def hit_pivot(spark, sf_dir):
    return _base(spark, sf_dir)[2]


def feature_vectors(spark, sf_dir):
    _, genomes, calls = _base(spark, sf_dir)
    wide = FE.feature_vectors(calls, genomes, DB_VERSION)

    def entries(c):
        pairs = F.transform(
            F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))
        )
        return F.array_join(F.array_sort(pairs), ",").alias(c)

    return wide.select(
        "genome_id",
        *[
            entries(c)
            for c in (
                "gene_presence_method", "gene_hit_count", "gene_drug_class", "gene_drug_subclass",
            )
        ],
        *[
            F.array_join(F.array_sort(F.map_keys(c)), ",").alias(c)
            for c in ("gene_presence", "point_mutations", "point_mutation_disrupt")
        ],
        F.array_join("partial_contig_end_genes", ",").alias("partial_contig_end_genes"),
        F.array_join("unmapped_class_genes", ",").alias("unmapped_class_genes"),
        "schema_version",
        "db_version",
    )


def vocabulary(spark, sf_dir):
    return FE.vocabulary(_base(spark, sf_dir)[2])


def vocabulary_hash(spark, sf_dir):
    return FE.vocabulary_digest(FE.vocabulary(_base(spark, sf_dir)[2])).select("n_features", "sha256")


def _frozen(calls):
    """Vocabulary of the genes seen at least twice in some genome: leaves symbols unknown."""
    return FE.vocabulary(calls.where("is_point OR hit_count >= 2"))


def unknown_counts(spark, sf_dir):
    _, genomes, calls = _base(spark, sf_dir)
    return FE.unknown_counts(calls, genomes, _frozen(calls))


def engineered(spark, sf_dir):
    _, genomes, calls = _base(spark, sf_dir)
    return FE.engineered(calls, genomes)


def matrix_rows(spark, sf_dir):
    _, genomes, calls = _base(spark, sf_dir)
    return FE.matrix_rows(calls, FE.engineered(calls, genomes), FE.vocabulary(calls))


def matrix_vectors(spark, sf_dir):
    """Sparse vectors, reported as entries per genome and their sum."""
    from pyspark.ml.functions import vector_to_array

    _, genomes, calls = _base(spark, sf_dir)
    names = FE.feature_names(FE.vocabulary(calls))
    rows = FE.matrix_vectors(calls, FE.engineered(calls, genomes), names)
    values = vector_to_array("features")
    return rows.select(
        "genome_id",
        F.size(F.filter(values, lambda v: v != 0)).cast("bigint").alias("n_present"),
        F.aggregate(values, F.lit(0.0), lambda a, v: a + v).alias("total"),
    )


def gate_calls(spark, sf_dir):
    _, genomes, calls = _base(spark, sf_dir)
    gated = D.gate(FE.mechanism_hits(calls, genomes))
    return gated.select(
        "genome_id",
        "antibiotic",
        "gate_fired",
        "rule",
        "forced_verdict",
        F.array_join("matched_genes", ",").alias("matched_genes"),
        F.array_join("subclass_citations", ";").alias("subclass_citations"),
        "target_present",
    )


def gate_quiet(spark, sf_dir):
    """Genome and drug pairs the model has to serve."""
    _, genomes, calls = _base(spark, sf_dir)
    gated = D.gate(FE.mechanism_hits(calls, genomes))
    fired = gated.where("gate_fired").select("genome_id", "antibiotic")
    pairs = gated.select("genome_id", "antibiotic")
    return pairs.join(fired, ["genome_id", "antibiotic"], "left_anti")


def mechanism_counts(spark, sf_dir):
    _, genomes, calls = _base(spark, sf_dir)
    hits = FE.mechanism_hits(calls, genomes)
    return hits.agg(
        *[F.count_if(F.size(m) > 0).alias(m) for m in FE.MECHANISMS], F.count("*").alias("genomes")
    )


def _catalog(spark, sf_dir):
    """`part` as a catalog: name as allele, brand as family, type and size as class values."""
    return B.table(spark, sf_dir, "part").selectExpr(
        "case when p_size % 5 = 0 then null else p_name end AS allele",
        "p_brand AS gene_family",
        "case when p_size % 7 = 0 then '' else p_type end AS class",
        "case when p_size % 11 = 0 then null else concat('S', cast(p_size as string)) end"
        " AS subclass",
        "p_partkey AS ord",
    )


def _part_hits(spark, sf_dir):
    lines = B.table(spark, sf_dir, "lineitem").join(
        B.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    return lines.selectExpr(
        "l_orderkey",
        "l_linenumber",
        "case when l_linenumber % 2 = 0 then p_brand else p_name end AS gene_symbol",
        "case when l_returnflag = 'A' then null else 'own' end AS drug_class",
        "case when l_linestatus = 'F' then null else 'ownsub' end AS drug_subclass",
    )


def catalog_lookup(spark, sf_dir):
    by_allele, by_family = FE.catalog_lookups(_catalog(spark, sf_dir), ["ord"])
    return by_allele.withColumn("kind", F.lit("allele")).unionByName(
        by_family.withColumn("kind", F.lit("family"))
    )


def catalog_fallback(spark, sf_dir):
    by_allele, by_family = FE.catalog_lookups(_catalog(spark, sf_dir), ["ord"])
    filled = FE.fill_from_catalog(_part_hits(spark, sf_dir), by_allele, by_family)
    return filled.groupBy("gene_symbol", "drug_class", "drug_subclass").agg(
        F.count("*").alias("n")
    )


def catalog_chunks(spark, sf_dir):
    from amrspark.sources import chunks

    catalog = B.table(spark, sf_dir, "part").selectExpr(
        "case when p_size % 9 = 0 then ' ' else p_brand end AS gene_family",
        "case when p_size % 4 = 0 then null else p_name end AS product_name",
        "case p_type when 'ECONOMY' then 'carbapenem' when 'STANDARD' then 'QUINOLONE' "
        "else 'OTHER' end AS subclass",
        "p_partkey AS ord",
    )
    rows = chunks.from_catalog(catalog, ["ord"])
    return rows.withColumn("drugs", F.array_join("drugs", ","))


QUERIES = {
    f.__name__: f
    for f in (
        hit_pivot, feature_vectors, vocabulary, vocabulary_hash, unknown_counts, engineered,
        matrix_rows, matrix_vectors, gate_calls, gate_quiet, mechanism_counts, catalog_lookup,
        catalog_fallback, catalog_chunks,
    )
}


def _joined(value, condition):
    entry = f"gene || '=' || {value}"
    return f"coalesce(string_agg({entry}, ',' ORDER BY {entry}) FILTER (WHERE {condition}), '')"


def _named(condition):
    return f"coalesce(string_agg(gene, ',' ORDER BY gene) FILTER (WHERE {condition}), '')"


_CATALOG_SQL = """catalog AS (SELECT case when p_size % 5 = 0 then null else p_name end AS allele,
  p_brand AS gene_family, case when p_size % 7 = 0 then '' else p_type end AS class,
  case when p_size % 11 = 0 then null else 'S' || p_size end AS subclass, p_partkey AS ord
  FROM part),
good AS (SELECT * FROM catalog WHERE coalesce(class, '') <> '' AND coalesce(subclass, '') <> ''),
al AS (SELECT allele AS key, class, subclass FROM (SELECT *, row_number() OVER (
  PARTITION BY allele ORDER BY ord) AS r FROM good WHERE allele IS NOT NULL) WHERE r = 1),
fa AS (SELECT gene_family AS key, class, subclass FROM (SELECT *, row_number() OVER (
  PARTITION BY gene_family ORDER BY ord) AS r FROM good) WHERE r = 1)"""

SQL = {
    "hit_pivot": f"WITH {CALLS_SQL} SELECT * FROM calls",
    "feature_vectors": f"""WITH {CALLS_SQL}
      SELECT g.genome_id,
        {_joined('method', 'is_amr')} AS gene_presence_method,
        {_joined('hit_count', 'is_amr')} AS gene_hit_count,
        {_joined('drug_class', 'drug_class IS NOT NULL')} AS gene_drug_class,
        {_joined('drug_subclass', 'drug_subclass IS NOT NULL')} AS gene_drug_subclass,
        {_named('is_amr')} AS gene_presence, {_named('is_point')} AS point_mutations,
        {_named('is_disrupt')} AS point_mutation_disrupt,
        {_named('partial_end')} AS partial_contig_end_genes,
        {_named('unmapped')} AS unmapped_class_genes,
        '{fixed.SCHEMA_VERSION}' AS schema_version, '{DB_VERSION}' AS db_version
      FROM genomes g LEFT JOIN calls c USING (genome_id) GROUP BY g.genome_id""",
    "vocabulary": f"WITH {CALLS_SQL} SELECT idx, feature, kind FROM vocab",
    "vocabulary_hash": f"""WITH {CALLS_SQL} SELECT count(*) AS n_features,
      sha256(string_agg(feature, chr(10) ORDER BY idx)) AS sha256 FROM vocab""",
    "unknown_counts": f"""WITH {CALLS_SQL},
      known AS (SELECT gene FROM calls WHERE is_point OR hit_count >= 2)
      SELECT g.genome_id, cast(coalesce(sum(cast(is_amr AS int) + cast(is_point AS int))
        FILTER (WHERE gene NOT IN (SELECT gene FROM known)), 0) AS bigint) AS oov
      FROM genomes g LEFT JOIN calls c USING (genome_id) GROUP BY g.genome_id""",
    "engineered": f"WITH {CALLS_SQL} SELECT * FROM eng",
    "matrix_rows": f"""WITH {CALLS_SQL} SELECT feature, genome_id, value, idx FROM present
      JOIN vocab USING (feature)""",
    "matrix_vectors": f"""WITH {CALLS_SQL} SELECT g.genome_id, count(value) AS n_present,
      coalesce(sum(value), 0) AS total FROM genomes g LEFT JOIN present p USING (genome_id)
      GROUP BY g.genome_id""",
    "gate_calls": f"""WITH {CALLS_SQL}, {GATE_SQL},
      cited AS (SELECT genome_id, antibiotic, string_agg(x.g || ' (AMRFinderPlus Subclass=' ||
          coalesce(drug_subclass, 'unknown') || ')', ';' ORDER BY x.g) AS cites
        FROM (SELECT genome_id, antibiotic, unnest(m) AS g FROM gate WHERE c) x
        JOIN calls ON calls.genome_id = x.genome_id AND gene = x.g GROUP BY ALL)
      SELECT genome_id, antibiotic, len(m) > 0 AS gate_fired,
        CASE WHEN len(m) > 0 THEN r END AS rule,
        CASE WHEN len(m) > 0 THEN 'likely_to_fail' END AS forced_verdict,
        array_to_string(m, ',') AS matched_genes, coalesce(cites, '') AS subclass_citations,
        true AS target_present
      FROM gate LEFT JOIN cited USING (genome_id, antibiotic)""".replace(
        "SELECT genome_id, antibiotic, string_agg(x.g",
        "SELECT x.genome_id, x.antibiotic, string_agg(x.g",
    ),
    "gate_quiet": f"""WITH {CALLS_SQL}, {GATE_SQL}
      SELECT genome_id, antibiotic FROM gate WHERE len(m) = 0""",
    "mechanism_counts": f"""WITH {CALLS_SQL}, p AS (SELECT genome_id, bool_or(carb) AS carb,
        bool_or(esbl) AS esbl, bool_or(ceph) AS ceph, bool_or(rmt) AS rmt, bool_or(ame) AS ame,
        bool_or(pmqr) AS pmqr, bool_or(sul) AS sul, bool_or(dfr) AS dfr, bool_or(qrdr) AS qrdr,
        bool_or(porin) AS porin
        FROM genomes LEFT JOIN flags USING (genome_id) GROUP BY genome_id)
      SELECT count(*) FILTER (WHERE carb) AS carbapenemase, count(*) FILTER (WHERE esbl)
        AS esbl_ampc, count(*) FILTER (WHERE ceph) AS cephalosporin, count(*) FILTER (WHERE rmt)
        AS rmtase, count(*) FILTER (WHERE ame) AS ame, count(*) FILTER (WHERE pmqr) AS pmqr,
        count(*) FILTER (WHERE sul) AS sul, count(*) FILTER (WHERE dfr) AS dfr,
        count(*) FILTER (WHERE qrdr) AS qrdr, count(*) FILTER (WHERE porin) AS porin,
        count(*) AS genomes FROM p""",
    "catalog_lookup": f"""WITH {_CATALOG_SQL} SELECT *, 'allele' AS kind FROM al
      UNION ALL SELECT *, 'family' FROM fa""",
    "catalog_fallback": f"""WITH {_CATALOG_SQL},
      h AS (SELECT case when l_linenumber % 2 = 0 then p_brand else p_name end AS gene_symbol,
        case when l_returnflag = 'A' then null else 'own' end AS c,
        case when l_linestatus = 'F' then null else 'ownsub' end AS s
        FROM lineitem JOIN part ON l_partkey = p_partkey)
      SELECT gene_symbol,
        coalesce(c, CASE WHEN al.key IS NOT NULL THEN al.class ELSE fa.class END) AS drug_class,
        coalesce(s, CASE WHEN al.key IS NOT NULL THEN al.subclass ELSE fa.subclass END)
          AS drug_subclass, count(*) AS n
      FROM h LEFT JOIN al ON gene_symbol = al.key LEFT JOIN fa ON gene_symbol = fa.key
      GROUP BY ALL""",
    "catalog_chunks": """WITH c AS (SELECT trim(case when p_size % 9 = 0 then ' ' else p_brand end)
        AS gene_family, case when p_size % 4 = 0 then null else p_name end AS product,
        case p_type when 'ECONOMY' then 'meropenem' when 'STANDARD' then 'ciprofloxacin' else ''
        end AS drugs, p_partkey AS ord FROM part),
      f AS (SELECT *, row_number() OVER (PARTITION BY gene_family ORDER BY ord) AS r FROM c
        WHERE gene_family <> '' AND product IS NOT NULL)
      SELECT 'catalog:' || gene_family AS chunk_id, gene_family, drugs, product AS text,
        'NCBI Reference Gene Catalog' AS source FROM f WHERE r = 1""",
}
