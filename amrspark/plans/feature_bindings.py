"""`events` seen as annotation hits: one genome per (user, hash of the event)."""

from __future__ import annotations

from amrspark.plans import bindings as B

# Parallel lists: symbol, class, subclass.
GENES = (
    ("blaSHV-11", "BETA-LACTAM", "BETA-LACTAM"),
    ("blaKPC-3", "BETA-LACTAM", "CARBAPENEM"),
    ("blaCTX-M-15", "BETA-LACTAM", "CEPHALOSPORIN"),
    ("blaSHV-12", "", ""),
    ("blaTEM-1", "BETA-LACTAM", "BETA-LACTAM"),
    ("armA", "AMINOGLYCOSIDE", "GENTAMICIN"),
    ("rmtB1", "AMINOGLYCOSIDE", "AMINOGLYCOSIDE"),
    ("aac(3)-IIa", "AMINOGLYCOSIDE", "GENTAMICIN"),
    ("aph(6)-Id", "AMINOGLYCOSIDE", "STREPTOMYCIN"),
    ("aac(6')-Ib-cr5", "AMINOGLYCOSIDE/QUINOLONE", "AMIKACIN/QUINOLONE"),
    ("qnrB1", "QUINOLONE", "QUINOLONE"),
    ("oqxA", "PHENICOL/QUINOLONE", "PHENICOL/QUINOLONE"),
    ("sul1", "SULFONAMIDE", "SULFONAMIDE"),
    ("sul2", "SULFONAMIDE", ""),
    ("dfrA12", "TRIMETHOPRIM", "TRIMETHOPRIM"),
    ("catA1", "PHENICOL", "CHLORAMPHENICOL"),
    ("tet(A)", "TETRACYCLINE", "TETRACYCLINE"),
    ("fosA", "FOSFOMYCIN", "FOSFOMYCIN"),
    ("mph(A)", "MACROLIDE", "MACROLIDE"),
    ("newGene-1", "", ""),
    ("ydgH-like", "", ""),
    ("blaNDM-1", "BETA-LACTAM", "CARBAPENEM"),
    ("fieF", "", ""),
)
POINTS = ("gyrA_S83Y", "parC_S80I", "gyrA_D87N", "pmrB_R256G", "blaTEM-1")
DISRUPTS = ("ompK35_fs", "ompK36_fs", "ramR_del")


def _pick(values, index):
    joined = "|".join(values)
    return f"split_part({B.text_literal(joined)}, '|', cast({index} as int))"


_I = f"(event_id * 7 % {len(GENES)} + 1)"


def hits(h) -> list[str]:
    return [
        f"concat(cast(user_id as string), '.', cast({h('cast(event_id as string)')} % 12 as string))"
        " AS genome_id",
        "event_id AS row_ord",
        f"""case event_type when 'error' then {_pick(POINTS, f'(event_id % {len(POINTS)} + 1)')}
        when 'signup' then {_pick(DISRUPTS, f'(event_id % {len(DISRUPTS)} + 1)')}
        else {_pick([g for g, _, _ in GENES], _I)} end AS gene_symbol""",
        """case event_type when 'error' then 'POINT' when 'signup' then 'POINT_DISRUPT'
        when 'view' then case when event_id % 5 = 0 then 'METAL' else 'AMR' end
        else 'AMR' end AS element_subtype""",
        f"""case when event_id % 4 = 0 then null
        else nullif({_pick([c for _, c, _ in GENES], _I)}, '') end AS drug_class""",
        f"""case when event_id % 4 = 0 then null
        else nullif({_pick([s for _, _, s in GENES], _I)}, '') end AS drug_subclass""",
        "case event_id % 3 when 0 then 'EXACTX' when 1 then 'BLASTX' "
        "else 'PARTIAL_CONTIG_ENDX' end AS method",
    ]


HITS_SQL = f"SELECT {', '.join(hits(B.duck_hash))} FROM events"


def events_hits(spark, sf_dir):
    return B.table(spark, sf_dir, "events").selectExpr(*hits(B.spark_hash))


CALLS_SQL = f"""
hits AS ({HITS_SQL}),
genomes AS (SELECT DISTINCT genome_id FROM hits),
calls AS (SELECT genome_id, gene_symbol AS gene,
  bool_or(element_subtype = 'AMR') AS is_amr,
  bool_or(element_subtype IN ('POINT', 'POINT_DISRUPT')) AS is_point,
  bool_or(element_subtype = 'POINT_DISRUPT') AS is_disrupt,
  count(*) FILTER (WHERE element_subtype = 'AMR') AS hit_count,
  arg_min(method, row_ord) FILTER (WHERE element_subtype = 'AMR') AS method,
  arg_min(drug_class, row_ord) FILTER (WHERE element_subtype = 'AMR' AND drug_class IS NOT NULL)
    AS drug_class,
  arg_min(drug_subclass, row_ord) FILTER (WHERE element_subtype = 'AMR'
    AND drug_class IS NOT NULL AND drug_subclass IS NOT NULL) AS drug_subclass,
  bool_or(element_subtype = 'AMR' AND method = 'PARTIAL_CONTIG_ENDX') AS partial_end,
  bool_or(element_subtype = 'AMR' AND drug_class IS NULL) AS unmapped
  FROM hits WHERE element_subtype IN ('AMR', 'POINT', 'POINT_DISRUPT') GROUP BY ALL),
flags AS (SELECT *,
  is_amr AND coalesce(drug_subclass = 'CARBAPENEM', false) AS carb,
  is_amr AND coalesce(drug_subclass = 'CEPHALOSPORIN', false) AS esbl,
  is_amr AND coalesce(drug_subclass IN ('CEPHALOSPORIN', 'CARBAPENEM'), false) AS ceph,
  is_amr AND regexp_matches(lower(gene), '^(arma$|rmt)') AS rmt,
  is_amr AND regexp_matches(lower(gene), '^(aac|aph|ant)\\(') AS ame,
  is_amr AND (regexp_matches(lower(gene), '^(qnr|qepa|oqx)')
    OR contains(lower(gene), 'aac(6'')-ib-cr')) AS pmqr,
  is_amr AND starts_with(lower(gene), 'sul') AS sul,
  is_amr AND starts_with(lower(gene), 'dfr') AS dfr,
  is_point AND regexp_matches(lower(gene), '^(gyra|parc)[_-]') AS qrdr,
  is_disrupt AND starts_with(lower(gene), 'ompk') AS porin FROM calls),
eng AS (SELECT g.genome_id,
  cast(count(*) FILTER (WHERE qrdr) AS double) AS "eng:n_qrdr_mutations",
  cast(coalesce(bool_or(pmqr), false) AS double) AS "eng:has_pmqr",
  cast(coalesce(bool_or(rmt), false) AS double) AS "eng:has_rmtase",
  cast(coalesce(bool_or(ame), false) AS double) AS "eng:has_ame",
  cast(coalesce(bool_or(carb), false) AS double) AS "eng:has_carbapenemase",
  cast(coalesce(bool_or(esbl), false) AS double) AS "eng:has_esbl_or_ampc",
  cast(coalesce(bool_or(sul), false) AS double) AS "eng:has_sul",
  cast(coalesce(bool_or(dfr), false) AS double) AS "eng:has_dfr",
  cast(coalesce(bool_or(porin), false) AS double) AS "eng:porin_disrupted"
  FROM genomes g LEFT JOIN flags f USING (genome_id) GROUP BY g.genome_id),
eng_rows AS (UNPIVOT eng ON COLUMNS('^eng:') INTO NAME feature VALUE value),
vocab0 AS (SELECT DISTINCT gene AS feature, 0 AS k, 'gene' AS kind, 0 AS e FROM calls WHERE is_amr
  UNION ALL SELECT DISTINCT gene, 1, 'mutation', 0 FROM calls c WHERE is_point
    AND gene NOT IN (SELECT gene FROM calls WHERE is_amr)
  UNION ALL SELECT * FROM (VALUES ('eng:n_qrdr_mutations', 2, 'engineered', 1),
   ('eng:has_pmqr', 2, 'engineered', 2), ('eng:has_rmtase', 2, 'engineered', 3),
   ('eng:has_ame', 2, 'engineered', 4), ('eng:has_carbapenemase', 2, 'engineered', 5),
   ('eng:has_esbl_or_ampc', 2, 'engineered', 6), ('eng:has_sul', 2, 'engineered', 7),
   ('eng:has_dfr', 2, 'engineered', 8), ('eng:porin_disrupted', 2, 'engineered', 9))),
vocab AS (SELECT cast(row_number() OVER (ORDER BY k, e, feature) - 1 AS int) AS idx, feature, kind
  FROM vocab0),
present AS (SELECT genome_id, gene AS feature, cast(1 AS double) AS value FROM calls
  UNION ALL SELECT genome_id, feature, value FROM eng_rows WHERE value <> 0)
"""

GATE_SQL = """
lists AS (SELECT g.genome_id,
  list(gene ORDER BY gene) FILTER (WHERE carb) AS carb,
  list(gene ORDER BY gene) FILTER (WHERE ceph) AS ceph,
  list(gene ORDER BY gene) FILTER (WHERE rmt) AS rmt,
  list(gene ORDER BY gene) FILTER (WHERE pmqr) AS pmqr,
  list(gene ORDER BY gene) FILTER (WHERE qrdr) AS qrdr,
  list(gene ORDER BY gene) FILTER (WHERE sul) AS sul,
  list(gene ORDER BY gene) FILTER (WHERE dfr) AS dfr
  FROM genomes g LEFT JOIN flags f USING (genome_id) GROUP BY g.genome_id),
filled AS (SELECT genome_id, coalesce(carb, []) AS carb, coalesce(ceph, []) AS ceph,
  coalesce(rmt, []) AS rmt, coalesce(pmqr, []) AS pmqr, coalesce(qrdr, []) AS qrdr,
  coalesce(sul, []) || coalesce(dfr, []) AS folate FROM lists),
gate AS (
  SELECT genome_id, 'meropenem' AS antibiotic, 'carbapenemase_present' AS r, carb AS m, true AS c
    FROM filled
  UNION ALL SELECT genome_id, 'ceftriaxone', 'esbl_ampc_or_carbapenemase_present', ceph, true
    FROM filled
  UNION ALL SELECT genome_id, 'ciprofloxacin',
    CASE WHEN len(qrdr) >= 2 THEN 'qrdr_double_mutation' ELSE 'qrdr_plus_pmqr' END,
    CASE WHEN len(qrdr) >= 2 THEN qrdr WHEN len(qrdr) = 1 AND len(pmqr) > 0 THEN qrdr || pmqr
      ELSE [] END, false FROM filled
  UNION ALL SELECT genome_id, 'gentamicin', '16s_rmtase_present', rmt, true FROM filled
  UNION ALL SELECT genome_id, 'trimethoprim-sulfamethoxazole', 'sul_or_dfr_present', folate, false
    FROM filled)
"""
