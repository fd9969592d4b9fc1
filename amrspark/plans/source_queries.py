"""Assembly checks, row validation, ingestion and versions over the graded tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from amrspark import fixed
from amrspark.operators.features import gene_calls
from amrspark.plans import bindings as B
from amrspark.plans.feature_bindings import CALLS_SQL, events_hits, hits as hit_exprs
from amrspark.session import work_folder
from amrspark.sources import fasta, store, tables
from amrspark.streaming import ingest

# `part` as assembly records: a brand is a genome, a part a contig; some records are broken.
_SEQ = (
    "repeat(translate(md5(cast(p_partkey as string)), '0123456789abcdef', 'ACGTACGTACGTACGT'),"
    " p_size)"
)
_RECORDS = [
    "p_brand AS genome_id",
    "p_partkey AS ord",
    """case when p_partkey % 197 = 3 then ' '
       when p_partkey % 211 = 5 then 'contig_twice of a plasmid'
       else concat('contig_', cast(p_partkey as string), ' ', p_name) end AS header""",
    f"""case when p_partkey % 223 = 7 then '' when p_partkey % 227 = 11 then 'MKLV'
       when p_partkey % 229 = 13 then 'NNNN'
       else lower(concat({_SEQ}, ' ', 'acgtn')) end AS body""",
]
_LIMITS = {"max_contigs": 900, "min_total": 60_000, "max_total": 900_000}


def _records(spark, sf_dir):
    return B.table(spark, sf_dir, "part").selectExpr(*_RECORDS)


def fasta_contigs(spark, sf_dir):
    return fasta.contigs(_records(spark, sf_dir)).select(
        "genome_id", "ord", "contig_id", "length", "nucleotide", "canonical"
    )


def fasta_qc(spark, sf_dir):
    return fasta.assembly_qc(_records(spark, sf_dir), **_LIMITS)


def fasta_truncation(spark, sf_dir):
    measured = fasta.assembly_qc(_records(spark, sf_dir), **_LIMITS)
    expected = (
        B.table(spark, sf_dir, "part")
        .groupBy(F.col("p_brand").alias("genome_id"))
        .agg(F.count("*").alias("n"), F.sum(F.col("p_size") * 32 + 5).alias("total"))
        .selectExpr(
            "genome_id",
            "case when genome_id = 'Brand#3' then '7' when genome_id = 'Brand#4' then 'x' "
            "else cast(n as string) end AS contigs",
            "case when genome_id in ('Brand#5', 'Brand#6') then cast(total * 2 as string) "
            "else cast(total as string) end AS genome_length",
        )
    )
    return fasta.truncation_problems(measured, expected, tolerance=0.05)


def hit_validation(spark, sf_dir):
    """One bad row rejects its genome; events get values outside the closed sets here and there."""
    hits = _typed(spark, sf_dir)
    _, rejected = tables.validated_hits(hits)
    return rejected


def hit_validation_kept(spark, sf_dir):
    good, _ = tables.validated_hits(_typed(spark, sf_dir))
    return good.groupBy("genome_id").agg(F.count("*").alias("n"))


_EXTRA = [
    "'x' AS sequence_name",
    "case when event_id % 401 = 0 then 'odd' else 'core' end AS scope",
    "'AMR' AS element_type",
    "case when event_id % 397 = 0 then 100.5 when event_id % 409 = 1 then null else 99.5 end"
    " AS pct_coverage",
    "100.0 AS pct_identity",
    "'c1' AS contig_id",
    "case when event_id % 503 = 2 then 0 else event_id + 1 end AS start",
    "event_id + 100 AS stop",
    "'+' AS strand",
]


def _typed(spark, sf_dir):
    exprs = hit_exprs(B.spark_hash) + _EXTRA
    return B.table(spark, sf_dir, "events").selectExpr(*exprs)


def _ingested(spark, sf_dir):
    """The events file taken by a stream that validates it; a second run adds nothing."""
    out = work_folder(spark, "ingest")
    schema = B.table(spark, sf_dir, "events").schema

    def events():
        reader = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
        return reader.parquet(sf_dir).selectExpr(*hit_exprs(B.spark_hash), *_EXTRA)

    for _ in range(2):
        ingest.ingest_stream(events(), out, f"{out}/_checkpoint", tables.validated_hits)
    return out


def incremental_ingest(spark, sf_dir):
    """Calls of the sound genomes, read back."""
    return ingest.stored(spark, _ingested(spark, sf_dir))


def ingest_rejected(spark, sf_dir):
    """Genomes that the ingestion set aside, after compaction."""
    out = _ingested(spark, sf_dir)
    ingest.compact(spark, out, f"{out}-compact")
    return ingest.stored(spark, f"{out}-compact", "rejected")


def unfinished_genomes(spark, sf_dir):
    """Orders without a finished line item still have to be processed."""
    orders = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("genome_id"))
    lines = B.table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'")
    return ingest.unfinished(orders, lines.select(F.col("l_orderkey").alias("genome_id")))


def latest_version(spark, sf_dir):
    rows = B.table(spark, sf_dir, "lineitem").selectExpr(
        f"split_part('{'|'.join(fixed.PANEL)}', '|', cast(l_partkey % 5 + 1 as int)) AS antibiotic",
        "case when l_linenumber = 7 then 'draft' else concat('v', cast(l_suppkey % 13 + 1 as string))"
        " end AS version",
    )
    return store.latest(rows)


def field_projection(spark, sf_dir):
    """Fixed field list, absent fields empty."""
    df = B.table(spark, sf_dir, "supplier").withColumnRenamed("s_name", "genome_name")
    return tables.project_fields(df, ("s_suppkey", "genome_name", "pmid", "vendor"))


def null_spellings(spark, sf_dir):
    from amrspark.functions import text

    raw = B.table(spark, sf_dir, "orders").selectExpr(
        "case o_orderkey % 5 when 0 then 'NA' when 1 then '' when 2 then 'N/A' when 3 then 'na' "
        "else o_orderstatus end AS v"
    )
    return raw.groupBy(text.null_spellings("v").alias("v")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        fasta_contigs, fasta_qc, fasta_truncation, hit_validation, hit_validation_kept,
        incremental_ingest, ingest_rejected, unfinished_genomes, latest_version, field_projection, null_spellings,
    )
}

_CONTIGS = f"""records AS (SELECT {', '.join(_RECORDS)} FROM part),
seqs AS (SELECT *, upper(regexp_replace(body, '\\s', '', 'g')) AS seq FROM records),
contigs AS (SELECT genome_id, ord, regexp_extract(header, '^\\s*(\\S*)', 1) AS contig_id,
  length(seq) AS length, NOT regexp_matches(seq, '[^ACGTUNRYSWKMBDHV]') AS nucleotide,
  regexp_matches(seq, '[ACGT]') AS canonical FROM seqs),
flagged AS (SELECT *, CASE WHEN contig_id = '' THEN 'missing_id'
  WHEN row_number() OVER (PARTITION BY genome_id, contig_id ORDER BY ord) > 1 THEN 'duplicate_id'
  WHEN length = 0 THEN 'empty_sequence' WHEN NOT nucleotide THEN 'not_nucleotide'
  WHEN NOT canonical THEN 'all_ambiguous' END AS e FROM contigs),
qc AS (SELECT genome_id, count(*) AS n_contigs, cast(sum(length) AS bigint) AS total_length,
  CASE WHEN count(*) > {_LIMITS['max_contigs']} THEN 'too_many_contigs'
    WHEN count(e) > 0 THEN arg_min(e, ord) FILTER (WHERE e IS NOT NULL)
    WHEN sum(length) NOT BETWEEN {_LIMITS['min_total']} AND {_LIMITS['max_total']}
      THEN 'total_length' END AS error FROM flagged GROUP BY genome_id)"""
_VALID = f"""typed AS (SELECT {', '.join(hit_exprs(B.duck_hash) + _EXTRA)} FROM events),
marked AS (SELECT *, CASE WHEN scope <> 'core' THEN 'scope' WHEN pct_coverage IS NULL
  OR pct_coverage > 100 THEN 'pct_coverage' WHEN start < 1 THEN 'start' END AS bad FROM typed),
rejected AS (SELECT genome_id, arg_min(bad, row_ord) AS error, count(*) AS n_bad FROM marked
  WHERE bad IS NOT NULL GROUP BY genome_id)"""

SQL = {
    "fasta_contigs": f"WITH {_CONTIGS} SELECT * FROM contigs",
    "fasta_qc": f"WITH {_CONTIGS} SELECT * FROM qc",
    "fasta_truncation": f"""WITH {_CONTIGS},
      ex AS (SELECT p_brand AS genome_id, CASE p_brand WHEN 'Brand#3' THEN 7 WHEN 'Brand#4' THEN NULL
        ELSE count(*) END AS c, sum(p_size * 32 + 5) * CASE WHEN p_brand IN ('Brand#5', 'Brand#6')
        THEN 2 ELSE 1 END AS l FROM part GROUP BY p_brand)
      SELECT genome_id, n_contigs, total_length, CASE WHEN n_contigs = 0 OR total_length = 0
        THEN 'empty' WHEN n_contigs <> c THEN 'contig_count'
        WHEN abs(total_length - l) / l > 0.05 THEN 'length' END AS problem
      FROM qc JOIN ex USING (genome_id)""",
    "hit_validation": f"WITH {_VALID} SELECT * FROM rejected",
    "hit_validation_kept": f"""WITH {_VALID} SELECT genome_id, count(*) AS n FROM typed
      WHERE genome_id NOT IN (SELECT genome_id FROM rejected) GROUP BY genome_id""",
    "incremental_ingest": f"""WITH {CALLS_SQL}, {_VALID}
      SELECT * FROM calls WHERE genome_id NOT IN (SELECT genome_id FROM rejected)""",
    "ingest_rejected": f"WITH {_VALID} SELECT * FROM rejected",
    "unfinished_genomes": """SELECT o_orderkey AS genome_id FROM orders WHERE o_orderkey NOT IN
      (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')""",
    "latest_version": f"""SELECT split_part('{'|'.join(fixed.PANEL)}', '|',
        cast(l_partkey % 5 + 1 AS int)) AS antibiotic,
      'v' || max(l_suppkey % 13 + 1) FILTER (WHERE l_linenumber <> 7) AS version
      FROM lineitem GROUP BY 1""",
    "field_projection": """SELECT s_suppkey, s_name AS genome_name, '' AS pmid, '' AS vendor
      FROM supplier""",
    "null_spellings": """SELECT CASE o_orderkey % 5 WHEN 3 THEN 'na' WHEN 4 THEN o_orderstatus END
      AS v, count(*) AS n FROM orders GROUP BY ALL""",
}
