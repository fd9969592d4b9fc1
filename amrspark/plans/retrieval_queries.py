"""Retrieval of `documents` for every `benchmark` text, and of catalog chunks for report rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from amrspark.operators import retrieval as R
from amrspark.plans import bindings as B
from amrspark.plans import decide_queries, feature_queries
from amrspark.plans.decide_queries import _BASE, _REPORT


def _docs(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select("doc_id", "text")


def _asked(spark, sf_dir):
    return B.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _final(df):
    return df.select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


def term_counts(spark, sf_dir):
    return R.term_counts(_docs(spark, sf_dir)).select("doc_id", "token", "tf")


def document_frequencies(spark, sf_dir):
    return R.document_frequencies(R.term_counts(_docs(spark, sf_dir)))


def hashed_vectors(spark, sf_dir):
    out = R.text_vectors(_docs(spark, sf_dir))
    return out.withColumn("weight", F.round("weight", 9))


def bm25_scores(spark, sf_dir):
    index = R.build_index(_docs(spark, sf_dir), vectors=False)
    return R.bm25_scores(index, _asked(spark, sf_dir)).withColumn("score", F.round("score", 6))


def bm25_topk(spark, sf_dir):
    index = R.build_index(_docs(spark, sf_dir), vectors=False)
    return _final(R.retrieve(index, _asked(spark, sf_dir), dense=False))


def dense_topk(spark, sf_dir):
    index = R.build_index(_docs(spark, sf_dir))
    return _final(R.retrieve(index, _asked(spark, sf_dir), lexical=False))


def rrf_topk(spark, sf_dir):
    return _final(R.retrieve(R.build_index(_docs(spark, sf_dir)), _asked(spark, sf_dir)))


def gene_evidence(spark, sf_dir):
    rows = decide_queries._report(spark, sf_dir)
    chunks = feature_queries.catalog_chunks(spark, sf_dir)
    out = R.evidence_for_genes(rows, chunks)
    return out.withColumn("score", F.round("score", 9))


QUERIES = {
    f.__name__: f
    for f in (
        term_counts, document_frequencies, hashed_vectors, bm25_scores, bm25_topk, dense_topk,
        rrf_topk, gene_evidence,
    )
}

_H = B.duck_hash
_INDEX = """
dtok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ts FROM corpus),
qtok AS (SELECT query_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ts FROM asked),
dp AS (SELECT doc_id, token, count(*) AS tf, any_value(dl) AS dl FROM
  (SELECT doc_id, unnest(ts) AS token, len(ts) AS dl FROM dtok) GROUP BY doc_id, token),
qp AS (SELECT query_id, token, count(*) AS qtf FROM
  (SELECT query_id, unnest(ts) AS token FROM qtok) GROUP BY ALL),
size AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM dtok),
idf0 AS (SELECT token, ln(any_value(n) - count(*) + 0.5::double) - ln(count(*) + 0.5::double) AS i
  FROM dp CROSS JOIN size GROUP BY token),
idf AS (SELECT token, CASE WHEN i < 0 THEN 0.25::double * (SELECT avg(i) FROM idf0) ELSE i END AS i
  FROM idf0),
bm AS (SELECT query_id, doc_id, round(sum(qtf * i * (tf * 2.5::double / (tf + 1.5::double *
    (0.25::double + 0.75::double * dl / avgdl)))), 9) AS score
  FROM dp JOIN qp USING (token) JOIN idf USING (token) CROSS JOIN size GROUP BY ALL),
allpairs AS (SELECT DISTINCT a.query_id, d.doc_id FROM asked a CROSS JOIN corpus d),
bmr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id
    ORDER BY coalesce(score, 0) DESC, doc_id) AS r
  FROM allpairs LEFT JOIN bm USING (query_id, doc_id))"""
_VECTORS = f"""
db AS (SELECT doc_id, cast({_H('token')} % 256 AS int) AS bucket, sum(tf) AS c FROM dp GROUP BY ALL),
qb AS (SELECT query_id, cast({_H('token')} % 256 AS int) AS bucket, sum(qtf) AS c FROM qp
  GROUP BY ALL),
dv AS (SELECT *, c / sqrt(cast(sum(c * c) OVER (PARTITION BY doc_id) AS double)) AS w FROM db),
qv AS (SELECT *, c / sqrt(cast(sum(c * c) OVER (PARTITION BY query_id) AS double)) AS w FROM qb),
dn AS (SELECT query_id, doc_id, round(sum(dv.w * qv.w), 9) AS score FROM dv JOIN qv USING (bucket)
  GROUP BY ALL),
dnr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id
    ORDER BY coalesce(score, 0) DESC, doc_id) AS r
  FROM allpairs LEFT JOIN dn USING (query_id, doc_id))"""
_TABLES = """corpus AS (SELECT doc_id, text FROM documents),
asked AS (SELECT item_id AS query_id, text FROM benchmark)"""


def _top(terms: str) -> str:
    return f"""f AS (SELECT query_id, doc_id, round(sum(1 / (60::double + r)), 12) AS s FROM ({terms})
        GROUP BY ALL),
      o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS k FROM f)
      """


_PICK = """SELECT query_id, doc_id, round(s, 9) AS score, cast(k AS int) AS rank FROM o
  WHERE k <= 5"""

SQL = {
    "term_counts": f"WITH {_TABLES}, {_INDEX} SELECT doc_id, token, tf FROM dp",
    "document_frequencies": f"WITH {_TABLES}, {_INDEX} SELECT token, count(*) AS df FROM dp "
    "GROUP BY token",
    "hashed_vectors": f"""WITH {_TABLES}, {_INDEX}, {_VECTORS}
      SELECT doc_id, bucket, round(w, 9) AS weight FROM dv""",
    "bm25_scores": f"""WITH {_TABLES}, {_INDEX} SELECT query_id, doc_id, round(score, 6) AS score
      FROM bm WHERE score <> 0""",
    "bm25_topk": f"WITH {_TABLES}, {_INDEX}, {_top('SELECT * FROM bmr')} {_PICK}",
    "dense_topk": f"WITH {_TABLES}, {_INDEX}, {_VECTORS}, {_top('SELECT * FROM dnr')} {_PICK}",
    "rrf_topk": f"""WITH {_TABLES}, {_INDEX}, {_VECTORS},
      {_top('SELECT * FROM bmr UNION ALL SELECT * FROM dnr')} {_PICK}""",
    "gene_evidence": f"""{_BASE}, {_REPORT},
      chunks AS ({feature_queries.SQL['catalog_chunks']}),
      corpus AS (SELECT chunk_id AS doc_id, gene_family || ' ' || text AS text FROM chunks),
      want AS (SELECT genome_id, antibiotic, trim(antibiotic || ' ' ||
        replace(supporting_features, ' # ', ' ')) AS text FROM report),
      asked AS (SELECT DISTINCT text AS query_id, text FROM want), {_INDEX},
      {_top('SELECT * FROM bmr')}
      SELECT genome_id, antibiotic, doc_id AS chunk_id, round(s, 9) AS score,
        cast(k AS int) AS rank FROM want JOIN o ON query_id = text WHERE k <= 5""",
}
