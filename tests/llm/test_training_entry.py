import __spark_entry__ as entry
import corpus_pipeline
import oracle
import pytest
from amrspark.llm import queries
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"


def test_registered():
    names = set(entry.queries())
    assert {*queries.QUERIES, "pipeline"} <= names and len(queries.QUERIES) == 13
    assert set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = oracle.connect(SF_DIR)
    assert oracle.compare(queries.QUERIES[name](spark, SF_DIR), con, queries.SQL[name]) == ""


def odd_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (5000, None, "en", "s", None), (5001, "", "en", "s", 0), (5002, "Mail a@b.org. " * 3, "en", "s", 42)],
        docs.schema,
    )
    more = docs.unionAll(docs.where("doc_id = 3")).unionAll(odd)
    for name in ("chunk_id", "row", "score", "hits", "spans"):
        more = more.withColumn(name, F.lit("own"))
    return more


def test_stages(spark, tmp_path):
    docs = odd_documents(spark)
    columns = docs.columns
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF_DIR)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns
            assert docs.where("score <> 'own'").isEmpty()
            kept.append({r.doc_id for r in docs.collect()})
    assert kept[0] > kept[1] >= kept[2] == kept[3]
    redacted = spark.read.parquet(str(tmp_path / "3"))
    assert redacted.where(F.col("text").rlike("[a-z0-9]@[a-z]+[.]")).isEmpty()
    assert redacted.where("text is not null and n_chars <> length(text)").isEmpty()
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == kept[3]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, odd_documents(spark).limit(0), SF_DIR).count() == 0
