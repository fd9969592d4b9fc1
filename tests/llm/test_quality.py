import zlib

from pyspark.sql import functions as F

from amrspark.llm.quality import STATISTICS, fit_rules, score_chunks, text_statistics

SF_DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumnRenamed("doc_id", "chunk_id")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").withColumnRenamed("doc_id", "chunk_id")
    got = score_chunks(docs, labels).join(labels, "chunk_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["chunk_id"]]).all()
    held = got[got["held_out"]]
    assert len(held) > 100 and (held["predicted"] == held["quality"]).mean() > 0.97
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.5)).all()


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumnRenamed("doc_id", "chunk_id").limit(300).cache()
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").select(F.col("doc_id").alias("chunk_id"), "quality")
    swapped = labels.withColumn(
        "quality",
        F.when(F.crc32(F.col("chunk_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")),
    )
    one = {r.chunk_id: r.score for r in score_chunks(docs, labels).collect()}
    two = {r.chunk_id: r.score for r in score_chunks(docs, swapped).collect()}
    assert one == two


def test_statistics(spark):
    df = spark.createDataFrame(
        [(1, "The gene The gene\nTHE!! a1\nThe gene The gene", 9.0), (2, None, 1.0), (3, "", 1.0), (4, "w " * 10**6, 1.0)],
        "chunk_id int, text string, score double",
    )
    got = {r.chunk_id: r for r in text_statistics(df).collect()}
    assert got[2][1:] == got[3][1:] and set(got[2].asDict()) == {"chunk_id", *STATISTICS}
    assert got[1].distinct_share == 4 / 10 and got[1].line_words == 10 / 3
    assert abs(got[1].line_repeat_share - 1 / 3) < 1e-12 and got[4].repeat_share > 0.99


def test_odd_labels_and_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (None, "c"), (1, "a b")], "chunk_id int, text string")
    none = spark.createDataFrame([], "chunk_id int, quality int")
    assert {r.score for r in score_chunks(df, none).collect()} == {0.5}
    odd = spark.createDataFrame([(3, 1), (3, 0), (None, 0), (6, None), (1, 1)], "chunk_id int, quality int")
    assert score_chunks(df, odd).count() == 4
    assert score_chunks(df.limit(0), odd).count() == 0
    carried = score_chunks(df.withColumn("label", F.lit("x")), none, carry=["label"])
    assert carried.first()["label"] == "x"


def test_rules_are_few_and_their_columns_score(spark):
    rows = [(float(i), *([0.0] * (len(STATISTICS) - 1)), int(i > 40)) for i in range(100)]
    df = spark.createDataFrame(rows, [*STATISTICS, "quality"])
    model = fit_rules(df)
    assert 0 < len(model.rules) < 30
    got = df.select("quality", model.score().alias("s")).collect()
    assert all((r.s >= 0.5) == (r.quality == 1) for r in got)
