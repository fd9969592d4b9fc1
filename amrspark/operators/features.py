"""Annotation hits to per-genome calls, vocabulary, numeric matrix and mechanism hits."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amrspark import fixed
from amrspark.functions import mechanisms
from amrspark.functions.text import clean
from amrspark.operators.labels import first_per_key
from amrspark.operators.ranking import numbered, streamed_digest
from amrspark.session import cut

#: Names that a model may have a weight for.
MAX_FEATURES = 1 << 16


def catalog_lookups(catalog: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(by allele, by family) from catalog rows that have class and subclass; first row wins."""
    rows = catalog.where(clean("class").isNotNull() & clean("subclass").isNotNull())

    def by(column: str) -> DataFrame:
        named = rows.where(clean(column).isNotNull())
        named = named.select(F.col(column).alias("key"), "class", "subclass", *order)
        return first_per_key(named, ["key"], order).select("key", "class", "subclass")

    return by("allele"), by("gene_family")


def fill_from_catalog(hits: DataFrame, by_allele: DataFrame, by_family: DataFrame) -> DataFrame:
    """Fill a missing class or subclass: the allele's pair if there is one, else the family's."""

    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(
            F.col("key").alias("gene_symbol"),
            F.struct("class", "subclass").alias(p),
        )

    pair = F.coalesce("_a", "_f")
    return (
        hits.join(side(by_allele, "_a"), "gene_symbol", "left")
        .join(side(by_family, "_f"), "gene_symbol", "left")
        .withColumn("drug_class", F.coalesce("drug_class", pair["class"]))
        .withColumn("drug_subclass", F.coalesce("drug_subclass", pair["subclass"]))
        .select(*hits.columns)
    )


def gene_calls(hits: DataFrame, order: str = "row_ord") -> DataFrame:
    """One row per (genome, symbol). "First" values follow the row order inside the genome.

    Resistance-gene and point-mutation facts share one aggregation; other subtypes give no row.
    """
    amr = F.col("element_subtype") == "AMR"
    point = F.col("element_subtype").isin("POINT", "POINT_DISRUPT")
    has_class = amr & F.col("drug_class").isNotNull()
    has_both = has_class & F.col("drug_subclass").isNotNull()

    def first(column: str, condition):
        return F.min_by(column, F.when(condition, F.col(order)))

    return (
        hits.where(amr | point)
        .groupBy("genome_id", F.col("gene_symbol").alias("gene"))
        .agg(
            F.bool_or(amr).alias("is_amr"),
            F.bool_or(point).alias("is_point"),
            F.bool_or(F.col("element_subtype") == "POINT_DISRUPT").alias("is_disrupt"),
            F.count_if(amr).alias("hit_count"),
            first("method", amr).alias("method"),
            first("drug_class", has_class).alias("drug_class"),
            first("drug_subclass", has_both).alias("drug_subclass"),
            F.bool_or(amr & F.col("method").isin(*fixed.PARTIAL_END_METHODS)).alias("partial_end"),
            F.bool_or(amr & F.col("drug_class").isNull()).alias("unmapped"),
        )
    )


def feature_vectors(
    calls: DataFrame, genomes: DataFrame, db_version: str, schema_version: str = fixed.SCHEMA_VERSION
) -> DataFrame:
    """One nested row per genome; a genome without any call keeps an empty row.

    Calls are unique per (genome, symbol), so a row is bounded by the vocabulary.
    """
    yes = F.lit(True)

    def table(condition, value):
        entry = F.when(condition, F.struct("gene", value.alias("v")))
        return F.map_from_entries(F.array_sort(F.collect_list(entry)))

    def names(condition):
        return F.array_sort(F.collect_list(F.when(condition, F.col("gene"))))

    amr = F.col("is_amr")
    packed = calls.groupBy("genome_id").agg(
        table(amr, yes).alias("gene_presence"),
        table(amr, F.col("method")).alias("gene_presence_method"),
        table(amr, F.col("hit_count")).alias("gene_hit_count"),
        table(F.col("drug_class").isNotNull(), F.col("drug_class")).alias("gene_drug_class"),
        table(F.col("drug_subclass").isNotNull(), F.col("drug_subclass")).alias(
            "gene_drug_subclass"
        ),
        table(F.col("is_point"), yes).alias("point_mutations"),
        table(F.col("is_disrupt"), yes).alias("point_mutation_disrupt"),
        names(F.col("partial_end")).alias("partial_contig_end_genes"),
        names(F.col("unmapped")).alias("unmapped_class_genes"),
    )
    kinds = dict(packed.dtypes)
    empty = {
        c: F.coalesce(F.col(c), (F.create_map() if kinds[c].startswith("map") else F.array()).cast(kinds[c]))
        for c in packed.columns[1:]
    }
    joined = genomes.select("genome_id").distinct().join(packed, "genome_id", "left")
    return joined.withColumns(
        {**empty, "schema_version": F.lit(schema_version), "db_version": F.lit(db_version)}
    )


def vocabulary(calls: DataFrame) -> DataFrame:
    """The feature table: idx (from 0), feature, kind. Genes by name, then mutations that are no
    gene name, then the engineered columns.

    Names are numbered in ranges over many tasks; the table is written once.
    """
    names = calls.select(
        F.col("gene").alias("feature"), F.when(F.col("is_amr"), 0).when(F.col("is_point"), 1).alias("_k")
    )
    # A name that is both is a gene.
    kinds = names.where(F.col("_k").isNotNull() & F.col("feature").isNotNull()).groupBy("feature").agg(F.min("_k").alias("_k"))
    engineered = F.array(*[F.struct(F.lit(i + 2).alias("_k"), F.lit(n).alias("feature")) for i, n in enumerate(fixed.ENGINEERED)])
    spark = calls.sparkSession
    own = spark.range(1).select(F.inline(engineered))
    placed = numbered(kinds.select("_k", "feature").unionByName(own), [], ["_k", "feature"], "_at")
    kind = F.when(F.col("_k") == 0, "gene").when(F.col("_k") == 1, "mutation").otherwise("engineered")
    return cut(placed.select((F.col("_at") - 1).cast("int").alias("idx"), "feature", kind.alias("kind")))


def vocabulary_digest(vocab: DataFrame) -> DataFrame:
    """One row: n_features, SHA-256 of the names in order joined by line breaks, and the versions."""
    found = streamed_digest(vocab, "feature", ["idx"])
    return found.select(
        F.col("n").alias("n_features"), "sha256",
        F.lit(fixed.SCHEMA_VERSION).alias("schema_version"), F.lit(fixed.ENGINEERED_VERSION).alias("engineered_version"),
    )


def feature_names(vocab: DataFrame, most: int = MAX_FEATURES) -> list[str]:
    """The names in order, for models, which hold a weight per name; at most `most` of them."""
    n = vocab.count()
    if n > most:
        raise ValueError(f"{n} features; at most {most} fit a model")
    return [r["feature"] for r in vocab.orderBy("idx").collect()]


def engineered(calls: DataFrame, genomes: DataFrame) -> DataFrame:
    """Combination columns per genome; zero where nothing was called."""
    f = mechanisms.flags()
    sources = dict(
        zip(
            fixed.ENGINEERED[1:],
            ("pmqr", "rmtase", "ame", "carbapenemase", "esbl_ampc", "sul", "dfr", "porin"),
        )
    )
    per = calls.groupBy("genome_id").agg(
        F.count_if(f["qrdr"]).cast("double").alias(fixed.ENGINEERED[0]),
        *[F.max(f[s].cast("double")).alias(n) for n, s in sources.items()],
    )
    joined = genomes.select("genome_id").distinct().join(per, "genome_id", "left")
    return joined.fillna(0.0, list(fixed.ENGINEERED))


def engineered_rows(wide: DataFrame) -> DataFrame:
    """(genome, feature, value) of the nonzero engineered columns."""
    pairs = F.array(
        *[F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").alias("value")) for n in fixed.ENGINEERED]
    )
    return wide.select("genome_id", F.inline(F.filter(pairs, lambda p: p["value"] != 0)))


def matrix_rows(calls: DataFrame, wide: DataFrame, vocab: DataFrame) -> DataFrame:
    """Sparse matrix as rows (genome, feature, idx, value); zeros and unknown symbols are absent."""
    present = calls.where(F.col("is_amr") | F.col("is_point")).select(
        "genome_id", F.col("gene").alias("feature"), F.lit(1.0).alias("value")
    )
    names = vocab.select("feature", "idx")
    return present.unionByName(engineered_rows(wide)).join(names, "feature")


def unknown_counts(calls: DataFrame, genomes: DataFrame, vocab: DataFrame) -> DataFrame:
    """Out-of-vocabulary symbols per genome; a symbol that is gene and mutation counts twice."""
    known = vocab.select(F.col("feature").alias("gene"))
    twice = F.col("is_amr").cast("bigint") + F.col("is_point").cast("bigint")
    out = calls.join(known, "gene", "left_anti").groupBy("genome_id").agg(F.sum(twice).alias("oov"))
    return genomes.select("genome_id").distinct().join(out, "genome_id", "left").fillna(0, ["oov"])


def matrix_vectors(calls: DataFrame, wide: DataFrame, names: list[str], out: str = "features") -> DataFrame:
    """One sparse ML vector per genome in vocabulary order (`names` is the frozen vocabulary)."""
    symbols = [n for n in names if not n.startswith("eng:")]
    model = CountVectorizerModel.from_vocabulary(symbols, "symbols", "presence")
    model.setBinary(True)
    lists = calls.where(F.col("is_amr") | F.col("is_point")).groupBy("genome_id").agg(
        F.collect_list("gene").alias("symbols")
    )
    rows = wide.join(lists, "genome_id", "left").withColumn(
        "symbols", F.coalesce("symbols", F.array().cast("array<string>"))
    )
    plain = {n: n.replace("eng:", "eng_") for n in fixed.ENGINEERED}
    rows = model.transform(rows).withColumnsRenamed(plain)
    assembler = VectorAssembler(inputCols=["presence", *plain.values()], outputCol=out)
    return assembler.transform(rows).select("genome_id", out)


MECHANISMS = (
    "carbapenemase", "esbl_ampc", "cephalosporin", "rmtase", "ame", "pmqr", "sul", "dfr", "qrdr",
    "porin",
)


def mechanism_hits(calls: DataFrame, genomes: DataFrame) -> DataFrame:
    """Per genome and mechanism the sorted hits as (gene, subclass, is_amr)."""
    f = mechanisms.flags()
    item = F.struct("gene", "drug_subclass", "is_amr")
    any_flag = F.greatest(*[x.cast("int") for x in f.values()]) == 1
    per = (
        calls.where(any_flag)
        .groupBy("genome_id")
        .agg(
            *[
                F.array_sort(F.collect_list(F.when(f[m], item))).alias(m)
                for m in MECHANISMS
            ]
        )
    )
    kinds = dict(per.dtypes)
    joined = genomes.select("genome_id").distinct().join(per, "genome_id", "left")
    return joined.withColumns(
        {m: F.coalesce(F.col(m), F.array().cast(kinds[m])) for m in MECHANISMS}
    )
