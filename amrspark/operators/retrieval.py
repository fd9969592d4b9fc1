"""BM25 and hashed-vector retrieval with rank fusion.

Every ranking covers the whole corpus, documents without a match included. Queries are answered in
blocks of a bounded size: tasks score their documents against a whole block in arrays
(`operators/packed.py`) and return the best of each query, or counts of the documents between two
candidates, from which exact ranks follow. No (query, document) pair is shuffled or ranked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from amrspark import fixed
from amrspark.functions import text
from amrspark.operators import packed
from amrspark.session import cut

# Scores are compared at this many digits, so that the order of summation cannot reorder ties.
DIGITS = 9
#: Queries, and (query, word) pairs, that a block holds about.
BLOCK_QUERIES, BLOCK_WORDS = 1024, 1 << 18
#: One document of so many is scored first, for scores that the best of all reach for certain.
FIRST_IN = 16
#: Documents packed at a time.
_ROWS = 512


@dataclass
class Index:
    """A packed corpus, with the three numbers BM25 needs."""

    packed: DataFrame  # doc_id, dl, tokens, tf and, for vectors, buckets: one row per document
    frequencies: DataFrame  # token, df
    n: int
    avgdl: float
    average_idf: float

    @property
    def postings(self) -> DataFrame:
        """doc_id, token, tf, dl"""
        rows = self.packed.select("doc_id", "dl", F.inline(F.arrays_zip("tokens", "tf")))
        return rows.select("doc_id", F.col("tokens").alias("token"), "tf", "dl")


def term_counts(docs: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    rows = docs.select(key, text.tokens(body).alias("_t"))
    rows = rows.select(key, F.size("_t").alias("dl"), F.explode("_t").alias("token"))
    return rows.groupBy(key, "token").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def build_index(docs: DataFrame, *, vectors: bool = True) -> Index:
    """Index `docs` (doc_id unique, text), with word buckets for `vectors`.

    The documents are packed where they are and written once; only the words with their document
    counts are shuffled. A null text has no words.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    none = F.array().cast("array<string>")
    words = docs.select("doc_id", F.coalesce(text.tokens("text"), none).alias("words"))
    rows = words.mapInArrow(_packed, f"doc_id {kind}, dl long, tokens array<string>, tf array<long>")
    if vectors:
        rows = rows.withColumn("buckets", F.transform("tokens", lambda t: text.bucket(t)))
    rows = cut(rows)
    frequencies = cut(document_frequencies(rows.select(F.explode("tokens").alias("token"))))
    total = rows.agg(F.count("*").alias("n"), F.sum("dl").alias("length")).first()
    n = total["n"]
    idf = frequencies.agg(F.avg(_raw_idf(n)).alias("idf")).first()["idf"]
    return Index(rows, frequencies, n, (total["length"] or 0) / n if n else 0.0, idf or 0.0)


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most `_ROWS` documents: what a task holds besides its input does not grow."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each row to its distinct words and their counts."""
    for batch in _small(batches):
        words = batch.column("words")
        sizes = words.value_lengths().to_numpy()
        coded = words.flatten().dictionary_encode()
        most = max(1, len(coded.dictionary))
        row = np.repeat(np.arange(len(sizes)), sizes)
        both, counts = np.unique(row * most + coded.indices.to_numpy(), return_counts=True)
        ends = np.searchsorted(both // most, np.arange(len(sizes) + 1)).astype(np.int32)
        tokens = coded.dictionary.take(pa.array(both % most))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(sizes.astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(ends), tokens),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(counts.astype(np.int64))),
            ],
            ["doc_id", "dl", "tokens", "tf"],
        )


def document_frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("token").agg(F.count("*").alias("df"))


def _raw_idf(n: int):
    return F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def bm25_scores(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of matching pairs. A repeated query word counts repeatedly.

    Tasks score packed documents against blocks of queries and return the pairs; none is shuffled.
    """
    kind = index.packed.schema["doc_id"].dataType.simpleString()
    out = [
        index.packed.mapInArrow(packed.matches(block), f"query_id {_kind(block.ids)}, doc_id {kind}, score double")
        for block in _blocks(index, queries, nulls=True)
    ]
    if not out:
        query = queries.schema["query_id"].dataType.simpleString()
        return queries.sparkSession.createDataFrame([], f"query_id {query}, doc_id {kind}, score double")
    return reduce(DataFrame.unionAll, out)


def hashed_vectors(postings: DataFrame, key: str = "doc_id", dim: int = fixed.EMBED_DIM) -> DataFrame:
    """(key, bucket, weight): hashed word counts scaled to unit length, zeros absent.

    The norm is an aggregate joined back on the key; buckets of one key never exceed `dim`.
    """
    counts = postings.groupBy(key, text.bucket("token", dim).alias("bucket")).agg(
        F.sum("tf").alias("c")
    )
    packed = counts.groupBy(key).agg(
        F.collect_list(F.struct("bucket", "c")).alias("v"),
        F.sqrt(F.sum(F.col("c") * F.col("c")).cast("double")).alias("norm"),
    )
    rows = packed.select(key, "norm", F.inline("v"))
    return rows.select(key, "bucket", (F.col("c") / F.col("norm")).alias("weight"))


def text_vectors(docs: DataFrame, key: str = "doc_id", body: str = "text", dim: int = fixed.EMBED_DIM) -> DataFrame:
    """`hashed_vectors` of texts. Words are counted per bucket where the rows are; one row per text is
    shuffled, by `key`, so that the texts of a repeated key make one vector. They meet in one row, so
    no key may have very many texts (`hashed_vectors` of `term_counts` sums those)."""
    kind = docs.schema[key].dataType.simpleString()
    none = F.array().cast("array<string>")
    words = docs.select(F.col(key).alias("id"), F.coalesce(text.tokens(body), none).alias("words"))
    counts = words.mapInArrow(_counted(dim), f"id {kind}, bucket array<int>, c array<long>")
    both = [F.flatten(F.collect_list(c)).alias(c) for c in ("bucket", "c")]
    rows = counts.groupBy("id").agg(*both).mapInArrow(_unit(dim), f"id {kind}, bucket int, weight double")
    return rows.withColumnRenamed("id", key)


def _counted(dim: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            words = batch.column("words")
            coded = words.flatten().dictionary_encode()
            of_word = [int.from_bytes(hashlib.md5(w.encode()).digest()[:4]) % dim for w in coded.dictionary.to_pylist()]
            bucket = np.array(of_word, np.int64)[coded.indices.to_numpy()]
            row = np.repeat(np.arange(batch.num_rows), words.value_lengths().to_numpy())
            both, counts = np.unique(row * dim + bucket, return_counts=True)
            ends = pa.array(np.searchsorted(both // dim, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [(both % dim).astype(np.int32), counts.astype(np.int64)]
            columns = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in lists]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "bucket", "c"])

    return count


def _unit(dim: int):
    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            bucket, c = batch.column("bucket"), batch.column("c")
            row = np.repeat(np.arange(batch.num_rows), bucket.value_lengths().to_numpy())
            at, place = np.unique(row * dim + bucket.flatten().to_numpy(), return_inverse=True)
            sums = np.bincount(place, c.flatten().to_numpy(), len(at))
            norm = np.sqrt(np.bincount(at // dim, sums * sums, batch.num_rows))
            columns = [batch.column("id").take(pa.array(at // dim)), pa.array((at % dim).astype(np.int32)), pa.array(sums / norm[at // dim])]
            yield pa.RecordBatch.from_arrays(columns, ["id", "bucket", "weight"])

    return scale


def reach(legs: int, k: int, rrf_k: int) -> int:
    """A bound on the best rank of a fused top k, from k and the constants alone.

    The k documents ranked first in one leg each score at least 1 / (rrf_k + k). A document whose
    best rank over L legs is r scores at most L / (rrf_k + r), which is less once
    r > L * (rrf_k + k) - rrf_k. So a document beyond that rank in every leg is not in the top k.
    """
    return legs * (rrf_k + k) - rrf_k


def _blocks(index: Index, queries: DataFrame, *, nulls: bool = False) -> Iterator[packed.Block]:
    """The queries (query_id, text) in blocks, dealt by a hash. Null ids are left out, or one query.

    A block is all that the driver and a task hold of the queries at a time.
    """
    given = queries.select("query_id", "text").where(F.lit(nulls) | F.col("query_id").isNotNull())
    idf = _raw_idf(index.n)
    floor = F.lit(fixed.BM25_EPSILON * index.average_idf)
    asked = term_counts(given, "query_id").join(index.frequencies, "token", "left")
    weight = F.col("tf") * F.when(idf < 0, floor).otherwise(idf)
    ids = cut(given.select("query_id").distinct())
    asked = cut(asked.select("query_id", "token", "tf", weight.alias("weight"), text.bucket("token").alias("bucket")))
    count = max(-(-ids.count() // BLOCK_QUERIES), -(-asked.count() // BLOCK_WORDS))
    place = F.pmod(F.xxhash64("query_id"), F.lit(max(1, count)))
    for i in range(count):
        own = ids.where(place == i).toArrow().sort_by("query_id")["query_id"].combine_chunks()
        if len(own):
            yield _block(index, own, asked.where(place == i).toArrow())


def _block(index: Index, ids: pa.Array, asked: pa.Table) -> packed.Block:
    query = pc.index_in(asked["query_id"], value_set=ids).to_numpy()
    tf = asked["tf"].to_numpy().astype(float)
    vectors = np.zeros((len(ids), fixed.EMBED_DIM))
    np.add.at(vectors, (query, asked["bucket"].to_numpy()), tf)
    norm = np.sqrt((vectors * vectors).sum(axis=1))
    vectors /= np.where(norm > 0, norm, 1.0)[:, None]
    known = np.flatnonzero(asked["weight"].is_valid().to_numpy())
    coded = asked["token"].take(pa.array(known)).combine_chunks().dictionary_encode()
    word = coded.indices.to_numpy()
    order = np.argsort(word, kind="stable")
    weight = asked["weight"].take(pa.array(known)).to_numpy()
    return packed.Block(
        ids, coded.dictionary, word[order], query[known][order], weight[order], vectors,
        fixed.BM25_K1, fixed.BM25_B, index.avgdl, 10.0**DIGITS,
    )


def _found(index: Index, docs: DataFrame, block: packed.Block, legs, limit: int, least=None) -> DataFrame:
    """(query_id, leg, doc_id, s0, ...): the best `limit` of each task, and rows of leg -1 that count pairs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    scores = ", ".join(f"s{i} long" for i in range(len(legs)))
    return docs.mapInArrow(
        packed.best(block, legs, limit, least), f"query_id {_kind(block.ids)}, leg int, doc_id {kind}, {scores}"
    )


def _kind(ids: pa.Array) -> str:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(ids.type).simpleString()


def _best(found: DataFrame, legs, limit: int) -> DataFrame:
    """The rows of the best `limit` of each leg, with `_at`, their place in it."""
    own = F.element_at(F.array(*[f"s{i}" for i in range(len(legs))]), F.col("leg") + 1)
    order = Window.partitionBy("leg", "query_id").orderBy(own.desc(), "doc_id")
    rows = found.where("leg >= 0").withColumn("_at", F.row_number().over(order))
    return rows.where(F.col("_at") <= limit)


def _top(index: Index, block: packed.Block, legs, limit: int) -> DataFrame:
    least = None
    if legs == ("bm25",):
        # What some documents reach, the best of all reach too.
        some = index.packed.where(F.pmod(F.xxhash64("doc_id"), F.lit(FIRST_IN)) == 0)
        last = _best(_found(index, some, block, legs, limit), legs, limit).where(F.col("_at") == limit)
        reached = last.select("query_id", "s0").toArrow()
        least = np.full(len(block.ids), np.iinfo(np.int64).min)
        least[pc.index_in(reached["query_id"], value_set=block.ids).to_numpy()] = reached["s0"].to_numpy()
    return _found(index, index.packed, block, legs, limit, least)


def _ranks(index: Index, block: packed.Block, legs, rows: DataFrame) -> DataFrame:
    """Exact ranks over the whole corpus of the candidates `rows` (query_id, doc_id, s0, ...).

    The candidates of a block, at most `reach` a query and leg, go to the tasks in the order of
    each leg. A task places its documents between them and counts; the sum of the counts up to a
    candidate is the number of documents ahead of it.
    """
    table = rows.toArrow()
    table = table.append_column("q", pc.index_in(table["query_id"], value_set=block.ids))
    ordered = []
    for i in range(len(legs)):
        own = table.sort_by([("q", "ascending"), (f"s{i}", "descending"), ("doc_id", "ascending")])
        first = np.searchsorted(own["q"].to_numpy(), np.arange(len(block.ids) + 1))
        ordered.append(packed.Candidates(first, own[f"s{i}"].to_numpy(), own["doc_id"].combine_chunks()))
    counted = index.packed.mapInArrow(
        packed.ahead(block, legs, ordered), f"query_id {_kind(block.ids)}, leg int, j int, n long"
    )
    counted = counted.groupBy("query_id", "leg", "j").agg(F.sum("n").alias("n"))
    for i in range(len(legs)):
        order = Window.partitionBy("query_id").orderBy(F.col(f"s{i}").desc(), "doc_id")
        own = counted.where(F.col("leg") == i).select("query_id", "j", "n")
        rows = rows.withColumn("j", F.row_number().over(order) - 1).join(own, ["query_id", "j"], "left")
        before = F.sum(F.coalesce("n", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn(f"r{i}", before + 1).drop("j", "n")
    return rows


def retrieve(
    index: Index, queries: DataFrame, k: int = 5, *, lexical: bool = True, dense: bool = True, rrf_k: int = fixed.RRF_K
) -> DataFrame:
    """Top k documents per query (query_id, text) by the sum of 1 / (rrf_k + rank) over the legs.

    Returns query_id, doc_id, score (at 12 digits), rank; ties by id. Jobs run when this is called,
    block by block. One leg: its best k are the result, and BM25 leaves out pairs that cannot be
    among them. Two legs: only documents within `reach` of some leg are candidates, and only their
    exact ranks are counted, in a second pass.
    """
    legs = tuple(leg for leg, wanted in zip(packed.LEGS, (lexical, dense), strict=True) if wanted)
    limit = k if len(legs) == 1 else reach(len(legs), k, rrf_k)
    out = []
    for block in _blocks(index, queries):
        near = _best(_top(index, block, legs, limit), legs, limit)
        if len(legs) == 1:
            ranks = near.withColumn("r0", F.col("_at"))
        else:
            scores = [f"s{i}" for i in range(len(legs))]
            ranks = _ranks(index, block, legs, cut(near.select("query_id", "doc_id", *scores).distinct()))
        score = reduce(lambda a, b: a + b, [1.0 / (F.lit(float(rrf_k)) + F.col(f"r{i}")) for i in range(len(legs))])
        out.append(cut(top_k(ranks.select("query_id", "doc_id", F.round(score, 12).alias("score")), k)))
    if not out:
        ids = f"{queries.schema['query_id'].dataType.simpleString()}", index.packed.schema["doc_id"].dataType.simpleString()
        return queries.sparkSession.createDataFrame([], f"query_id {ids[0]}, doc_id {ids[1]}, score double, rank int")
    return reduce(DataFrame.unionAll, out)


def scored_pairs(index: Index, queries: DataFrame, k: int = 5) -> tuple[int, int]:
    """All (query, document) pairs, and those that BM25 scores in full for the top k of each query."""
    pairs = scored = 0
    for block in _blocks(index, queries):
        found = _top(index, block, ("bm25",), k)
        pairs += index.n * len(block.ids)
        scored += found.where("leg < 0").agg(F.sum("s0")).first()[0] or 0
    return pairs, scored


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """Best k per query. The rank filter is applied before the shuffle as well as after it."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id").asc())
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def evidence_for_genes(rows: DataFrame, chunks: DataFrame, k: int = 5, *, dense: bool = False) -> DataFrame:
    """Cited chunks per report row (genome_id, antibiotic, supporting_features).

    The query is the drug followed by its genes. Equal queries are answered once.
    """
    asked = rows.select(
        "genome_id",
        "antibiotic",
        F.trim(F.concat_ws(" ", "antibiotic", "supporting_features")).alias("text"),
    ).where(F.col("text") != "")
    asked = asked.withColumn("query_id", F.md5("text"))
    queries = cut(asked.select("query_id", "text").distinct())
    corpus = chunks.select(
        F.col("chunk_id").alias("doc_id"), F.concat_ws(" ", "gene_family", "text").alias("text")
    )
    found = retrieve(build_index(corpus, vectors=dense), queries, k, dense=dense)
    hits = asked.select("genome_id", "antibiotic", "query_id").join(found, "query_id")
    return hits.select(
        "genome_id", "antibiotic", F.col("doc_id").alias("chunk_id"), "score", "rank"
    )
