"""Quality of knowledge chunks by a sparse ensemble of rules over text statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from amrspark.llm.store import store
from amrspark.llm.words import spaced_words

MAX_TRAIN_ROWS, TREES, DEPTH, LASSO = 20_000, 30, 3, 0.001

STATISTICS = (
    "log_words", "word_length", "longest_word", "distinct_share", "repeat_share", "short_share",
    "upper_share", "digit_share", "symbol_share", "stop_share", "line_words", "line_repeat_share",
)
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_STOP = b".,;:?"
_SYMBOL = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _STOP)


def text_statistics(chunks: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """chunk_id, the carried columns and STATISTICS of each row's whole text; null is empty.

    Shares are of characters (upper_share, digit_share, symbol_share, stop_share, in bytes), of
    words (distinct_share, repeat_share: equal to the word before, short_share: up to three
    bytes) or of lines (line_repeat_share).
    """
    own = ["chunk_id", *carry]
    given = chunks.select(*own, "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_numbers(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            table = np.array(rows, float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in own), *(pa.array(c) for c in table.T)], [*own, *STATISTICS]
            )

    fields = [*given.drop("text").schema, *(StructField(name, DoubleType()) for name in STATISTICS)]
    return given.mapInArrow(measure, StructType(fields))


def _numbers(text: bytes) -> tuple[float, ...]:
    size = max(1, len(text))
    words = spaced_words(text)
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = text.split(b"\n")
    share = [1 - len(text.translate(None, kind)) / size for kind in (_UPPER, _DIGIT, _SYMBOL, _STOP)]
    if not text:
        share = [0.0] * 4
    return (
        float(np.log1p(len(words))),
        float(lengths.sum()) / n,
        float(lengths.max(initial=0)),
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        float((lengths <= 3).sum()) / n,
        *share,
        n / len(lines),
        1 - len(set(lines)) / len(lines),
    )


@dataclass
class RuleEnsemble:
    """A logistic model over conjunctive rules: (statistic, is above, threshold) conditions."""

    intercept: float
    rules: list[tuple[float, list[tuple[str, bool, float]]]] = field(default_factory=list)

    def score(self) -> Column:
        """The probability of quality 1, as an expression over the columns of STATISTICS."""
        total = F.lit(float(self.intercept))
        for weight, conditions in self.rules:
            total = total + F.when(_holds(conditions), float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _holds(conditions: list[tuple[str, bool, float]]) -> Column:
    tests = [(F.col(n) > t) if above else (F.col(n) <= t) for n, above, t in conditions]
    return reduce(lambda a, b: a & b, tests)


def fit_rules(
    measured: DataFrame, *, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = 7
) -> RuleEnsemble:
    """Fit rules on rows of STATISTICS and quality (0 or 1).

    Every path from a root to a node of a random forest is a rule; a logistic regression with an
    L1 penalty over the rules' truth values leaves few with a weight. Without rows the score is
    0.5, with a single class it is that class's smoothed share.
    """
    rows = store(measured.select(*STATISTICS, F.col("quality").cast("double").alias("label")), "train")
    n, good = rows.agg(F.count("*"), F.sum("label")).first()
    good = good or 0.0
    if n == 0 or good in (0, n):
        p = (good + 1) / (n + 2)
        return RuleEnsemble(float(np.log(p / (1 - p))))
    put = VectorAssembler(inputCols=list(STATISTICS), outputCol="features")
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, minInstancesPerNode=5, featureSubsetStrategy="onethird",
        seed=seed,
    ).fit(put.transform(rows))
    paths = sorted({tuple(p) for tree in forest.trees for p in _paths(tree._call_java("rootNode"), [])})
    rules = [[(STATISTICS[i], above, t) for i, above, t in path] for path in paths]
    if not rules:
        return RuleEnsemble(float(np.log(good / (n - good))))
    truth = rows.select(
        "label", F.array(*[F.when(_holds(r), 1.0).otherwise(0.0) for r in rules]).alias("r")
    )
    from pyspark.ml.functions import array_to_vector

    table = store(truth, "rule-values").select("label", array_to_vector("r").alias("features"))
    model = LogisticRegression(
        elasticNetParam=1.0, regParam=lasso, standardization=False, maxIter=100, tol=1e-6
    ).fit(table)
    weights = model.coefficients.toArray()
    return RuleEnsemble(
        float(model.intercept),
        [(float(w), r) for w, r in zip(weights, rules, strict=True) if w != 0],
    )


def _paths(node, above: list) -> Iterator[list]:
    if above:
        yield above
    if node.getClass().getSimpleName() == "InternalNode":
        split = node.split()
        i, t = split.featureIndex(), split.threshold()
        yield from _paths(node.leftChild(), [*above, (i, False, t)])
        yield from _paths(node.rightChild(), [*above, (i, True, t)])


def held_out(chunk_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Rows whose labels are never learnt from; a null id counts as empty text."""
    return F.crc32(F.coalesce(chunk_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def score_chunks(
    chunks: DataFrame,
    labels: DataFrame,
    *,
    max_train_rows: int = MAX_TRAIN_ROWS,
    carry: Sequence[str] = (),
    seed: int = 7,
) -> DataFrame:
    """Score every chunk's whole text for quality.

    Parameters
    ----------
    chunks: chunk_id, text; others are ignored, and no id enters a score.
    labels: chunk_id, quality (0 or 1). A chunk with several labels takes the majority, a tie is
        1; null labels and ids and labels of unknown chunks have no effect.
    max_train_rows: about so many labelled rows outside the held-out fold are learnt from, taken
        by a hash of their id; only their ids are broadcast, so this bounds the broadcast.
    carry: further columns of chunks to hand through; no score reads them.

    Returns one row per chunk row: chunk_id, held_out, score (0 to 1), predicted (1 from 0.5 on),
    then the statistics the rules read. Null and empty texts are scored from their zeros. Empty
    tables give no rows, and without labels every score is 0.5.
    """
    told = (
        labels.where(F.col("chunk_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("chunk_id")
        .agg(F.avg("quality").alias("q"))
        .select("chunk_id", (F.col("q") >= 0.5).cast("int").alias("quality"))
        .where(~held_out(F.col("chunk_id")))
    )
    told = store(told, "labels")
    share = min(1.0, max_train_rows / max(1, told.count()))
    taken = told.where(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    known = chunks.select("chunk_id", "text").join(F.broadcast(taken.select("chunk_id")), "chunk_id", "left_semi")
    train = text_statistics(known).join(F.broadcast(taken), "chunk_id")
    model = fit_rules(train, seed=seed)
    scored = text_statistics(chunks, carry).withColumn("score", model.score())
    return scored.select(
        "chunk_id", *carry, held_out(F.col("chunk_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), *STATISTICS,
    )
