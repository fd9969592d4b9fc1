"""Knowledge chunks that repeat passages of held-out narratives."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amrspark.llm.store import store
from amrspark.llm.words import WORD, WordHashes, plain_words, rolling

WINDOW = 13
SLICE_WORDS = 200_000
_TABLE_BITS = 22


def scan_chunks(
    chunks: DataFrame,
    narratives: DataFrame,
    *,
    window: int = WINDOW,
    slice_words: int = SLICE_WORDS,
    share: int = 20,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Find narrative passages in chunk texts.

    Parameters
    ----------
    chunks: chunk_id, text; any further columns are ignored.
    narratives: genome_id, summary: the texts a model is tested on.
    window: words in a window. A narrative of fewer words, but not none, is one window.
    slice_words: narrative words broadcast at once. More narratives are scanned slice by slice,
        so what is broadcast never grows beyond it (but for one single longer narrative).
    carry: further columns of chunks to hand through.
    share: a chunk is contaminated if `share` times its hit words reach its words.

    Returns one row per chunk row: chunk_id, text, n_words, n_hit (words inside a window that
    occurs in a narrative), genomes (ids as sorted strings of the narratives with such windows),
    hits (start and end of each run of hit words, by word, end exclusive), contaminated.

    Null and empty texts have no words and no hits. Repeated rows are judged each. A null
    genome_id counts as the text `null`. Without narratives nothing is hit.
    """
    own = ["chunk_id", *carry, "text"]
    rows = chunks.select(*own).withColumns({
        "n_words": F.lit(0).cast("long"),
        "n_hit": F.lit(0).cast("long"),
        "genomes": F.array().cast("array<string>"),
        "hits": F.array().cast("array<int>"),
    })
    tests = narratives.select(
        F.coalesce(F.col("genome_id").cast("string"), F.lit("null")).alias("genome_id"), "summary"
    )
    size = F.ceil(F.length(F.coalesce("summary", F.lit(""))) / 2) + 1
    slices = -(-(tests.agg(F.sum(size)).first()[0] or 1) // slice_words)
    for k in range(slices):
        mine = tests.where(F.pmod(F.xxhash64("genome_id", "summary"), F.lit(slices)) == k)
        windows = _windows(mine.toArrow(), window)
        handle = chunks.sparkSession.sparkContext.broadcast(windows)
        rows = rows.mapInArrow(_scanner(handle, own), rows.schema)
        if k + 1 < slices:
            rows = store(rows, "scanned")
    told = (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
    return rows.withColumn("contaminated", told)


def _windows(tests: pa.Table, window: int) -> dict[int, tuple[np.ndarray, dict]]:
    """By window length: a table of hash bits to pre-test with, and the genomes of each window."""
    found: dict[int, dict[bytes, list[str]]] = {}
    for genome, text in zip(
        tests["genome_id"].to_pylist(), tests["summary"].cast(pa.binary()).to_pylist(), strict=True
    ):
        words = plain_words(text)
        n = min(window, len(words))
        for at in range(len(words) - n + 1 if n else 0):
            known = found.setdefault(n, {}).setdefault(b" ".join(words[at : at + n]), [])
            if not known or known[-1] != genome:
                known.append(genome)
    hashes = WordHashes()
    out = {}
    for n, by_text in found.items():
        table = np.zeros(1 << _TABLE_BITS, bool)
        for text in by_text:
            table[rolling(hashes.of(text.split()), n) & np.uint64(len(table) - 1)] = True
        out[n] = (table, by_text)
    return out


def _scanner(handle, own: list[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, hashes = handle.value, WordHashes()
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            before = batch.column("genomes").to_pylist()
            runs = batch.column("hits").to_pylist()
            n_words, n_hit, genomes, hits = [], [], [], []
            for text, known, old in zip(texts, before, runs, strict=True):
                words = plain_words(text)
                edges = np.zeros(len(words) + 1, np.int32)
                for start, end in zip(old[::2], old[1::2], strict=True):
                    edges[start] += 1
                    edges[end] -= 1
                found = set(known)
                values = hashes.of(words)
                for n, (table, by_text) in windows.items():
                    likely = table[rolling(values, n) & np.uint64(len(table) - 1)]
                    for at in np.flatnonzero(likely).tolist():
                        ids = by_text.get(b" ".join(words[at : at + n]))
                        if ids:
                            found.update(ids)
                            edges[at] += 1
                            edges[at + n] -= 1
                inside = np.cumsum(edges) > 0
                n_words.append(len(words))
                n_hit.append(int(inside.sum()))
                genomes.append(sorted(found))
                hits.append(np.flatnonzero(np.diff(inside, prepend=False)).astype(np.int32).tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(name) for name in own),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array(genomes, pa.list_(pa.string())),
                    pa.array(hits, pa.list_(pa.int32())),
                ],
                [*own, "n_words", "n_hit", "genomes", "hits"],
            )

    return scan


def cut_spans(scanned: DataFrame) -> DataFrame:
    """`scanned` with a column clean_text: the text without its hit passages, null as it was.

    From the first to the last word of a run of hit words all characters go.
    """

    def cut(texts, hits):
        import pandas as pd

        out = []
        for text, runs in zip(texts, hits, strict=True):
            if text is not None and len(runs):
                at = [m.span() for m in WORD.finditer(text.lower() if text.isascii() else _lower(text))]
                for start, end in reversed(list(zip(runs[::2], runs[1::2], strict=True))):
                    text = text[: at[start][0]] + text[at[end - 1][1] :]
            out.append(text)
        return pd.Series(out, dtype=object)

    clean = F.pandas_udf(cut, "string")
    hit = F.size("hits") > 0
    return scanned.withColumn("clean_text", F.when(hit, clean("text", "hits")).otherwise(F.col("text")))


def _lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})
