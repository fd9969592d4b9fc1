"""Scores of packed documents against a block of queries, inside Spark tasks.

A document is one row with its distinct words and their counts; a block holds a bounded number of
queries. A task scores its documents against the whole block in arrays and returns only the best of
each query, or counts: no (query, document) pair becomes a row, so nothing is shuffled by word or
bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: (document, query) pairs scored at a time.
_PAIRS = 1 << 19
_NONE = np.iinfo(np.int64).min
LEGS = ("bm25", "dense")


@dataclass
class Block:
    """Some queries: their ids, words with weights, and bucket vectors."""

    ids: pa.Array
    words: pa.Array  # distinct words of the block
    word: np.ndarray  # per entry, by rising word: the number of its word,
    query: np.ndarray  # of its query,
    weight: np.ndarray  # and its weight
    vectors: np.ndarray  # (queries, buckets), of unit length or zero
    k1: float
    b: float
    avgdl: float
    scale: float  # scores are compared as whole multiples of 1 / scale

    def __post_init__(self):
        """Split each query's entries: `light` ones sum to a twentieth of its weights at most."""
        order = np.lexsort((np.abs(self.weight), self.query))
        running = np.cumsum(np.abs(self.weight)[order])
        total = np.bincount(self.query, np.abs(self.weight), len(self.ids))
        before = np.concatenate(([0.0], np.cumsum(total)))[:-1]
        self.light = np.zeros(len(order), bool)
        self.light[order] = running - before[self.query[order]] <= 0.05 * total[self.query[order]]

    def entries(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query and weight of the chosen entries by word, and where each word's begin."""
        first = np.searchsorted(self.word[of], np.arange(len(self.words) + 1))
        return self.query[of], self.weight[of], first


class Documents:
    """A slice of packed documents, in ascending order of id."""

    def __init__(self, table: pa.Table, block: Block):
        self.ids = table["doc_id"].combine_chunks()
        tokens, tf = table["tokens"].combine_chunks(), table["tf"].combine_chunks()
        sizes = np.diff(tokens.offsets.to_numpy())
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        self.tf = tf.flatten().to_numpy().astype(float)
        self.length = table["dl"].to_numpy().astype(float)
        found = pc.index_in(tokens.flatten(), value_set=block.words).fill_null(-1).to_numpy()
        known = found >= 0
        self.at, self.word, tf_known = self.row[known], found[known], self.tf[known]
        norm = block.k1 * (1 - block.b + block.b * self.length / block.avgdl) if block.avgdl else self.length
        self.saturation = tf_known * (block.k1 + 1) / (tf_known + norm[self.at])
        self.buckets = table["buckets"].combine_chunks().flatten().to_numpy() if "buckets" in table.column_names else None

    def __len__(self):
        return len(self.ids)


def _summed(docs: Documents, block: Block, of: np.ndarray) -> np.ndarray:
    """(documents, queries): weights of the chosen entries times saturation, summed."""
    query, weight, first = block.entries(of)
    counts = (first[1:] - first[:-1])[docs.word]
    posting = np.repeat(np.arange(len(docs.word)), counts)
    entry = np.arange(len(posting)) - np.repeat(np.cumsum(counts) - counts, counts) + first[docs.word[posting]]
    n = len(block.ids)
    value = docs.saturation[posting] * weight[entry]
    return np.bincount(docs.at[posting] * n + query[entry], value, len(docs) * n).reshape(len(docs), n)


def _code(scores: np.ndarray, scale: float) -> np.ndarray:
    return np.rint(scores * scale).astype(np.int64)


def bm25(docs: Documents, block: Block, least: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """Scores of all pairs, and how many were summed in full.

    With `least`, pairs that cannot reach their query's are left at the smallest number: the words
    of a query that weigh most are summed first, and to these the largest weights that its other
    words have in this slice are added. Only pairs whose bound is enough get their other words.
    """
    if least is None:
        return _code(_summed(docs, block, np.ones(len(block.word), bool)), block.scale), len(docs) * len(block.ids)
    sums = _summed(docs, block, ~block.light)
    query, weight, first = block.entries(block.light)
    most = np.zeros(len(block.words))
    np.maximum.at(most, docs.word, docs.saturation)
    word = np.repeat(np.arange(len(block.words)), first[1:] - first[:-1])
    rest = np.bincount(query, np.maximum(0.0, weight) * most[word], len(block.ids))
    row, asked = np.nonzero(_code(sums + rest, block.scale) + 1 >= least)
    out = np.full(sums.shape, _NONE)
    if 4 * len(row) > sums.size:
        sums += _summed(docs, block, block.light)
        out[row, asked] = _code(sums[row, asked], block.scale)
    else:
        # Few pairs: the light words of their documents and queries, side by side.
        light = np.unique(word)
        place = np.full(len(block.words) + 1, -1)
        place[light] = np.arange(len(light))
        mine = place[docs.word] >= 0
        held = np.zeros((len(docs), len(light)))
        held[docs.at[mine], place[docs.word[mine]]] = docs.saturation[mine]
        wanted = np.zeros((len(block.ids), len(light)))
        wanted[query, place[word]] = weight
        step = max(1, _PAIRS // max(1, len(light)))
        for a in range(0, len(row), step):
            r, q = row[a : a + step], asked[a : a + step]
            added = (held[r] * wanted[q]).sum(axis=1)
            out[r, q] = _code(sums[r, q] + added, block.scale)
    return out, len(row)


def dense(docs: Documents, block: Block) -> np.ndarray:
    """Cosines of hashed word counts."""
    dim = block.vectors.shape[1]
    counts = np.bincount(docs.row * dim + docs.buckets, docs.tf, len(docs) * dim).reshape(len(docs), dim)
    norm = np.sqrt((counts * counts).sum(axis=1))
    return _code((counts / np.where(norm > 0, norm, 1.0)[:, None]) @ block.vectors.T, block.scale)


def _slices(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[Documents]:
    step = max(1, _PAIRS // max(1, len(block.ids)))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield Documents(pa.Table.from_batches([batch.slice(at, step)]).sort_by("doc_id"), block)


def matches(block: Block):
    """All pairs whose BM25 score is not zero."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in _slices(batches, block):
            scores = bm25(docs, block)[0]
            row, query = np.nonzero(scores)
            yield pa.RecordBatch.from_pydict(
                {
                    "query_id": block.ids.take(pa.array(query)),
                    "doc_id": docs.ids.take(pa.array(row)),
                    "score": pa.array(scores[row, query] / block.scale),
                }
            )

    return score


def best(block: Block, legs: tuple[str, ...], limit: int, least: np.ndarray | None = None):
    """A task's best `limit` documents of each query in each leg, with their scores in all legs.

    `least` are scores that a query's best `limit` reach for certain. With a single BM25 leg, they
    and what the task has found so far leave pairs out; else all are scored. The row without an id
    counts the pairs scored in full.
    """
    names = [f"s{i}" for i in range(len(legs))]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Per leg what was found so far, and the score that a document must reach to be among it.
        held = [None] * len(legs)
        bound = np.full((len(legs), len(block.ids)), _NONE)
        if least is not None:
            bound[:] = least
        scored, kind = 0, None
        for docs in _slices(batches, block):
            kind = docs.ids.type
            if legs == ("bm25",):
                scores, n = bm25(docs, block, bound[0])
                scores, scored = [scores], scored + n
            else:
                scores = [bm25(docs, block)[0] if leg == "bm25" else dense(docs, block) for leg in legs]
                scored += len(docs) * len(block.ids)
            for i, own in enumerate(scores):
                enough = bound[i]
                if len(docs) > limit:
                    enough = np.maximum(enough, np.partition(own, len(docs) - limit, axis=0)[len(docs) - limit])
                row, query = np.nonzero((own >= enough) & (own > _NONE))
                new = pa.table(
                    {"q": query, "doc_id": docs.ids.take(pa.array(row)), **{c: s[row, query] for c, s in zip(names, scores, strict=True)}}
                )
                held[i], bound[i] = _first(new if held[i] is None else pa.concat_tables([held[i], new]), names[i], limit, bound[i])
        for i, table in enumerate(held):
            if table is not None:
                yield from _rows(block, i, table, names)
        if kind is not None:
            empty = {"query_id": pa.nulls(1, block.ids.type), "leg": pa.array([-1], pa.int32()), "doc_id": pa.nulls(1, kind)}
            yield pa.RecordBatch.from_pydict(empty | {c: pa.array([scored], pa.int64()) for c in names})

    return find


def _first(table: pa.Table, score: str, limit: int, bound: np.ndarray) -> tuple[pa.Table, np.ndarray]:
    """The first `limit` rows of each query by falling score, then id, and the scores they end at."""
    table = table.sort_by([("q", "ascending"), (score, "descending"), ("doc_id", "ascending")])
    query = table["q"].to_numpy()
    place = np.arange(len(query)) - np.searchsorted(query, query)
    last = np.flatnonzero(place == limit - 1)
    bound = bound.copy()
    bound[query[last]] = np.maximum(bound[query[last]], table[score].to_numpy()[last])
    return table.filter(pa.array(place < limit)), bound


def _rows(block: Block, leg: int, table: pa.Table, names: list[str]) -> Iterator[pa.RecordBatch]:
    out = pa.table(
        {
            "query_id": block.ids.take(table["q"].combine_chunks()),
            "leg": pa.array(np.full(len(table), leg, np.int32)),
            "doc_id": table["doc_id"],
            **{c: table[c] for c in names},
        }
    )
    yield from out.combine_chunks().to_batches()


@dataclass
class Candidates:
    """Candidates of each query in the order of a leg: falling score, then id."""

    first: np.ndarray  # where each query's begin
    score: np.ndarray
    ids: pa.Array


def ahead(block: Block, legs: tuple[str, ...], candidates: list[Candidates]):
    """For each query and leg, how many documents stand between one candidate and the next.

    Rows (query_id, leg, j, n): n documents stand before candidate j, but not before the one ahead
    of it; the running sum over j is the number of documents ahead of j in the whole corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = [np.zeros(len(c.score) + len(block.ids), np.int64) for c in candidates]
        for docs in _slices(batches, block):
            for leg, found, own in zip(legs, candidates, between, strict=True):
                scores = bm25(docs, block)[0] if leg == "bm25" else dense(docs, block)
                mine, theirs = _orders(docs.ids, found.ids)
                for q in range(len(block.ids)):
                    a, b = found.first[q], found.first[q + 1]
                    if a < b:
                        places = _places(scores[:, q], mine, found.score[a:b], theirs[a:b])
                        own[a + q : b + q + 1] += np.bincount(places, minlength=b - a + 1)
        for leg, (found, own) in enumerate(zip(candidates, between, strict=True)):
            query = np.repeat(np.arange(len(block.ids)), np.diff(found.first) + 1)
            j = np.arange(len(own)) - (found.first[query] + query)
            kept = np.flatnonzero((own > 0) & (j < np.diff(found.first)[query]))
            yield pa.RecordBatch.from_pydict(
                {
                    "query_id": block.ids.take(pa.array(query[kept])),
                    "leg": pa.array(np.full(len(kept), leg, np.int32)),
                    "j": pa.array(j[kept].astype(np.int32)),
                    "n": pa.array(own[kept]),
                }
            )

    return count


def _orders(mine: pa.Array, theirs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of two columns of ids in the same order as the ids."""
    both = pa.chunked_array([mine, theirs]).combine_chunks().dictionary_encode()
    if isinstance(both, pa.ChunkedArray):
        both = both.combine_chunks()
    rank = np.empty(len(both.dictionary), np.int64)
    rank[pc.sort_indices(both.dictionary).to_numpy()] = np.arange(len(rank))
    numbers = rank[both.indices.to_numpy()]
    return numbers[: len(mine)], numbers[len(mine) :]


def _places(score: np.ndarray, ids: np.ndarray, wanted: np.ndarray, wanted_ids: np.ndarray) -> np.ndarray:
    """For each document, how many of the candidates (falling score, rising id) it does not precede."""
    places = np.searchsorted(-wanted, -score, "left")
    until = np.searchsorted(-wanted, -score, "right")
    # Equal scores go by id.
    tied = np.flatnonzero(until > places)
    begin = places[tied]
    for a in np.unique(begin):
        rows = tied[begin == a]
        b = until[rows[0]]
        places[rows] = a + np.searchsorted(wanted_ids[a:b], ids[rows], "right")
    return places
