"""Passages that knowledge chunks share, exactly or with small edits."""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amrspark.llm.store import store
from amrspark.llm.words import WordHashes, rolling, spaced_words

MIN_WORDS, SEED_WORDS, WINDOW, MAX_GAP, IDENTITY, ROUNDS = 50, 8, 16, 40, 0.8, 3
GAP_COST = 0.25
_BLOCK = 2048


def shared_passages(
    chunks: DataFrame,
    *,
    min_words: int = MIN_WORDS,
    seed_words: int = SEED_WORDS,
    window: int = WINDOW,
    identity: float = IDENTITY,
    rounds: int = ROUNDS,
) -> DataFrame:
    """Passages of at least `min_words` words that a chunk shares with another.

    Parameters
    ----------
    chunks: chunk_id (any orderable type), text; others are ignored.
    seed_words, window: the least hash of every `window` successive runs of `seed_words` words is
        a seed, so equal stretches of seed_words + window - 1 words share one.
    identity: share of equal words, in order, that both sides of a passage reach.

    Returns one row per passage and side: chunk_id, start, end (words, end exclusive), other_id,
    other_start, other_end, n_equal. Words stand between ASCII white space, A-Z lower-cased.

    1. Seeds of one chunk only go; so do those whose neighbours in the chunk span too little for
       a passage.
    2. Every chunk with a seed meets the seed's two pivots, the first and last chunk that have
       it, and not all others, so a passage in very many chunks costs one row for each. A
       repetition also meets its longest one, in which all others lie whole.
    3. The matches of two chunks, joined to runs, are chained in order on both sides: the best
       chain before a run comes from a Fenwick tree of prefix maxima, less a cost per word of gap.
    4. A chain is aligned on the texts: run by run, gaps by their longest common subsequence,
       ends word by word. One that is too unequal as a whole is cut at its widest gap.
    5. Seeds that lie in no passage yet meet other pivots, in an order drawn anew, for up to
       `rounds` rounds.
    6. Seeds still outside all passages meet every other place of theirs, block by block. The
       words around two places are chained and aligned where they are; as many pairs go on as
       link the places that have a passage, not all of them.

    A group of chunks with a passage is thus linked through its pivots, not pair by pair. Null
    ids and texts, empty and short texts have no passages. Of rows with one chunk_id the smallest
    text counts. Of a run repeated inside one chunk every place counts; an unbroken repetition,
    as of one word, is one place that reaches on.
    """
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    base = chunks.select(F.col("chunk_id").alias("a"), "text").where(
        F.col("chunk_id").isNotNull() & (F.length("text") > 2 * seed_words)
    )
    least = min_words - 2 * (window - 1)
    seeds = store(
        base.mapInArrow(_seeder(seed_words, window), f"a {kind}, pos int, reach int, seed long"), "seeds"
    )
    many = seeds.groupBy("seed").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).where("lo <> hi").select("seed")
    found = seeds.join(many, "seed").groupBy("a").agg(F.collect_list(F.struct("pos", "reach", "seed")).alias("s"))
    rows = f"a {kind}, pos int, reach int, seed long"
    none = F.array().cast("array<struct<start:int,end:int>>")
    first = live = store(
        found.withColumn("done", none).mapInArrow(_runs(seed_words, least), rows), "shared-seeds"
    )
    # The only shuffle of texts: those with a long enough run of shared seeds.
    texts = store(
        base.join(live.select("a").distinct(), "a", "left_semi").groupBy("a").agg(F.min("text").alias("text")),
        "texts",
    )
    done = None
    for turn in range(rounds):
        if turn:
            live = store(_outside(live, done, none).mapInArrow(_runs(seed_words, least), rows), "open-seeds")
            if live.isEmpty():
                break
        pairs = _pivoted(live, turn)
        now = store(_compared(pairs, live, texts, kind, seed_words, min_words, least, identity), "passages")
        done = now if done is None else done.unionAll(now)
    # Here a passage may stand in what others leave of it, so single seeds count.
    live = store(_outside(first, done, none).mapInArrow(_runs(seed_words, 0), rows), "rest-seeds")
    if not live.isEmpty():
        places = store(_places(live, first, texts, kind, seed_words, min_words), "rest-places")
        near = store(_blocks(places, kind, seed_words, min_words, identity), "rest-pairs")
        pairs = near.select("a", "b").distinct().join(first, "a").select("seed", "a", "pos", "reach", "b")
        full = _compared(pairs, first, texts, kind, seed_words, min_words, least, identity)
        # A chain over the whole texts may run too far for a passage: the one around a place counts too.
        here = _aligned(near.select("a", "b", "chains"), texts, kind, min_words, identity)
        done = done.unionAll(store(full.unionAll(here), "passages"))
    here = done.select(
        F.col("a").alias("chunk_id"), "start", "end", F.col("b").alias("other_id"),
        F.col("other_start"), F.col("other_end"), "n_equal",
    )
    there = done.select(
        F.col("b").alias("chunk_id"), F.col("other_start").alias("start"), F.col("other_end").alias("end"),
        F.col("a").alias("other_id"), F.col("start").alias("other_start"), F.col("end").alias("other_end"),
        "n_equal",
    )
    return here.unionAll(there).distinct()


def _outside(seeds, done, none) -> DataFrame:
    """(a, s, done): the seeds and the passages of each chunk."""
    sides = done.select("a", "start", "end").unionAll(done.select("b", "other_start", "other_end"))
    covered = sides.groupBy("a").agg(F.collect_set(F.struct("start", "end")).alias("done"))
    return (
        seeds.groupBy("a")
        .agg(F.collect_list(F.struct("pos", "reach", "seed")).alias("s"))
        .join(covered, "a", "left")
        .select("a", "s", F.coalesce("done", none).alias("done"))
    )


def _pivoted(live, turn: int) -> DataFrame:
    """(seed, a, pos, reach, b): every seed of a chunk with the two pivots of the seed, and for a
    repetition with its longest one, which holds all others whole."""
    h = (F.xxhash64("a", F.lit(turn)) if turn else F.lit(0)).alias("h")
    order, longest = F.struct(h, F.col("a")), F.struct(F.col("reach") - F.col("pos"), h, F.col("a"))
    pivots = live.groupBy("seed").agg(
        F.min(order)["a"].alias("lo"), F.max(order)["a"].alias("hi"), F.max(longest)["a"].alias("far")
    )
    return (
        live.join(pivots.where("lo <> hi"), "seed")
        .select("seed", "a", "pos", "reach", F.explode(F.array_distinct(F.array("lo", "hi", "far"))).alias("b"))
        .where(F.col("a") != F.col("b"))
    )


def _places(live, first, texts, kind: str, seed_words: int, min_words: int) -> DataFrame:
    """Every place of the seeds of `live`, with the words and seeds around it; `open` marks those
    of `live`."""
    asked = first.join(live.select("seed").distinct(), "seed").join(
        live.select("a", "seed", "pos", F.lit(True).alias("open")), ["a", "seed", "pos"], "left"
    )
    asked = asked.groupBy("a").agg(
        F.collect_list(F.struct("seed", "pos", "reach", F.coalesce("open", F.lit(False)).alias("open"))).alias("w")
    )
    all_seeds = first.groupBy("a").agg(F.collect_list(F.struct("pos", "reach", "seed")).alias("s"))
    return asked.join(all_seeds, "a").join(texts, "a").select("a", "w", "s", "text").mapInArrow(
        _surrounder(seed_words, min_words),
        f"seed long, a {kind}, pos int, size int, open boolean, around binary, seeds binary, places binary",
    )


def _blocks(places, kind: str, seed_words: int, min_words: int, identity: float) -> DataFrame:
    """Pairs (a, b, chains) of chunks whose words around an open place and another of its seed make
    a passage, as many as link these places.

    The places of a seed are cut into blocks by a hash; a task compares two of them.
    """
    sizes = places.groupBy("seed").agg(F.ceil(F.count("*") / _BLOCK).cast("int").alias("k"))
    rows = places.join(sizes, "seed").withColumn("i", F.pmod(F.xxhash64("a"), F.col("k")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    left = rows.where("open").select("*", each.alias("y")).withColumnRenamed("i", "x").withColumn("left", F.lit(True))
    right = rows.select("*", each.alias("x")).withColumnRenamed("i", "y").withColumn("left", F.lit(False))
    columns = ["seed", "x", "y", "left", "a", "pos", "size", "open", "around", "seeds", "places"]
    both = left.select(columns).unionAll(right.select(columns))
    return both.groupBy("seed", "x", "y").applyInArrow(
        _near(seed_words, min_words, identity), f"a {kind}, b {kind}, chains array<array<int>>"
    )


def _far(min_words: int) -> int:
    """How far off a seed may stand that a chain joins: a run of under `min_words` words joins what
    is less than twice as far."""
    return int(min_words * (1 + 0.5 / GAP_COST))


def _surrounder(seed_words: int, min_words: int):
    """Each asked place with the hashes of the words around it, and the seeds a chain could join."""
    far = _far(min_words)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in _few(batches, 50):
            owner, asks, around, nears, spots = [], [], [], [], []
            for row, (asked, known, text) in enumerate(
                zip(
                    batch.column("w").to_pylist(),
                    batch.column("s").to_pylist(),
                    batch.column("text").cast(pa.binary()).to_pylist(),
                    strict=True,
                )
            ):
                # Odd for words; zeros stand before and after the text.
                h = hashes.of(spaced_words(text)).astype(np.uint32) | np.uint32(1)
                h = np.concatenate([np.zeros(far, np.uint32), h, np.zeros(far + min_words, np.uint32)])
                known = sorted((k["pos"], k["reach"], k["seed"]) for k in known)
                pos, reach, value = np.array(known, np.int64).T
                for w in asked:
                    at = w["pos"]
                    close = (reach + seed_words + far >= at) & (pos <= at + seed_words + far)
                    owner.append(row)
                    asks.append((w["seed"], at, w["reach"] - at, w["open"]))
                    around.append(h[at : at + 2 * far + min_words].tobytes())
                    nears.append(value[close].tobytes())
                    spots.append(np.stack([pos - at, reach - pos])[:, close].T.astype(np.int32).tobytes())
            seed, at, size, opened = zip(*asks, strict=True) if asks else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(seed, pa.int64()), batch.column("a").take(pa.array(owner, pa.int64())),
                    pa.array(at, pa.int32()), pa.array(size, pa.int32()), pa.array(opened, pa.bool_()),
                    pa.array(around, pa.binary()), pa.array(nears, pa.binary()), pa.array(spots, pa.binary()),
                ],
                ["seed", "a", "pos", "size", "open", "around", "seeds", "places"],
            )

    return read


def _near(seed_words: int, min_words: int, identity: float):
    """The pairs of two blocks with a passage in the words around their places.

    First what can be none goes, for all places at once: the equal words around the seed are too
    few, and no other seed is shared that a chain could join. The rest is chained and aligned.
    Open places that are linked already meet no more of each other, and no place in a passage once
    one of them is linked with such a place.
    """
    far = _far(min_words)

    def compare(table: pa.Table) -> pa.Table:
        ids = table["a"].to_pylist()
        rank = {v: i for i, v in enumerate(sorted(set(ids)))}
        code = np.array([rank[v] for v in ids])
        own = table["seed"][0].as_py()
        side = table["left"].to_numpy(zero_copy_only=False)
        left, right = np.flatnonzero(side), np.flatnonzero(~side)
        at, size = table["pos"].to_numpy(), table["size"].to_numpy()
        opened = table["open"].to_numpy(zero_copy_only=False)
        words = np.frombuffer(b"".join(table["around"].to_pylist()), np.uint32).reshape(len(ids), -1)
        seeds = [np.frombuffer(v, np.int64).tolist() for v in table["seeds"].to_pylist()]
        spots = [np.frombuffer(v, np.int32).reshape(-1, 2).tolist() for v in table["places"].to_pylist()]
        has: dict[int, list[tuple[int, int, int]]] = {}
        for k, r in enumerate(right.tolist()):
            for seed, (off, n) in zip(seeds[r], spots[r], strict=True):
                if seed != own or off:
                    has.setdefault(seed, []).append((k, off, n))
        held = {seed: np.array(v, np.int64).T for seed, v in has.items()}
        back = words[right, far - min_words : far][:, ::-1]
        step = np.arange(min_words)
        root = {v: v for v in zip(ids, at.tolist())}
        covered = set()

        def top(v):
            while root[v] != v:
                v = root[v]
            return v

        made = []
        for p in left.tolist():
            # Two places open on both sides are compared once.
            ok = (code[right] > code[p]) | ((code[right] != code[p]) & ~opened[right])
            n = np.minimum(size[right], size[p]) + seed_words
            ends = far + np.minimum(n, min_words)[:, None] + step
            before = _reached(words[p, far - min_words : far][::-1], back)
            after = _reached(words[p][ends], words[right[:, None], ends])
            near = before + after + n >= min_words
            for seed, (off, reach) in zip(seeds[p], spots[p], strict=True):
                if seed in held and off:
                    k, other, other_reach = held[seed]
                    # Repetitions stand on several diagonals: no offset tells where.
                    inside = (off == other) & (-before[k] <= off) & (off <= after[k]) & (reach + other_reach == 0)
                    # A chain has its seeds in one order on both sides.
                    near[k[~inside & (off * other > 0)]] = True
            mine = (ids[p], int(at[p]))
            for q in sorted(right[near & ok].tolist(), key=lambda q: (not opened[q], code[q], at[q])):
                yours = (ids[q], int(at[q]))
                if top(mine) in covered if not opened[q] else top(mine) == top(yours):
                    continue
                shared: dict[int, list[tuple[int, int]]] = {}
                for seed, spot in zip(seeds[q], spots[q], strict=True):
                    shared.setdefault(seed, []).append(spot)
                matches = [
                    (off + far, other + far, min(reach, other_reach) + seed_words)
                    for seed, (off, reach) in zip(seeds[p], spots[p], strict=True)
                    for other, other_reach in shared.get(seed, ())
                ]
                chain = _passage(words[p], words[q], far, matches, min_words, identity)
                if not chain:
                    continue
                x, y = mine[1] - far, yours[1] - far
                made.append((ids[p], ids[q], [[v for a, b, n in chain for v in (a + x, b + y, n)]]))
                if opened[q]:
                    covered |= {top(yours)} if top(mine) in covered else set()
                    root[top(mine)] = top(yours)
                else:
                    covered.add(top(mine))
        kind = table.schema.field("a").type
        a, b, chains = zip(*made, strict=True) if made else ((),) * 3
        return pa.table(
            {
                "a": pa.array(a, kind), "b": pa.array(b, kind),
                "chains": pa.array(chains, pa.list_(pa.list_(pa.int32()))),
            }
        )

    return compare


def _passage(one: np.ndarray, two: np.ndarray, at: int, matches: list, min_words: int, identity: float) -> list:
    """The chain through the place `at` of both, if it makes a passage of the words given."""
    width = len(one)
    runs = [
        (x, y, min(n, width - x, width - y)) for x, y, n in matches if x >= 0 and y >= 0 and max(x, y) < width
    ]
    # What is around may be far less than a chain has: gaps cost less than over whole texts.
    for chain in best_chains(join_matches(runs), GAP_COST / 2.5):
        if any(x == y and x <= at < x + n for x, y, n in chain):
            # What stands outside a text equals nothing.
            words, others = np.where(one, one.astype(np.int64), -1).tolist(), two.tolist()
            for part, (start, end, other, other_end, _) in passages_of(words, others, chain, min_words, identity):
                if start <= at < end and other <= at < other_end:
                    return part
    return []


def _reached(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Words that `_extend` adds, of `one` with each row of `others`."""
    score = np.cumsum(np.where((others == one) & (one > 0), 1, -2), axis=1, dtype=np.int32)
    top = np.maximum.accumulate(np.maximum(score, 0), axis=1)
    live = np.logical_and.accumulate(score > top - 6, axis=1)
    score = np.where(live, score, 0)
    best = score.argmax(axis=1)
    return np.where(score[np.arange(len(score)), best] > 0, best + 1, 0)


def _compared(pairs, live, texts, kind: str, seed_words: int, min_words: int, least: int, identity: float):
    """Passages (a, start, end, b, other_start, other_end, n_equal) of the pairs (seed, a, pos,
    reach, b)."""
    places = live.select(
        "seed", F.col("a").alias("b"), F.col("pos").alias("at"), F.col("reach").alias("at_reach")
    )
    size = F.least(F.col("reach") - F.col("pos"), F.col("at_reach") - F.col("at")) + seed_words
    matched = (
        pairs.join(places, ["seed", "b"])
        .groupBy("a", "b")
        .agg(
            F.collect_list(F.struct("pos", "at", size.alias("n"))).alias("m"),
            F.min("pos").alias("x"),
            F.max(F.col("pos") + size).alias("y"),
        )
        .where(F.col("y") - F.col("x") >= least)
        .select("a", "b", "m")
        .mapInArrow(_chainer(least), f"a {kind}, b {kind}, chains array<array<int>>")
    )
    return _aligned(matched, texts, kind, min_words, identity)


def _aligned(matched, texts, kind: str, min_words: int, identity: float) -> DataFrame:
    """Passages of the pairs (a, b, chains) on their texts."""
    full = (
        matched.join(texts.withColumnRenamed("text", "ta"), "a")
        .join(texts.select(F.col("a").alias("b"), F.col("text").alias("tb")), "b")
        .select("a", "b", "chains", "ta", "tb")
    )
    return full.mapInArrow(
        _aligner(min_words, identity),
        f"a {kind}, start int, end int, b {kind}, other_start int, other_end int, n_equal int",
    )


def _few(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices, as their values are many times larger as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()


def _seeder(seed_words: int, window: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in _few(batches):
            found, ends, values, counts = [], [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                h = rolling(hashes.of(spaced_words(text)), seed_words)
                at = winnow(h, window)
                order = np.argsort(h[at], kind="stable")
                place, seed = at[order], h[at][order]
                new = np.diff(seed, prepend=seed[:1] ^ np.uint64(1)) != 0
                # A seed that comes again and again, as in a repeated word, reaches on; further
                # away it is a row of its own.
                starts = np.flatnonzero(new | (np.diff(place, prepend=0) > MAX_GAP))
                found.append(place[starts].astype(np.int32))
                ends.append(place[np.append(starts, len(place))[1:] - 1].astype(np.int32))
                values.append(seed[starts].view(np.int64))
                counts.append(len(starts))
            owner = np.repeat(np.arange(len(counts)), counts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("a").take(pa.array(owner)),
                    pa.array(np.concatenate([np.empty(0, np.int32), *found])),
                    pa.array(np.concatenate([np.empty(0, np.int32), *ends])),
                    pa.array(np.concatenate([np.empty(0, np.int64), *values])),
                ],
                ["a", "pos", "reach", "seed"],
            )

    return read


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the least value of every `window` successive ones, in order."""
    if not len(h):
        return np.empty(0, np.int64)
    size = min(window, len(h))
    # The first least value of windows of one, two, four ... values, then of two that overlap.
    least, at, width = h, np.arange(len(h)), 1
    while width < size:
        step = min(width, size - width)
        later = least[step:] < least[:-step]
        least = np.where(later, least[step:], least[:-step])
        at = np.where(later, at[step:], at[:-step])
        width += step
    return at[np.diff(at, prepend=-1) != 0]


def _runs(seed_words: int, least: int):
    """Keep a chunk's seeds outside its passages that stand in runs spanning `least` words."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            owner, kept = [], []
            for row, (seeds, done) in enumerate(
                zip(batch.column("s").to_pylist(), batch.column("done").to_pylist(), strict=True)
            ):
                found = sorted((s["pos"], s["reach"], s["seed"]) for s in seeds)
                for cut in done:
                    found = [p for p in found if not cut["start"] <= p[0] <= cut["end"] - seed_words]
                pos = np.array([p for p, _, _ in found], np.int64)
                reach = np.maximum.accumulate([r for _, r, _ in found]) if found else pos
                breaks = np.flatnonzero(pos[1:] - reach[:-1] > MAX_GAP) + 1
                for a, b in zip([0, *breaks], [*breaks, len(pos)], strict=True):
                    if b > a and reach[b - 1] - pos[a] + seed_words >= least:
                        owner += [row] * int(b - a)
                        kept += found[a:b]
            pos, reach, seed = zip(*kept, strict=True) if kept else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("a").take(pa.array(owner, pa.int64())),
                    pa.array(pos, pa.int32()), pa.array(reach, pa.int32()), pa.array(seed, pa.int64()),
                ],
                ["a", "pos", "reach", "seed"],
            )

    return keep


def _chainer(least: int):
    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            keep, chains = [], []
            for row, matches in enumerate(batch.column("m").to_pylist()):
                runs = join_matches([(m["pos"], m["at"], m["n"]) for m in matches])
                found = [
                    [v for run in c for v in run] for c in best_chains(runs)
                    if c[-1][0] + c[-1][2] - c[0][0] >= least
                ]
                if found:
                    keep.append(row)
                    chains.append(found)
            index = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("a").take(index), batch.column("b").take(index),
                    pa.array(chains, pa.list_(pa.list_(pa.int32()))),
                ],
                ["a", "b", "chains"],
            )

    return chain


def join_matches(matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Matches (place, other place, words) on one diagonal with gaps of up to eight words, as runs
    in order."""
    runs: list[tuple[int, int, int]] = []
    for x, y, m in sorted(matches, key=lambda m: (m[0] - m[1], m[0])):
        if runs:
            a, b, n = runs[-1]
            if a - b == x - y and x - (a + n) <= 8:
                runs[-1] = (a, b, max(n, x + m - a))
                continue
        runs.append((x, y, m))
    return sorted(runs)


class _PrefixMaxima:
    """A Fenwick tree: the largest (score, index) at or before a place."""

    def __init__(self, size: int):
        self.best = [(float("-inf"), -1)] * (size + 1)

    def put(self, at: int, value: tuple[float, int]) -> None:
        at += 1
        while at < len(self.best):
            if value > self.best[at]:
                self.best[at] = value
            at += at & -at

    def upto(self, at: int) -> tuple[float, int]:
        found = (float("-inf"), -1)
        at += 1
        while at > 0:
            found = max(found, self.best[at])
            at -= at & -at
        return found


def best_chains(runs: list[tuple[int, int, int]], gap_cost: float = GAP_COST) -> list[list[tuple[int, int, int]]]:
    """Chains of runs in order on both sides, best first, each run in one chain.

    A chain scores its words, less a cost per word of gap on either side; a run starts a chain of
    its own where no chain before it is worth its gap. Runs may overlap by some words.
    """
    ends = sorted({b + n for _, b, n in runs})
    rank = {e: i for i, e in enumerate(ends)}
    tree = _PrefixMaxima(len(ends))
    score, back = [0.0] * len(runs), [-1] * len(runs)
    waiting = sorted(range(len(runs)), key=lambda i: runs[i][0] + runs[i][2])
    done = 0
    for i, (a, b, n) in enumerate(runs):
        slack = min(n, 8) - 1
        while done < len(waiting) and runs[waiting[done]][0] + runs[waiting[done]][2] <= a + slack:
            j = waiting[done]
            x, y, m = runs[j]
            if j < i:
                tree.put(rank[y + m], (score[j] + gap_cost * (x + m + y + m), j))
            done += 1
        low, high = 0, len(ends)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if ends[mid] <= b + slack else (low, mid)
        value, j = tree.upto(low - 1) if low else (float("-inf"), -1)
        gain = value - gap_cost * (a + b)
        score[i] = n + max(0.0, gain)
        back[i] = j if gain > 0 else -1
    used, chains = [False] * len(runs), []
    for i in sorted(range(len(runs)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(runs[i])
            i = back[i]
        if chain:
            chains.append(chain[::-1])
    return chains


def _aligner(min_words: int, identity: float):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            rows, spans = [], []
            known, old = [], None
            for row, (chains, ta, tb) in enumerate(
                zip(
                    batch.column("chains").to_pylist(),
                    batch.column("ta").cast(pa.binary()).to_pylist(),
                    batch.column("tb").cast(pa.binary()).to_pylist(),
                    strict=True,
                )
            ):
                if tb != old:
                    known, old = spaced_words(tb), tb
                words = spaced_words(ta)
                for flat in chains:
                    runs = [tuple(flat[k : k + 3]) for k in range(0, len(flat), 3)]
                    for _, span in passages_of(words, known, runs, min_words, identity):
                        rows.append(row)
                        spans.append(span)
            index = pa.array(rows, pa.int64())
            table = np.array(spans, np.int32).reshape(-1, 5)
            column = [pa.array(c) for c in table.T]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").take(index), column[0], column[1], batch.column("b").take(index), *column[2:]],
                ["a", "start", "end", "b", "other_start", "other_end", "n_equal"],
            )

    return align


def passages_of(
    words: list, others: list, runs: list[tuple[int, int, int]], min_words: int, identity: float
) -> Iterator[tuple[list[tuple[int, int, int]], tuple[int, int, int, int, int]]]:
    """(runs, aligned span) of the chain if it is a passage, else of its parts that are: it is cut at
    the gap that adds most words."""
    todo = [runs]
    while todo:
        runs = todo.pop()
        start, end, other, other_end, equal = span = align_chain(words, others, runs)
        size, most = sorted((end - start, other_end - other))
        if size < min_words:
            continue
        if equal >= identity * most:
            yield runs, span
        elif len(runs) > 1:
            gaps = [max(c - a - m, d - b - m) for (a, b, m), (c, d, _) in zip(runs, runs[1:])]
            cut = gaps.index(max(gaps)) + 1
            todo += [runs[cut:], runs[:cut]]


def align_chain(words: list, others: list, runs: list[tuple[int, int, int]]) -> tuple[int, int, int, int, int]:
    """Start, end, other start, other end and equal words of a chain on the texts."""
    a, b, _ = runs[0]
    back = _extend(words, others, a, b, -1)
    start, other_start = a - back[0], b - back[0]
    x, y, equal = start, other_start, 0
    for a, b, n in runs:
        skip = max(0, x - a, y - b)
        a, b, n = a + skip, b + skip, n - skip
        if n <= 0:
            continue
        equal += _common(words[x:a], others[y:b])
        equal += sum(map(eq, words[a : a + n], others[b : b + n]))
        x, y = a + n, b + n
    ahead = _extend(words, others, x, y, 1)
    # The words of the left end were counted as part of the first gap.
    return start, x + ahead[0], other_start, y + ahead[0], equal + ahead[1]


def _extend(words: list, others: list, x: int, y: int, step: int) -> tuple[int, int]:
    """Words to add from x and y on, and the equal ones: as far as matches outweigh differences."""
    i, j = (x, y) if step > 0 else (x - 1, y - 1)
    size = equal = best = best_equal = score = top = 0
    while 0 <= i < len(words) and 0 <= j < len(others) and score > top - 6:
        same = words[i] == others[j]
        size, equal, score = size + 1, equal + same, score + (1 if same else -2)
        if score > top:
            top, best, best_equal = score, size, equal
        i, j = i + step, j + step
    return best, best_equal


def _common(one: list, two: list) -> int:
    """Length of the longest common subsequence of two gaps."""
    if not one or not two:
        return 0
    if len(one) == len(two):
        same = sum(map(eq, one, two))
        if same + 2 >= len(one):
            return same
    # A bit per word of `two`; those at zero in the end are in the subsequence (Hyyro).
    places: dict[bytes, int] = {}
    for i, w in enumerate(two):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(two)) - 1
    open_bits = full
    for w in one:
        hit = open_bits & places.get(w, 0)
        if hit:
            open_bits = ((open_bits + hit) | (open_bits - hit)) & full
    return len(two) - open_bits.bit_count()
