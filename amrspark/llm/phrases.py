"""Phrases of knowledge chunks whose words belong together, mined from a sample and its border."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amrspark.llm.store import store
from amrspark.llm.words import mix
from amrspark.operators.ranking import numbered

SAMPLE_IN, MAX_BITS, _PART_BYTES = 4, 1 << 27, 16 << 20
_SLICE_BYTES, _WORDS, _HELD, _PHRASES, _LONG = 1 << 20, 300_000, 1 << 19, 3 << 18, 256
_CODE_BITS = 21  # of a word's number in the number of a phrase
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BREAK = b"\n"
# Spaces and tabs part words; these characters, line breaks among them, part pieces.
_WORD, _SPACE, _PIECE = range(3)
_KINDS = bytes(_PIECE if b in b".,;:!?\n\x0b\x0c\r" else _SPACE if b in b" \t" else _WORD for b in range(256))
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mine_phrases(
    chunks: DataFrame,
    *,
    group: str = "source",
    unknown: str = "und",
    max_words: int = 3,
    min_count: int = 10,
    contained_percent: int = 50,
    top: int = 2000,
    sample_in: int = SAMPLE_IN,
) -> DataFrame:
    """The phrases of each group of chunks whose words stand together more often than apart.

    Parameters
    ----------
    chunks: chunk_id, text and the column `group`; others are ignored. All counts are per group.
    unknown: the group of chunks without one.
    max_words: words of a phrase, at most: two or three. min_count: occurrences of a phrase, at least.
    contained_percent: a phrase goes if one longer phrase that holds it makes up that share of it.
    top: phrases returned per group. sample_in: one chunk of so many is in the sample.

    Returns `group`, rank (from 1), phrase (words by spaces), a (occurrences), l and r (those of its
    two parts), n (words of the group), score: floor(1000000 a a / (l r)) of the cut in two parts
    that scores least, the leftmost of equal ones. Rows are ranked by falling score, falling a, then
    phrase in byte order.

    Texts are lower-cased (A-Z) and cut at `. , ; : ! ?` and line breaks into pieces; words are what
    stands between spaces and tabs. Occurrences may overlap. A null or empty text has no words;
    every row counts, rows of a repeated chunk_id too. Groups without a phrase have no rows, and an
    empty table gives none. A text is read whole, so a task's memory grows with the longest text.

    A phrase is frequent only if its words but the last and its words but the first are. So:

    1. In the sample, words and phrases that reach a lowered share of `min_count` are proposed.
    2. A full pass counts the proposed ones and their negative border: every word, and each phrase
       whose two parts, without the last and without the first word, are proposed.
    3. Frequent phrases of the border that were not proposed are failures. They are proposed too,
       and a further pass counts the phrases that this adds to the border, until none fails.
    4. A last pass counts the frequent ones again by their words.

    Steps 1 to 3 count hashes, which can only raise a count; step 4 settles it. What is proposed is
    handed to the tasks as a bit table of a fixed size at most (16 MB a length): where two share a
    bit, more is counted than needed, never less. Tasks add up what they count in tables of bounded
    size before the shuffle.
    """
    if max_words not in (2, 3):
        raise ValueError("max_words must be 2 or 3")
    rows = chunks.select(
        "text", F.coalesce(F.col(group).cast("string"), F.lit(unknown)).alias("g"),
        F.pmod(F.xxhash64("chunk_id", "text"), F.lit(sample_in)).alias("part"),
    ).where(F.length("text") > 0).select("g", "text", "part")
    sample = store(rows.where("part = 0").select("g", "text"), "sample")
    rows = rows.select("g", "text")
    size = (sample.agg(F.sum(F.octet_length("text"))).first()[0] or 0) * sample_in
    parts = 1 << max(4, (size // _PART_BYTES).bit_length())
    lowered = max(1, int(0.8 * min_count / sample_in))
    bits, known, proposed = 1 << 16, {}, None
    for m in range(1, max_words):
        # Words, then phrases of sampled words, and so on.
        own = store(_summed(sample, (m, m, known, None), lowered, parts), "proposed")
        proposed = own if proposed is None else proposed.unionAll(own)
        bits = min(MAX_BITS, max(bits, 1 << (32 * own.count()).bit_length()))
        known = bit_tables(proposed, bits, range(1, m + 1))
    before, counted = None, []
    while True:
        first = 2 if before else 1
        frequent = store(_summed(rows, (first, max_words, known, before), min_count, parts), "frequent")
        counted.append(frequent)
        border = frequent.where(F.col("level") < max_words)
        failed = bit_tables(border.mapInArrow(_unknown(known), frequent.schema), bits, range(1, max_words))
        if not any(t.any() for t in failed.values()):
            break
        before, known = known, {m: known[m] | failed[m] for m in known}
    found = counted[0]
    for more in counted[1:]:
        found = found.unionAll(more)
    named = _phrases(max_words, bit_tables(found, bits, range(1, max_words + 1)), parts)
    packed = rows.mapInArrow(named, "g string, part int, phrases binary, n binary")
    exact = packed.groupBy("g", "part").applyInArrow(_named, "g string, phrase string, n long")
    counts = store(exact.where((F.col("n") >= min_count) | (F.col("phrase") == "")), "phrases")
    return _scored(counts, max_words, contained_percent, top).withColumnRenamed("g", group)


def _scored(counts: DataFrame, max_words: int, percent: int, top: int) -> DataFrame:
    known = counts.where("phrase <> ''")
    words = F.split("phrase", " ")
    held = known.select("g", "phrase", F.col("n").alias("a"), words.alias("w")).where(F.size("w") > 1)
    size = F.size("w")

    def side(k, name: str, start, length):
        part = F.array_join(F.slice("w", start, length), " ")
        return F.struct(k.alias("k"), F.lit(name).alias("side"), part.alias("part"))

    cuts = F.transform(
        F.sequence(F.lit(1), size - 1),
        lambda k: F.array(side(k, "l", F.lit(1), k), side(k, "r", k + 1, size - k)),
    )
    parts = held.select("g", "phrase", "a", F.inline(F.flatten(cuts)))
    of_part = known.select("g", F.col("phrase").alias("part"), F.col("n").alias("m"))
    sides = [
        F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("m"))).alias(f"{s}{k}")
        for k in range(1, max_words)
        for s in "lr"
    ]
    joined = parts.join(of_part, ["g", "part"]).groupBy("g", "phrase", "a").agg(*sides)
    # Decimals: the products pass 64 bits; the quotient is at most a million.
    wide = "cast({} as decimal(20,0))"
    score = f"(cast(1000000 as decimal(7,0)) * {wide} * {wide}) div ({wide} * {wide})"
    each = []
    for k in range(1, max_words):
        value = F.expr(score.format("a", "a", f"l{k}", f"r{k}")).alias("score")
        cut = F.struct(value, F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
        each.append(F.when(F.col(f"l{k}").isNotNull(), cut))
    cut = F.array_min(F.array_compact(F.array(*each))).alias("cut")
    best = joined.select("g", "phrase", "a", cut).select("g", "phrase", "a", "cut.*")
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), size - 1),
            lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.array_join(F.slice("w", i, m), " ")),
        )
    )
    longer = (
        held.where(size > 2)
        .select("g", F.explode(inner).alias("phrase"), "a")
        .groupBy("g", "phrase")
        .agg(F.max("a").alias("most"))
    )
    kept = best.join(longer, ["g", "phrase"], "left").where(
        F.coalesce(100 * F.col("most") < percent * F.col("a"), F.lit(True))
    )
    down = [(-F.col("score")).alias("s"), (-F.col("a")).alias("b")]
    placed = numbered(
        kept.select("g", "phrase", "a", "l", "r", "score", *down), ["g"], ["s", "b", "phrase"]
    )
    totals = counts.where("phrase = ''").select("g", "n")
    best = placed.where(F.col("rank") <= top).join(totals, "g")
    return best.select("g", "rank", "phrase", "a", "l", "r", "n", "score")


def _summed(rows: DataFrame, rule, least: int, parts: int) -> DataFrame:
    """(level, h): the phrases, by hash, that the rule counts and that occur `least` times.

    A task adds up what it counts and sends it packed, a row per range of hashes; each range is
    merged by one task. Their number follows the size of the texts, so a range stays small. Inside
    one, hashes are told by 32 bits, and counts stop at the largest number of their type.
    """
    kind = "<u1" if least < 256 else "<u4"
    width = 8 * np.dtype(kind).itemsize
    packed = rows.mapInArrow(
        _hashes(rule, parts, kind), "level int, part int, once binary, low binary, n binary"
    )

    def merge(table: pa.Table) -> pa.Table:
        level, part = (table[c][0].as_py() for c in ("level", "part"))
        once, low, n = (
            np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in (("once", "<u4"), ("low", "<u4"), ("n", kind))
        )
        low = np.concatenate((once, low)).astype(np.uint64)
        n = np.concatenate((np.ones(len(once), kind), n))
        both = np.sort(low << np.uint64(width) | n)
        low, n = both >> np.uint64(width), (both & np.uint64((1 << width) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        kept = low[first][np.add.reduceat(n, first) >= least]
        h = (np.uint64(part << 32) | kept).view(np.int64)
        return pa.table({"level": pa.array(np.full(len(h), level, np.int32)), "h": pa.array(h)})

    return packed.groupBy("level", "part").applyInArrow(merge, "level int, h long")


def bit_tables(found: DataFrame, bits: int, levels) -> dict[int, np.ndarray]:
    """For each level a table of `bits` bits with those of the hashes set: bits / 64 numbers."""
    slot = F.col("h").bitwiseAND(F.lit(bits - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    rows = found.groupBy("level", F.shiftright(slot, 6).cast("int").alias("word")).agg(F.bit_or(bit).alias("bit")).toArrow()
    level, place, value = (rows[c].to_numpy() for c in ("level", "word", "bit"))
    out = {m: np.zeros(bits // 64, np.int64) for m in levels}
    for m, table in out.items():
        table[place[level == m]] = value[level == m]
    return {m: table.view(np.uint64) for m, table in out.items()}


def _has(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h & np.uint64(len(table) * 64 - 1)
    return (table[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def _within(places: np.ndarray, table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The places whose hashes the table has."""
    at = np.flatnonzero(places)
    out = np.zeros(len(places), bool)
    out[at] = _has(table, h[at])
    return out


def _unknown(known: dict[int, np.ndarray]):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            level, h = batch.column("level").to_numpy(), batch.column("h").to_numpy().view(np.uint64)
            new = np.zeros(len(h), bool)
            for m, table in known.items():
                new[level == m] = ~_has(table, h[level == m])
            yield batch.filter(pa.array(new))

    return keep


class _Words(dict):
    """Numbers of words, in order of appearance."""

    def __init__(self):
        super().__init__()
        self.names: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.names.append(word)
        self[word] = len(self.names) - 1
        return len(self.names) - 1


@dataclass
class _Slice:
    """Some whole texts of a group as one lower-cased text, cut into words."""

    group: str
    text: bytes  # with eight more bytes at the end
    starts: np.ndarray
    sizes: np.ndarray
    joins: np.ndarray  # for each word but the last, whether the next one is in its piece

    def chunk(self, words: np.ndarray, at: int) -> np.ndarray:
        """Eight bytes of each of the words from byte `at` on, zeros past its end."""
        windows = np.ndarray((len(self.text) - 7,), "<u8", self.text, strides=(1,))
        left = np.minimum(self.sizes[words] - at, 8)
        return windows[self.starts[words] + at] & _MASKS[left]

    def word(self, i: int) -> bytes:
        start = int(self.starts[i])
        return self.text[start : start + int(self.sizes[i])]

    def hashes(self) -> np.ndarray:
        """A hash of each word and the group, from eight bytes at a time."""
        h = mix(self.sizes.astype(np.uint64) ^ np.uint64(xxhash.xxh3_64_intdigest(self.group.encode())))
        words, at = np.flatnonzero(self.sizes <= _LONG), 0
        while len(words):
            h[words] = mix(h[words] * _STEP ^ self.chunk(words, at))
            at += 8
            words = words[self.sizes[words] > at]
        for i in np.flatnonzero(self.sizes > _LONG).tolist():
            h[i] ^= np.uint64(xxhash.xxh3_64_intdigest(self.word(i)))
        return h

    def numbers(self, known: _Words, hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The numbers of the words `of`. Words of one hash are compared before they count as one."""
        _, first, same = np.unique(hashes[of], return_index=True, return_inverse=True)
        first = of[first]
        other = first[same]
        equal = (self.sizes[of] == self.sizes[other]) & (self.sizes[of] <= _LONG)
        places, at = np.flatnonzero(equal), 0
        while len(places):
            equal[places] = self.chunk(of[places], at) == self.chunk(other[places], at)
            at += 8
            places = places[equal[places] & (self.sizes[of[places]] > at)]
        out = np.array([known[self.word(i)] for i in first.tolist()], np.int64)[same]
        for i in np.flatnonzero(~equal).tolist():
            out[i] = known[self.word(of[i])]
        return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[_Slice]:
    for batch in batches:
        pa.default_memory_pool().release_unused()
        groups = batch.column("g").to_pylist()
        texts = batch.column("text").cast(pa.binary())
        order = sorted(range(len(groups)), key=groups.__getitem__)
        held, size = [], 0
        for at, i in enumerate(order):
            held.append(texts[i].as_py())
            size += len(held[-1])
            last = at + 1 == len(order) or groups[order[at + 1]] != groups[i]
            if size < _SLICE_BYTES and not last:
                continue
            text = _BREAK.join(held).lower() + _BREAK * 8
            held, size = [], 0
            kind = np.frombuffer(text.translate(_KINDS), np.uint8)
            edges = np.flatnonzero(np.diff(kind == _WORD, prepend=False))
            # The breaks at the end close the last word.
            starts, ends = edges[::2], edges[1::2]
            breaks = np.flatnonzero(kind == _PIECE)
            piece = np.searchsorted(breaks, starts)
            yield _Slice(groups[i], text, starts, ends - starts, piece[1:] == piece[:-1])


def _joined(grams: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of phrases one word longer."""
    return mix(grams * _STEP + last)


class _Sums:
    """Counts of 64-bit numbers, added up in a table of bounded size."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, values: np.ndarray) -> None:
        if len(values):
            values = np.sort(values)
            first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
            self.parts.append((values[first], np.diff(first, append=len(values))))
            self.size += len(first)
            if self.size > 2 * _HELD:
                self.merge()

    def merge(self) -> None:
        if len(self.parts) > 1:
            values, counts = (np.concatenate(c) for c in zip(*self.parts, strict=True))
            order = np.argsort(values, kind="stable")
            values, counts = values[order], counts[order]
            first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
            self.parts = [(values[first], np.add.reduceat(counts, first))]
            self.size = len(first)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        return self.parts[0] if self.parts else (np.empty(0, np.uint64), np.empty(0, np.int64))

    def drained(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.merged()
        self.parts, self.size = [], 0
        return out


def _hashes(rule, parts: int, kind: str):
    """Tasks that count the phrases of a rule.

    A rule is (shortest, longest, known, before), the words of a phrase that counts, at least and at
    most. Phrases count if both their parts are known, single words always. Those whose parts both
    were known `before` were counted then.
    """
    shortest, longest, known, before = rule

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {m: _Sums() for m in range(shortest, longest + 1)}
        for part in _slices(batches):
            hashes = grams = part.hashes()
            size = len(hashes)
            if shortest == 1:
                sums[1].add(hashes)
            inside = old = np.ones(size, bool)
            for m in range(2, longest + 1):
                # Phrases one word shorter, by the place of their first word.
                inside = _within(inside, known[m - 1], grams)
                old = _within(old, before[m - 1], grams) if before else np.zeros(size, bool)
                at = np.flatnonzero(inside[:-1] & inside[1:] & part.joins)
                long = _joined(grams[at], hashes[at + m - 1])
                done = old[at] & old[at + 1]
                if m >= shortest:
                    sums[m].add(long[~done])
                inside, old, grams = (np.zeros(size, t) for t in (bool, bool, np.uint64))
                inside[at], old[at], grams[at] = True, done, long
            for m, held in sums.items():
                if held.size > _HELD:
                    yield _packed(m, *held.drained(), parts, kind)
        for m, held in sums.items():
            yield _packed(m, *held.drained(), parts, kind)

    return count


def _packed(level: int, hashes: np.ndarray, counts: np.ndarray, parts: int, kind: str) -> pa.RecordBatch:
    """Ascending hashes and their counts, cut by the leading bits of the hashes.

    Most occur once in a task; these need no count.
    """
    part = hashes >> np.uint64(64 - (parts.bit_length() - 1))
    first = np.flatnonzero(np.diff(part, prepend=~part[:1]) != 0)
    low = (hashes & np.uint64(0xFFFFFFFF)).astype("<u4")
    n = np.minimum(counts, np.iinfo(kind).max).astype(kind)
    once, spans = counts == 1, list(zip(first, np.append(first[1:], len(part)), strict=False))
    columns = [[x[a:b][keep[a:b]].tobytes() for a, b in spans] for x, keep in ((low, once), (low, ~once), (n, ~once))]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(spans), level, np.int32)), pa.array(part[first].astype(np.int32)),
            *[pa.array(c, pa.binary()) for c in columns],
        ],
        ["level", "part", "once", "low", "n"],
    )


def _phrases(longest: int, frequent: dict[int, np.ndarray], parts: int):
    """Tasks that count the words, and the words and phrases whose hashes are frequent, by name.

    Within a task phrases are told by the numbers of their words, not by hashes. The words of a
    group are counted under the empty phrase. A row per group and range of hashes holds its phrases,
    by line breaks, and their counts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, known = {}, _Words()
        for part in _slices(batches):
            if len(known.names) > _WORDS:
                yield from _drained(known, sums, parts)
                known = _Words()
            hashes = grams = part.hashes()
            own = sums.setdefault(part.group, [0] + [_Sums() for _ in range(longest)])
            own[0] += len(hashes)
            found = np.flatnonzero(_has(frequent[1], hashes))
            numbers, inside = np.zeros(len(hashes), np.uint64), np.zeros(len(hashes), bool)
            numbers[found], inside[found] = part.numbers(known, hashes, found), True
            own[1].add(numbers[found])
            codes = numbers
            for m in range(2, longest + 1):
                at = np.flatnonzero(inside[:-1] & inside[1:] & part.joins)
                long = _joined(grams[at], hashes[at + m - 1])
                code = codes[at] << np.uint64(_CODE_BITS) | numbers[at + m - 1]
                keep = _has(frequent[m], long)
                at, long, code = at[keep], long[keep], code[keep]
                own[m].add(code)
                inside, grams, codes = (np.zeros(len(hashes), t) for t in (bool, np.uint64, np.uint64))
                inside[at], grams[at], codes[at] = True, long, code
            if sum(s.size for c in sums.values() for s in c[1:]) > _PHRASES:
                for held in (s for c in sums.values() for s in c[1:]):
                    held.merge()
                if sum(s.size for c in sums.values() for s in c[1:]) > _PHRASES // 2:
                    yield from _drained(known, sums, parts)
        yield from _drained(known, sums, parts)

    return count


def _drained(known: _Words, sums: dict[str, list], parts: int) -> Iterator[pa.RecordBatch]:
    """The counts of a task so far, by group and range of a hash of the phrase; `sums` is emptied."""
    for group, (words, *counts) in sums.items():
        names, totals = [b""], [np.array([words], np.int64)]
        for m, held in enumerate(counts, 1):
            code, n = held.merged()
            places = [code >> np.uint64(_CODE_BITS * i) & np.uint64((1 << _CODE_BITS) - 1) for i in range(m - 1, -1, -1)]
            columns = [[known.names[i] for i in c.tolist()] for c in places]
            names += columns[0] if m == 1 else map(b" ".join, zip(*columns, strict=True))
            totals.append(n)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
        part = (hashes >> np.uint64(64 - (parts.bit_length() - 1))).astype(np.int32)
        order, n = np.argsort(part, kind="stable"), np.concatenate(totals).astype("<i8")
        part, n = part[order], n[order]
        first = np.flatnonzero(np.diff(part, prepend=-1))
        spans = list(zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=True))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([group] * len(spans), pa.string()), pa.array(part[first]),
                pa.array([b"\n".join([names[i] for i in order[a:b]]) for a, b in spans], pa.binary()),
                pa.array([n[a:b].tobytes() for a, b in spans], pa.binary()),
            ],
            ["g", "part", "phrases", "n"],
        )
    sums.clear()


def _named(table: pa.Table) -> pa.Table:
    """The phrases of a range of hashes, with the sums of their counts."""
    names = pa.chunked_array([pa.array(p.split(b"\n"), pa.binary()) for p in table["phrases"].to_pylist()])
    n = np.frombuffer(b"".join(table["n"].to_pylist()), "<i8")
    sums = pa.table({"phrase": names, "n": n}).group_by("phrase").aggregate([("n", "sum")])
    group = pa.chunked_array([table["g"].combine_chunks().slice(0, 1)]).take(pa.array(np.zeros(len(sums), np.int64)))
    return pa.table({"g": group, "phrase": sums["phrase"].cast(pa.string()), "n": sums["n_sum"]})
