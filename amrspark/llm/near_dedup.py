"""Near-duplicate knowledge chunks by b-bit minwise signatures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amrspark.llm.components import connected
from amrspark.llm.store import store
from amrspark.llm.words import WordHashes, mix, rolling, spaced_words

HASHES, BITS, ROWS_PER_BAND, STAR_ROUNDS = 128, 4, 4, 2
FINE_HASHES, FINE_BITS = 1024, 2
# Over five standard deviations of the estimates by 128 4-bit and by 1,024 2-bit minima.
SLACK, FINE_SLACK = 0.2, 0.08
#: The least 32-bit shingle hashes kept per class; texts of fewer shingles keep their whole set. Five
# standard deviations of the share that so many tell of two larger sets.
LEAST, LEAST_SLACK = 2048, 0.045
_BLOCK = 8192
_CHUNK = 4096
_SEEDS = np.random.default_rng(20240229).integers(1, 1 << 63, FINE_HASHES, np.uint64) | np.uint64(1)


def group_chunks(
    chunks: DataFrame, *, words: int = 5, percent: int = 80
) -> DataFrame:
    """Groups of chunks whose texts are nearly the same.

    Parameters
    ----------
    chunks: chunk_id (any orderable type), text; others are ignored.
    words: words of a shingle. A text of fewer words, but not none, is one shingle.
    percent: chunks are linked if 100 * common shingles >= percent * all shingles of the two.

    Returns one row per chunk row: chunk_id, n_shingles, component_id (the smallest chunk_id
    reachable over links, its own included), kept (chunk_id = component_id).

    1. One pass over the texts gives each chunk its set size, a 128-bit digest of the set, 128
       minima reduced to their low 4 bits, and 32 band keys of 4 whole minima. Two sets at the
       limit of 80 % share no band with a probability of (1 - 0.8^4)^32 = 5e-8.
    2. Chunks of equal sets become one class with the smallest id.
    3. In a bucket of equal band keys, every class is paired with the bucket's pivot only, and
       not with each other. The share of equal 4-bit minima, corrected for the 1/16 that agree by
       chance, estimates the similarity; pairs below the limit less 0.2 (over five standard
       deviations) go. The others are confirmed on the full shingle sets of their texts.
    4. A class is confirmed with its most similar pivot first. Classes still apart in a bucket
       meet a second pivot, then all others of the bucket, block by block: a task compares the
       signatures of two blocks, 128 4-bit and 1,024 2-bit minima, then the sets of shingle hashes
       of what passes both estimates (of sets over 2,048, the least hashes), and emits only the
       pairs left, each in the first bucket the two share.

    Chunks without words have no shingles and are linked with nothing. A null chunk_id forms a
    group of its own. Each row of a repeated chunk_id gets a result by its own text; where such
    texts differ, links of the id are confirmed on the smallest. An empty table gives no rows.
    """
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    base = chunks.select("chunk_id", "text")
    signed = store(
        base.select("chunk_id", "text").mapInArrow(
            _signer(words),
            f"chunk_id {kind}, n_shingles long, set_key binary, signature binary, bands array<long>",
        ),
        "signed",
    )
    has = signed.where((F.col("n_shingles") > 0) & F.col("chunk_id").isNotNull())
    classes = store(
        has.groupBy("set_key").agg(
            F.min("chunk_id").alias("a"),
            F.min("n_shingles").alias("n"),
            F.min("signature").alias("signature"),
            F.min("bands").alias("bands"),
        ),
        "classes",
    )
    label = _groups(base, classes, kind, words, percent)
    of_set = classes.select("set_key", "a").join(label, "a", "left").select(
        "set_key", F.coalesce("c", "a").alias("c")
    )
    found = signed.select(
        "chunk_id", "n_shingles",
        F.when((F.col("n_shingles") > 0) & F.col("chunk_id").isNotNull(), F.col("set_key")).alias("set_key"),
    ).join(of_set, "set_key", "left")
    group = F.coalesce("c", "chunk_id")
    return found.select(
        "chunk_id", "n_shingles", group.alias("component_id"),
        F.coalesce(F.col("chunk_id") == group, F.lit(True)).alias("kept"),
    )


def _groups(base, classes, kind: str, words: int, percent: int) -> DataFrame:
    """(a, c): the linked classes and the smallest id of the group of each."""
    keyed = store(
        classes.select(F.explode("bands").alias("key"))
        .groupBy("key")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > 1)
        .select("key"),
        "shared-keys",
    )
    slots = store(
        classes.select(F.explode("bands").alias("key"), "a").join(keyed, "key"), "buckets"
    )
    # The only shuffle of texts: those of classes that share a bucket.
    asked = slots.select(F.col("a").alias("chunk_id")).distinct()
    texts = store(
        base.join(asked, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.min("text").alias("text")),
        "texts",
    )
    facts = classes.select("a", "n", "signature")
    limit = percent / 100
    links, label, live = None, None, slots
    for turn in range(STAR_ROUNDS + 1):
        if label is not None:
            live = store(_apart(slots, label), "apart")
            if live.isEmpty():
                break
        if turn < STAR_ROUNDS:
            likely = _stars(live, label, facts, kind, limit - SLACK, percent, turn)
        else:
            likely = _blocks(live, classes, texts, kind, words, limit, percent)
        found = _confirmed(texts, store(likely, "likely"), kind, words, percent)
        links = found if links is None else links.unionAll(found)
        label = store(connected(links).select(F.col("id").alias("a"), F.col("component").alias("c")), "labels")
    return label


def _stars(live, label, facts, kind: str, limit: float, percent: int, turn: int) -> DataFrame:
    """Every class with the most similar of the pivots of its buckets."""
    order = F.struct(F.xxhash64("a", "key", F.lit(turn)).alias("h"), F.col("a"))
    pivots = live.groupBy("key").agg(F.min(order)["a"].alias("b"))
    star = live.join(pivots, "key").where(F.col("a") != F.col("b"))
    if label is not None:
        star = star.join(label.select(F.col("a").alias("b"), F.col("c").alias("cb")), "b", "left").where(
            F.col("c") != F.coalesce("cb", "b")
        )
    left = facts.select("a", F.col("n").alias("na"), F.col("signature").alias("sa"))
    right = facts.select(F.col("a").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("sb"))
    close = star.select("a", "b").distinct().join(left, "a").join(right, "b").where(
        F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    )
    near = close.select("a", "b", "sa", "sb").mapInArrow(_estimated(limit), f"a {kind}, b {kind}, s double")
    return near.groupBy("a").agg(F.max_by("b", "s").alias("b"))


def _apart(slots: DataFrame, label: DataFrame) -> DataFrame:
    """Bucket rows (key, a, c) of the buckets that hold classes of several groups."""
    named = slots.select("key", "a").join(label, "a", "left").select(
        "key", "a", F.coalesce("c", "a").alias("c")
    )
    split = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi")
    return named.join(split.select("key"), "key")


def _blocks(live, classes, texts, kind: str, words: int, limit: float, percent: int) -> DataFrame:
    """Pairs of different groups of a bucket that pass both estimates, block by block.

    A bucket of n classes is cut into n/8192 blocks by a hash; each pair of blocks is one group
    of at most about 16,384 rows, so no task holds a bucket.
    """
    wanted = live.select(F.col("a").alias("chunk_id")).distinct()
    fine = store(
        texts.join(wanted, "chunk_id", "left_semi").mapInArrow(_fine_signer(words), f"a {kind}, fine binary, least binary"),
        "fine",
    )
    facts = classes.select("a", "n", "signature", "bands").join(fine, "a")
    sizes = live.groupBy("key").agg(F.ceil(F.count("*") / _BLOCK).cast("int").alias("k"))
    rows = live.join(sizes, "key").select(
        "key", "a", "c", "k", F.pmod(F.xxhash64("a"), F.col("k")).cast("int").alias("i")
    )
    spread = rows.select(
        "key", "a", "c", "i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j")
    ).select("key", "a", "c", "i", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"))
    full = spread.join(facts, "a").select("key", "x", "y", "i", "a", "c", "n", "signature", "bands", "fine", "least")

    def compare(table: pa.Table) -> pa.Table:
        ids, groups = table["a"].to_pylist(), table["c"].to_pylist()
        group = np.unique(np.array([str(g) for g in groups]), return_inverse=True)[1]
        sizes = table["n"].to_numpy()
        coarse, fine = _unpack(table["signature"]), _unpack(table["fine"])
        bands = np.array(table["bands"].to_pylist(), np.int64).reshape(len(ids), -1)
        least = [np.frombuffer(v, np.uint32) for v in table["least"].to_pylist()]
        side = table["i"].to_numpy()
        key, x, y = (table[name][0].as_py() for name in ("key", "x", "y"))
        left, right = np.flatnonzero(side == x), np.flatnonzero(side == y)
        lo, hi = [], []
        for p in left.tolist():
            others = right[right > p] if x == y else right
            others = others[group[others] != group[p]]
            near = np.minimum(sizes[p], sizes[others]) * 100 >= np.maximum(sizes[p], sizes[others]) * percent
            others = others[near]
            others = others[_similarity(coarse[p], coarse[others], BITS) >= limit - SLACK]
            others = others[_similarity(fine[p], fine[others], FINE_BITS) >= limit - FINE_SLACK]
            if len(others):
                first = np.argmax(bands[others] == bands[p], axis=1)
                for q in others[bands[p][first] == key].tolist():
                    if _may_link(least[p], sizes[p], least[q], sizes[q], percent):
                        lo.append(min(ids[p], ids[q]))
                        hi.append(max(ids[p], ids[q]))
        kinds = table.schema.field("a").type
        return pa.table({"a": pa.array(lo, kinds), "b": pa.array(hi, kinds)})

    return full.groupBy("key", "x", "y").applyInArrow(compare, f"a {kind}, b {kind}").distinct()


def _signer(words: int) -> Callable:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        bands = HASHES // ROWS_PER_BAND
        mark = mix(np.arange(bands, dtype=np.uint64) + np.uint64(1))
        for batch in batches:
            sizes, keys, signatures, band_keys = [], [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                unique = np.unique(shingle_hashes(hashes, spaced_words(text), words))
                sizes.append(len(unique))
                if not len(unique):
                    keys.append(b"")
                    signatures.append(b"")
                    band_keys.append(np.empty(0, np.int64))
                    continue
                low = _minima(unique, HASHES)
                keys.append(xxhash.xxh3_128_digest(unique.tobytes()))
                nibble = (low & np.uint64(15)).astype(np.uint8)
                signatures.append((nibble[::2] | (nibble[1::2] << 4)).tobytes())
                key = mark.copy()
                for row in low.reshape(bands, ROWS_PER_BAND).T:
                    key = mix(key ^ row)
                band_keys.append(key.view(np.int64))
            flat = np.concatenate([np.empty(0, np.int64), *band_keys])
            ends = np.concatenate(([0], np.cumsum([len(b) for b in band_keys]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("chunk_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(signatures, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                ],
                ["chunk_id", "n_shingles", "set_key", "signature", "bands"],
            )

    return sign


def _fine_signer(words: int) -> Callable:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            fine, least = [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                unique = np.unique(shingle_hashes(hashes, spaced_words(text), words))
                two = (_minima(unique, FINE_HASHES) & np.uint64(3)).astype(np.uint8).reshape(-1, 4)
                fine.append((two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6).tobytes())
                least.append(np.unique((mix(unique) >> np.uint64(32)).astype(np.uint32))[:LEAST].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("chunk_id"), pa.array(fine, pa.binary()), pa.array(least, pa.binary())],
                ["a", "fine", "least"],
            )

    return sign


def _may_link(x: np.ndarray, nx: int, y: np.ndarray, ny: int, percent: int) -> bool:
    """Whether two sets, of `nx` and `ny` shingles with the least hashes `x` and `y`, can be linked.

    Whole sets lose no pair: shingles that share a hash are added to what the two have in common.
    """
    if max(nx, ny) <= LEAST:
        common = len(np.intersect1d(x, y, assume_unique=True)) + int(nx) - len(x)
        return 100 * common >= percent * (int(nx) + int(ny) - common)
    both = np.union1d(x, y)[:LEAST]
    common = np.intersect1d(x, y, assume_unique=True)
    return np.isin(both, common, assume_unique=True).mean() >= percent / 100 - LEAST_SLACK


def _minima(unique: np.ndarray, hashes: int) -> np.ndarray:
    """The least value of each hash function over a set, with its bits mixed."""
    low = np.full(hashes, ~np.uint64(0))
    step = max(1, _CHUNK * HASHES // hashes)
    for at in range(0, len(unique), step):
        part = unique[at : at + step, None] * _SEEDS[:hashes]
        np.minimum(low, part.min(axis=0), out=low)
    return mix(low)


def shingle_hashes(hashes: WordHashes, found: list[bytes], words: int) -> np.ndarray:
    """A hash per run of `words` words; fewer words are one run, none give none."""
    return rolling(hashes.of(found), min(words, len(found))) if found else np.empty(0, np.uint64)


def _unpack(signatures) -> np.ndarray:
    rows = len(signatures)
    return np.frombuffer(b"".join(signatures.to_pylist()), np.uint8).reshape(rows, -1)


def _similarity(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Similarity estimated from the equal fields of `bits` bits, less those equal by chance."""
    off = a ^ b
    fields = 8 // bits
    equal = _ZERO_FIELDS[bits][off].sum(axis=-1, dtype=np.int64)
    chance = 1 / (1 << bits)
    return (equal / (fields * off.shape[-1]) - chance) / (1 - chance)


#: For each byte, how many of its fields of 4 or 2 bits are zero.
_ZERO_FIELDS = {
    bits: np.array(
        [sum((v >> at) & ((1 << bits) - 1) == 0 for at in range(0, 8, bits)) for v in range(256)], np.uint8
    )
    for bits in (4, 2)
}


def _estimated(limit: float) -> Callable:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = _similarity(_unpack(batch.column("sa")), _unpack(batch.column("sb")), BITS)
                out = pa.RecordBatch.from_arrays(
                    [batch.column("a"), batch.column("b"), pa.array(s, pa.float64())], ["a", "b", "s"]
                )
                yield out.filter(pa.array(s >= limit))

    return keep


def _confirmed(texts: DataFrame, pairs: DataFrame, kind: str, words: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets are as similar as asked."""
    full = (
        pairs.join(texts.select(F.col("chunk_id").alias("a"), F.col("text").alias("ta")), "a")
        .join(texts.select(F.col("chunk_id").alias("b"), F.col("text").alias("tb")), "b")
        .select("a", "b", "ta", "tb")
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            known, old = None, None
            for one, two in zip(
                batch.column("ta").cast(pa.binary()).to_pylist(),
                batch.column("tb").cast(pa.binary()).to_pylist(),
                strict=True,
            ):
                if two != old:
                    known, old = shingles(two, words), two
                x = shingles(one, words)
                common = len(x & known)
                ok.append(100 * common >= percent * (len(x) + len(known) - common) and common > 0)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return store(full.mapInArrow(check, f"a {kind}, b {kind}"), "confirmed")


def shingles(text: bytes | None, words: int) -> set:
    """The shingle set itself."""
    found = spaced_words(text)
    n = min(words, len(found))
    return set(zip(*(found[i:] for i in range(n)), strict=False)) if n else set()
