"""Token ids of knowledge chunks in files, coded by a static range asymmetric numeral system.

A token file is a folder. `table` has the frequency table that all blocks share: (id, frequency),
frequencies summing to 2^20. `blocks` has blocks in ascending (part, block) order, each with
whole chunks in ascending chunk_id order:

- part, block: place in the order; chunk_ids, n_tokens: its chunks; first: ids before the block
  in its part;
- payload: the coded chunks end to end; checkpoints: the byte where each chunk starts, so that a
  reader may start at any chunk; checksum: crc32 of the payload.

A coded chunk of n ids has L = ceil(n / 256) lanes; id i belongs to lane i mod L, so the lanes are
interleaved. Its bytes are the L final states (64 bit), the L word counts (16 bit) and the 32-bit
words, lane after lane, all little-endian. Every lane is decoded on its own. States stay within
[2^20, 2^52), so double-precision arithmetic on them is exact: a quotient of such a state and a
frequency below 2^20 is never rounded up to the next integer.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from amrspark.llm.tokens import coder, release
from amrspark.session import work_folder

SCALE_BITS, LANE_IDS = 20, 256
BLOCK_BYTES = 1 << 20
_BATCH_IDS = 1 << 20
_SCALE, _WORD = float(1 << SCALE_BITS), float(1 << 32)


def write_tokens(chunks: DataFrame, tokenizer: str, end_id: int, path: str) -> None:
    """Encode every whole text and write the ids to the token file `path`.

    Parameters
    ----------
    chunks: chunk_id (any orderable type), text; others are ignored.
    tokenizer: path of a tokenizer file; end_id closes each chunk.

    A null or empty text is one end id. Rows of a repeated chunk_id all stay, next to each other
    in no fixed order; null ids come first. An empty table gives a file without blocks.

    The texts are encoded once, without a shuffle, into a table of two byte planes and the counts
    of all ids. The counts make the shared table, the chunks are coded by it one by one, and only
    the coded bytes are sorted.
    """
    spark = chunks.sparkSession
    rows = chunks.select("chunk_id", "text")
    kind = rows.schema["chunk_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = coder(tokenizer)
        for batch in batches:
            for at, ids, bounds in tokens.encode(batch.column("text")):
                n = len(bounds) - 1
                ids = np.insert(ids, bounds[1:], end_id).astype(np.uint32)
                bounds = bounds + np.arange(n + 1)
                wide = "<u1" if ids.max(initial=0) < 1 << 16 else "<u4"
                low, high = (ids & 255).astype("<u1"), (ids >> 8).astype(wide)
                counts = np.bincount(ids)
                found = np.flatnonzero(counts)
                noted = np.concatenate((found, counts[found])).astype("<i8").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("chunk_id").slice(at, n), _cut(low, bounds), _cut(high, bounds),
                        pa.array([noted] + [None] * (n - 1), pa.binary()),
                    ],
                    ["chunk_id", "low", "high", "counts"],
                )

    planes = work_folder(spark, "token-planes")
    layout = f"chunk_id {kind}, low binary, high binary, counts binary"
    rows.mapInArrow(encode, layout).write.option("compression", "zstd").parquet(planes)
    stored = spark.read.schema(layout).parquet(planes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for noted in batch.column("counts").to_pylist():
                found, n = np.frombuffer(noted, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["id", "n"])

    noted = stored.select("counts").where(F.col("counts").isNotNull())
    counts = noted.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # At most one row per entry of the vocabulary.
    frequencies = _scaled(counts.toPandas().sort_values("id"))
    spark.createDataFrame(frequencies, "id long, frequency long").coalesce(1).write.parquet(f"{path}/table")
    table = spark.sparkContext.broadcast(_Table(frequencies["id"], frequencies["frequency"]))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    firsts = _first_ids(stored.select("chunk_id"), parts)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for ids, bounds, at in _ids(batch):
                payloads = encode_chunks(table.value, ids, bounds)
                keys = batch.column("chunk_id").slice(at, len(payloads))
                part = [0 if k is None else max(0, bisect_right(firsts, k) - 1) for k in keys.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(part, pa.int32()), pa.array(np.diff(bounds)), pa.array(payloads, pa.binary())],
                    ["chunk_id", "part", "n", "payload"],
                )

    coded = stored.select("chunk_id", "low", "high").mapInArrow(compress, f"chunk_id {kind}, part int, n long, payload binary")
    ordered = coded.repartitionById(parts, "part").sortWithinPartitions("chunk_id")
    ordered.mapInArrow(_to_blocks, _BLOCK_SCHEMA.format(kind)).write.option(
        "compression", "none"
    ).parquet(f"{path}/blocks")


def _first_ids(ids: DataFrame, parts: int) -> list:
    """The least id of each of `parts` ranges of about equal size, in order: one value each.

    They are taken from the ids alone: sorting the coded rows by range would code them twice, as
    Spark samples what it sorts.
    """
    ranged = ids.where(F.col("chunk_id").isNotNull()).repartitionByRange(parts, "chunk_id")
    least = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min("chunk_id").alias("least"))
    return sorted(r["least"] for r in least.collect())


_BLOCK_SCHEMA = (
    "part long, block long, first long, chunk_ids array<{}>, n_tokens array<long>, "
    "checkpoints array<long>, payload binary, checksum long"
)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of a token file: chunk_id, start (ids of all chunks before), n_tokens, ids.

    ids is a binary of little-endian unsigned 32-bit integers. Blocks are decoded in parallel; one
    whose checksum or lanes are wrong fails the read.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    freq = spark.read.parquet(f"{path}/table").orderBy("id").toPandas()
    table = spark.sparkContext.broadcast(_Table(freq["id"], freq["frequency"]))
    kind = blocks.schema["chunk_ids"].dataType.elementType.simpleString()
    sizes = blocks.select(
        "part", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")
    ).groupBy("part").agg(F.sum("n").alias("n"))
    # One row per part; the running sum is over parts only.
    before = sizes.select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if zlib.crc32(row["payload"]) != row["checksum"]:
                    raise ValueError(f"block {row['block']} of part {row['part']} is damaged")
                sizes = row["n_tokens"]
                ids, ends = decode_chunks(table.value, row["payload"], row["checkpoints"], sizes)
                starts = row["before"] + row["first"] + np.concatenate(([0], np.cumsum(sizes)[:-1]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["chunk_ids"], batch.schema.field("chunk_ids").type.value_type),
                        pa.array(starts.astype(np.int64)),
                        pa.array(sizes, pa.int64()),
                        _cut(ids.astype("<u4"), ends),
                    ],
                    ["chunk_id", "start", "n_tokens", "ids"],
                )

    rows = blocks.join(before, "part").select(
        "part", "block", "first", "before", "chunk_ids", "n_tokens", "checkpoints", "payload", "checksum"
    )
    return rows.mapInArrow(decode, f"chunk_id {kind}, start long, n_tokens long, ids binary")


def _cut(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary per range of `values`."""
    width = values.dtype.itemsize
    offsets = pa.py_buffer((bounds * width).astype(np.int32).tobytes())
    return pa.Array.from_buffers(
        pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(values).tobytes())]
    )


def _ids(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Runs of about a million ids: the ids, bounds of each chunk's, and the first row."""
    low, high = (_buffer(batch.column(c)) for c in ("low", "high"))
    sizes = pc.binary_length(batch.column("low")).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    if len(high) == len(low):
        ids = low | high.astype(np.int32) << 8
    else:  # some slices held ids beyond two bytes
        parts = [
            np.frombuffer(x, "<u1") | np.frombuffer(y, "<u1" if len(x) == len(y) else "<u4").astype(np.int32) << 8
            for x, y in zip(batch.column("low").to_pylist(), batch.column("high").to_pylist(), strict=True)
        ]
        ids = np.concatenate([np.empty(0, np.int32), *parts])
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + _BATCH_IDS, "right")) - 1)
        yield ids[ends[at] : ends[end]], ends[at : end + 1] - ends[at], at
        at = end


def _buffer(column: pa.Array) -> np.ndarray:
    """All bytes of a binary column, end to end."""
    start, stop = (column.offset, column.offset + len(column))
    offsets = np.frombuffer(column.buffers()[1], "<i4")
    data = column.buffers()[2]
    whole = np.frombuffer(data, "<u1") if data else np.empty(0, np.uint8)
    return whole[offsets[start] : offsets[stop]]


def _scaled(counts):
    """Counts to frequencies that sum to 2^20, none below one."""
    import pandas as pd

    n = counts["n"].to_numpy(dtype=np.int64)
    total = 1 << SCALE_BITS
    freq = np.maximum(1, n * (total / max(1, n.sum()))).astype(np.int64)
    order = np.argsort(-n, kind="stable")
    off = total - int(freq.sum()) if len(n) else 0
    if off > 0:
        freq[order[0]] += off
    while off < 0:
        take = np.minimum(freq[order] - 1, np.maximum(1, freq[order] // 64))
        take = np.minimum(take, np.maximum(0, -off - (np.cumsum(take) - take)))
        freq[order] -= take
        off += int(take.sum())
    return pd.DataFrame({"id": counts["id"].to_numpy(dtype=np.int64), "frequency": freq})


class _Table:
    """Frequencies and running sums by symbol, and the symbol of each of the 2^20 slots."""

    def __init__(self, ids, frequencies):
        self.ids = np.asarray(ids, np.int64)
        self.freq = np.asarray(frequencies, float)
        self.cum = np.cumsum(self.freq) - self.freq
        self._slots = self._index = None

    def __getstate__(self):
        return self.ids, self.freq, self.cum

    def __setstate__(self, state):
        self.ids, self.freq, self.cum = state
        self._slots = self._index = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.freq.astype(np.int64))
        return self._slots

    def symbols(self, ids: np.ndarray) -> np.ndarray:
        if self._index is None:
            self._index = np.zeros(int(self.ids.max(initial=0)) + 1, np.int32)
            self._index[self.ids] = np.arange(len(self.ids))
        return self._index[ids]


def _lanes(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of chunks: lanes each; of lanes: chunk, number in it, ids; and the first lane of each."""
    lanes = -(-sizes // LANE_IDS)
    owner = np.repeat(np.arange(len(sizes)), lanes)
    first = np.concatenate(([0], np.cumsum(lanes)))
    number = np.arange(len(owner)) - first[owner]
    length = -(-(sizes[owner] - number) // np.maximum(1, lanes[owner]))
    return lanes, owner, number, length, first


def encode_chunks(table: _Table, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Each chunk's coded bytes."""
    sizes = np.diff(bounds)
    lanes, owner, number, length, first = _lanes(sizes)
    steps = int(length.max(initial=0))
    state = np.full(len(owner), _SCALE)
    words = np.zeros((steps, len(owner)), np.uint32)
    put = np.zeros((steps, len(owner)), bool)
    freqs, cums = table.freq, table.cum
    symbols = table.symbols(ids)
    start, stride = bounds[owner] + number, lanes[owner]
    # Lanes by falling length: those that hold a step's ids are the first ones.
    order = np.argsort(-length, kind="stable")
    start, stride = start[order], stride[order]
    active = np.searchsorted(-length[order], -np.arange(steps), "left")
    for t in range(steps - 1, -1, -1):
        on = active[t]
        s = symbols[start[:on] + t * stride[:on]]
        freq, x = freqs[s], state[:on]
        full = x >= freq * _WORD
        high = np.floor(x / _WORD)
        words[t, :on] = x - high * _WORD
        put[t, :on] = full
        x = np.where(full, high, x)
        q = np.floor(x / freq)
        state[:on] = q * _SCALE + (x - q * freq) + cums[s]
    back = np.argsort(order)
    state, words, put = state[back], words[:, back], put[:, back]
    count = put.sum(axis=0).astype("<u2")
    stream = words.T[put.T].astype("<u4")
    word_ends = np.concatenate(([0], np.cumsum(count, dtype=np.int64)))
    states = state.astype("<i8")
    return [
        states[a:b].tobytes() + count[a:b].tobytes() + stream[word_ends[a] : word_ends[b]].tobytes()
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)
    ]


def decode_chunks(table: _Table, payload: bytes, checkpoints, sizes) -> tuple[np.ndarray, np.ndarray]:
    """The ids of coded chunks that start at the checkpoints, end to end, and their bounds."""
    sizes = np.asarray(sizes, np.int64)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    lanes, owner, number, length, first = _lanes(sizes)
    ends = [*checkpoints[1:], len(payload)]
    states, counts, streams = [], [], []
    for at, end, k in zip(checkpoints, ends, lanes.tolist(), strict=True):
        states.append(np.frombuffer(payload, "<i8", k, at))
        counts.append(np.frombuffer(payload, "<u2", k, at + 8 * k))
        streams.append(np.frombuffer(payload, "<u4", (end - at - 10 * k) // 4, at + 10 * k))
    stream = np.concatenate([np.empty(0, np.uint32), *streams, np.zeros(1, np.uint32)]).astype(float)
    count = np.concatenate([np.empty(0, np.uint16), *counts]).astype(np.int64)
    order = np.argsort(-length, kind="stable")
    x = np.concatenate([np.empty(0, np.int64), *states]).astype(float)[order]
    at = np.concatenate(([0], np.cumsum(count)))[:-1][order]
    until = at + count[order]
    out = np.zeros(int(bounds[-1]), np.int32)
    start, stride = (bounds[owner] + number)[order], lanes[owner][order]
    steps = int(length.max(initial=0))
    active = np.searchsorted(-length[order], -np.arange(steps), "left")
    slots, freqs, cums = table.slots, table.freq, table.cum
    for t in range(steps):
        on = active[t]
        v = x[:on]
        high = np.floor(v / _SCALE)
        slot = v - high * _SCALE
        s = slots[slot.astype(np.int64)]
        v = freqs[s] * high + slot - cums[s]
        low = v < _SCALE
        here = at[:on]
        # Past the last word nothing is taken: the place is kept inside the stream.
        x[:on] = np.where(low, v * _WORD + stream[np.minimum(here, len(stream) - 1)], v)
        here += low
        out[start[:on] + t * stride[:on]] = s
    if (at != until).any() or (x != _SCALE).any():
        raise ValueError("damaged lanes")
    return table.ids[out], bounds


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted coded chunks to blocks of about a megabyte."""
    part = TaskContext.get().partitionId()
    block, first = 0, 0
    ids, sizes, payloads, held, kind = [], [], [], 0, None

    def close() -> pa.RecordBatch:
        nonlocal block, first, ids, sizes, payloads, held
        payload = b"".join(payloads)
        checkpoints = np.concatenate(([0], np.cumsum([len(p) for p in payloads])))[:-1].tolist()
        row = pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int64()), pa.array([block], pa.int64()), pa.array([first], pa.int64()),
                pa.array([ids], pa.list_(kind)), pa.array([sizes], pa.list_(pa.int64())),
                pa.array([checkpoints], pa.list_(pa.int64())), pa.array([payload], pa.binary()),
                pa.array([zlib.crc32(payload)], pa.int64()),
            ],
            ["part", "block", "first", "chunk_ids", "n_tokens", "checkpoints", "payload", "checksum"],
        )
        block, first = block + 1, first + sum(sizes)
        ids, sizes, payloads, held = [], [], [], 0
        return row

    for batch in batches:
        kind = batch.column("chunk_id").type
        for key, n, payload in zip(*(batch.column(c).to_pylist() for c in ("chunk_id", "n", "payload")), strict=True):
            ids.append(key)
            sizes.append(n)
            payloads.append(payload)
            held += len(payload)
            if held >= BLOCK_BYTES:
                yield close()
    if ids:
        yield close()
