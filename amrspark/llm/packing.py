"""Token sequences of equal length from knowledge chunks of any length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amrspark.llm.tokens import coder

MAX_TOKENS, MAX_SEGMENTS, POOL = 2048, 256, 1024
_FIELDS = (
    "start long, length long, ids_crc32 long, chunk_tokens long, loss_tokens long, "
    "sequence_id long, offset long"
)


def pack_chunks(
    chunks: DataFrame,
    tokenizer: str,
    end_id: int,
    *,
    prompt: str | None = None,
    max_tokens: int = MAX_TOKENS,
    max_segments: int = MAX_SEGMENTS,
    max_loss: int = MAX_TOKENS,
    pool: int = POOL,
    with_ids: bool = False,
) -> DataFrame:
    """Place every token of every chunk into sequences under three limits at once.

    Parameters
    ----------
    chunks: chunk_id, text and, if named, the prompt column; others are ignored.
    tokenizer: path of a tokenizer file; end_id closes each chunk.
    prompt: a text column, as gene_family, whose ids come before the text's and bear no loss:
        instruction data. By default all ids bear loss.
    max_tokens: limit of a sequence, a power of two; max_segments: pieces in it; max_loss: its
        loss-bearing tokens.
    pool: chunks that wait in a task for a place, the bound of its memory.

    Returns one row per piece: chunk_id, start and length (in its chunk's ids), ids_crc32 (of its
    little-endian 32-bit ids), chunk_tokens, loss_tokens (in the piece), sequence_id, offset (in
    its sequence); with `with_ids` also ids.

    Vector bin packing: the open sequence takes the waiting chunk that fits and has the largest
    dot product of its demand (tokens, segments, loss) with what the sequence has left, each as a
    share of its limit. When none fits, one is cut to what is left. A sequence that ends short of
    max_tokens, by a limit or at the end of a task, is dealt into sequences whose lengths are
    powers of two, so none needs padding. Chunks are packed within their partition, without a
    shuffle; sequence ids are unique and do not depend on retries.

    A null or empty text is one end id. Repeated rows are placed each. An empty table has no rows.
    """
    if max_tokens < 1 or max_tokens & (max_tokens - 1) or max_segments < 1 or max_loss < 1:
        raise ValueError("max_tokens must be a power of two, the other limits positive")
    given = chunks.select(
        "chunk_id", "text", (F.col(prompt) if prompt else F.lit("")).cast("string").alias("prompt")
    )
    kind = given.schema["chunk_id"].dataType.simpleString()
    limits = (max_tokens, max_segments, max_loss)
    extra = ", ids array<long>" if with_ids else ""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(limits, pool, with_ids, TaskContext.get().partitionId())
        for batch in batches:
            yield from packer.add(batch, coder(tokenizer), end_id, prompt is not None)
        yield from packer.finish()

    return given.mapInArrow(pack, f"chunk_id {kind}, {_FIELDS}{extra}")


class _Packer:
    """The waiting chunks of one task and the sequence it fills."""

    def __init__(self, limits, pool: int, with_ids: bool, partition: int):
        self.limits, self.pool, self.with_ids = limits, pool, with_ids
        self.next_id = partition << 32
        self.need = np.zeros((3, 2 * pool))  # tokens, segments and loss of each waiting chunk
        self.free = list(range(2 * pool))[::-1]
        self.items: list = [None] * (2 * pool)  # id, ids, place of the first one, loss-free ids
        self.bin: list[tuple[tuple, int, int]] = []
        self.left = list(limits)
        self.out: list[tuple] = []
        self.keys = None

    def add(self, batch, tokens, end_id: int, prompted: bool) -> Iterator[pa.RecordBatch]:
        keys = batch.column("chunk_id")
        self.keys = keys.type
        heads = self._prompts(batch.column("prompt"), tokens) if prompted else None
        for at, ids, bounds in tokens.encode(batch.column("text")):
            names = keys.slice(at, len(bounds) - 1).to_pylist()
            for k, name in enumerate(names):
                own = [ids[bounds[k] : bounds[k + 1]], np.array([end_id], np.uint32)]
                free = 0
                if heads:
                    own.insert(0, heads[at + k])
                    free = len(heads[at + k])
                self._wait((name, np.concatenate(own), 0, free))
                while len(self.free) < self.pool:
                    self._place()
            if len(self.out) > 20_000:
                yield self._batch()
        if self.out:
            yield self._batch()

    def finish(self) -> Iterator[pa.RecordBatch]:
        while len(self.free) < len(self.items):
            self._place()
        self._close()
        if self.out:
            yield self._batch()

    @staticmethod
    def _prompts(column, tokens) -> list[np.ndarray]:
        return [ids[a:b] for _, ids, s in tokens.encode(column) for a, b in zip(s[:-1], s[1:], strict=True)]

    def _wait(self, item) -> None:
        _, ids, at, free = item
        slot = self.free.pop()
        self.items[slot] = item
        left = len(ids) - at
        self.need[:, slot] = (left, 1, left - max(0, free - at))

    def _place(self) -> None:
        """Give the open sequence one piece of a waiting chunk."""
        tokens, segments, loss = self.need
        gain = np.array([r / c**2 for r, c in zip(self.left, self.limits, strict=True)]) @ self.need
        over = (tokens > self.left[0]) | (segments > self.left[1]) | (loss > self.left[2])
        slot = int(np.argmax(np.where(over, 0, gain)))
        if over[slot] or not gain[slot]:  # none fits: cut one
            slot = int(np.argmax(gain))
        key, ids, at, free = item = self.items[slot]
        size = min(len(ids) - at, self.left[0], max(0, free - at) + self.left[2])
        self.bin.append((item, at, size))
        for d, used in enumerate((size, 1, _loss(item, at, size))):
            self.left[d] -= used
        self.items[slot] = None
        self.need[:, slot] = 0
        self.free.append(slot)
        if at + size < len(ids):
            self._wait((key, ids, at + size, free))
        if min(self.left) <= 0:
            self._close()

    def _close(self) -> None:
        total = sum(s for _, _, s in self.bin)
        pieces, self.bin, self.left = self.bin[::-1], [], list(self.limits)
        while total:
            size = 1 << (total.bit_length() - 1)
            offset = 0
            while offset < size:
                item, at, n = pieces.pop()
                if n > size - offset:
                    pieces.append((item, at + size - offset, n - (size - offset)))
                    n = size - offset
                part = item[1][at : at + n]
                self.out.append((
                    item[0], at, n, zlib.crc32(part.astype("<u4").tobytes()), len(item[1]),
                    _loss(item, at, n), self.next_id, offset, *([part] if self.with_ids else []),
                ))
                offset += n
            self.next_id += 1
            total -= size

    def _batch(self) -> pa.RecordBatch:
        names = ["chunk_id", *(f.split()[0] for f in _FIELDS.split(", ")), *["ids"] * self.with_ids]
        kinds = [self.keys, *[pa.int64()] * 7, pa.list_(pa.int64())]
        columns = zip(*self.out, strict=True)
        self.out = []
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names
        )


def _loss(item, at: int, size: int) -> int:
    return size - min(size, max(0, item[3] - at))
