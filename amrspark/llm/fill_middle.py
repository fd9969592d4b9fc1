"""Fill-in-the-middle training texts of knowledge chunks, over seekable compressed frames.

A frame table is a Parquet folder with one row per chunk row:

- chunk_id; n_units, n_chars: units and code points of the whole text; marked: whether the text
  holds one of the marks;
- units, chars, ends: per frame, the units and code points up to and with it, and the byte of
  `frames` where it ends;
- frames: independent zstandard frames end to end, each with whole units.

A unit is a run of ASCII letters or one other code point. Any frame can be decompressed alone, so a
place given in units is found by a search in `units` and one decompression.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

#: What opens the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = MARKS = (b"<P>", b"<S>", b"<M>")
_MARK = re.compile(b"|".join(MARKS))
FRAME_UNITS, LEVEL = 8192, 3
_ROWS_BYTES = 8 << 20
#: The parts of an output in its order: 0 prefix, 1 middle, 2 suffix.
_ORDER = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}


def write_frames(chunks: DataFrame, path: str, *, frame_units: int = FRAME_UNITS) -> None:
    """Store every whole text of `chunks` (chunk_id, text; others are ignored) as frames in `path`.

    A null text is stored as an empty one, which has no frames. Rows of a repeated chunk_id all
    stay; a null chunk_id is kept. An empty table gives an empty folder of the same layout. The
    texts are not shuffled.
    """
    rows = chunks.select("chunk_id", "text")
    kind = rows.schema["chunk_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        for batch in batches:
            held, size, first = [], 0, 0
            texts = batch.column("text").cast(pa.binary())
            for at in range(len(texts)):
                text = texts[at].as_py() or b""
                row = _framed(text, press, frame_units)
                held.append(row)
                size += len(row[-1])
                if size >= _ROWS_BYTES:
                    yield _table(batch.column("chunk_id").slice(first, len(held)), held)
                    held, size, first = [], 0, at + 1
            if held:
                yield _table(batch.column("chunk_id").slice(first, len(held)), held)

    rows.mapInArrow(pack, _LAYOUT.format(kind)).write.option("compression", "none").parquet(path)


_LAYOUT = (
    "chunk_id {}, n_units long, n_chars long, marked boolean, units array<long>, chars array<long>, "
    "ends array<long>, frames binary"
)


def _table(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.bool_(), *[pa.list_(pa.int64())] * 3, pa.binary()]
    columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    names = ["chunk_id", "n_units", "n_chars", "marked", "units", "chars", "ends", "frames"]
    return pa.RecordBatch.from_arrays([ids, *columns], names)


def starts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each byte, whether a unit and whether a code point begins there."""
    raw = np.frombuffer(text, np.uint8)
    folded = raw | 32
    letter = (folded >= 97) & (folded <= 122)
    char = (raw & 0xC0) != 0x80
    unit = char.copy()
    unit[1:] &= ~(letter[1:] & letter[:-1])
    return unit, char


def _framed(text: bytes, press: zstandard.ZstdCompressor, frame_units: int) -> tuple:
    if not text:
        return 0, 0, False, [], [], [], b""
    unit, char = starts(text)
    begins = np.flatnonzero(unit)
    n = len(begins)
    cuts = [*begins[::frame_units].tolist(), len(text)]
    # A unit never begins inside a code point, so the sums up to a cut count whole ones.
    chars = np.add.reduceat(char, cuts[:-1], dtype=np.int64).cumsum().tolist()
    frames = [press.compress(text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    units = [*range(frame_units, n, frame_units), n]
    ends = np.cumsum([len(f) for f in frames]).tolist()
    return n, chars[-1], any(m in text for m in MARKS), units, chars, ends, b"".join(frames)


@dataclass
class Framed:
    """One stored text: frames are decompressed one at a time, when they are asked for."""

    units: list[int]
    chars: list[int]
    ends: list[int]
    frames: bytes

    def frame(self, i: int) -> bytes:
        begin = self.ends[i - 1] if i else 0
        return zstandard.ZstdDecompressor().decompress(self.frames[begin : self.ends[i]])

    def place(self, unit: int) -> tuple[int, int, int]:
        """The frame, the byte in it, and the code points of the text before `unit` units end."""
        if unit == 0:
            return 0, 0, 0
        i = bisect_left(self.units, unit)
        before = (self.units[i - 1], self.chars[i - 1]) if i else (0, 0)
        if self.units[i] == unit:
            return i + 1, 0, self.chars[i]
        unit_starts, char_starts = starts(self.frame(i))
        byte = int(np.flatnonzero(unit_starts)[unit - before[0]])
        return i, byte, before[1] + int(np.count_nonzero(char_starts[:byte]))

    def stream(self, begin: tuple[int, int, int], end: tuple[int, int, int]) -> Iterator[bytes]:
        """The bytes between two places, frame by frame."""
        for i in range(begin[0], min(end[0] + 1, len(self.ends))):
            low = begin[1] if i == begin[0] else 0
            high = end[1] if i == end[0] else None
            if high == 0:
                return
            yield self.frame(i)[low:high]


def draws(chunk_id, seed: str = "1") -> tuple[int, int, int, int]:
    """Four 32-bit draws that depend on the seed and the decimal or text form of the id only."""
    digest = hashlib.sha256(f"{seed}:{'' if chunk_id is None else chunk_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4))


def output_stream(text: Framed, form: str, cuts: list[tuple[int, int, int]]) -> Iterator[bytes]:
    """The output in pieces. `cuts` are the four places that bound prefix, middle and suffix."""
    if form == "plain":
        yield from text.stream(cuts[0], cuts[3])
        return
    for mark, part in _ORDER[form]:
        yield mark
        yield from text.stream(cuts[part], cuts[part + 1])


def sections(pieces: Iterable[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(mark, bytes): an output cut at its marks, wherever its pieces end. Marks open sections."""
    mark, rest = b"", b""
    for piece in pieces:
        rest, at = rest + piece, 0
        for found in _MARK.finditer(rest):
            yield mark, rest[at : found.start()]
            mark, at = found.group(), found.end()
        # The last two bytes may begin a mark that the next piece ends.
        keep = max(at, len(rest) - 2)
        yield mark, rest[at:keep]
        rest = rest[keep:]
    yield mark, rest


def restore(pieces, form: str) -> Iterator[bytes]:
    """The text that an output was made of, in pieces. `pieces()` gives the output's from the start.

    Only one piece is held: each part is taken in a pass of its own, in the order of the text.
    """
    if form == "plain":
        yield from pieces()
        return
    for wanted in (PREFIX, MIDDLE, SUFFIX):
        for mark, part in sections(pieces()):
            if mark == wanted:
                yield part


def fill_in_middle(
    spark: SparkSession,
    path: str,
    *,
    seed: str = "1",
    plain_percent: int = 10,
    spm_percent: int = 20,
    outputs: bool = True,
) -> DataFrame:
    """Every text of the frame table `path` in its fill-in-the-middle form.

    Parameters
    ----------
    seed: goes into the draws of each chunk, which else depend on its id alone.
    plain_percent: share of chunks left as they are; spm_percent: share of the others with the
        suffix first.
    outputs: whether to return the output texts; digests and places are computed in either case.

    Returns per stored row: chunk_id, n_units, form, prefix_chars, middle_chars, output_sha256,
    restored_sha256, and output if asked for.

    The prefix ends after the lesser of two drawn numbers of units and the middle after the
    greater; both lie between none and all of the units. form is `psm` (`<P>` prefix `<S>` suffix
    `<M>` middle), `spm` (`<S>` suffix `<P>` prefix `<M>` middle) or `plain` (the text itself, with
    null prefix_chars and middle_chars), which empty texts and texts with a mark always are.
    A null chunk_id draws as an empty id; rows of a repeated chunk_id draw alike. An empty table
    gives no rows.

    Only the frames that a cut falls into are decompressed to find it. The digests are fed frame by
    frame: the output's from the parts in their order, the restored text's from the sections of
    the output, cut at its marks.
    """
    stored = spark.read.parquet(path)
    kind = stored.schema["chunk_id"].dataType.simpleString()
    names = ["n_units", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    wanted = len(names) if outputs else len(names) - 1

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, size, rows = 0, 0, []
            for at, row in enumerate(_rows(batch)):
                rows.append(_transformed(*row, seed, plain_percent, spm_percent, outputs))
                size += len(rows[-1][-1] or b"")
                if size >= _ROWS_BYTES or at + 1 == batch.num_rows:
                    columns = [
                        pa.array(list(c), k) if k != pa.string() else pa.array(list(c), pa.binary()).cast(k)
                        for c, k in zip(list(zip(*rows, strict=True))[:wanted], kinds[:wanted], strict=True)
                    ]
                    ids = batch.column("chunk_id").slice(first, len(rows))
                    yield pa.RecordBatch.from_arrays([ids, *columns], ["chunk_id", *names[:wanted]])
                    first, size, rows = at + 1, 0, []

    layout = (
        f"chunk_id {kind}, n_units long, form string, prefix_chars long, middle_chars long, "
        "output_sha256 string, restored_sha256 string"
    )
    return stored.select("chunk_id", "n_units", "marked", "units", "chars", "ends", "frames").mapInArrow(
        transform, layout + (", output string" if outputs else "")
    )


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """One row at a time: frames of other rows stay in the batch's buffers."""
    columns = [batch.column(c) for c in ("chunk_id", "n_units", "marked", "units", "chars", "ends", "frames")]
    for at in range(batch.num_rows):
        yield tuple(c[at].as_py() for c in columns)


def _transformed(key, n, marked, units, chars, ends, frames, seed, plain_percent, spm_percent, outputs) -> tuple:
    text = Framed(units, chars, ends, frames)
    h1, h2, h3, h4 = draws(key, seed)
    whole = (len(ends), 0, chars[-1] if chars else 0)
    if n == 0 or marked or h3 % 100 >= 100 - plain_percent:
        form, cuts = "plain", [(0, 0, 0), None, None, whole]
    else:
        form = "spm" if h4 % 100 < spm_percent else "psm"
        one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
        cuts = [(0, 0, 0), text.place(one), text.place(two), whole]
    given, back, kept = hashlib.sha256(), hashlib.sha256(), []
    for piece in output_stream(text, form, cuts):
        given.update(piece)
        if outputs:
            kept.append(piece)
    for piece in restore(lambda: output_stream(text, form, cuts), form):
        back.update(piece)
    prefix = middle = None
    if form != "plain":
        prefix, middle = cuts[1][2], cuts[2][2] - cuts[1][2]
    digests = (given.hexdigest().encode(), back.hexdigest().encode())
    return n, form.encode(), prefix, middle, *digests, b"".join(kept) if outputs else None
