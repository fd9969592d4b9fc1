"""Token ids of text columns by a public tokenizer file, each distinct piece encoded once."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_PIECES = 2_000_000
_JOINED = 1_000
_SLICE_BYTES = 4 << 20
_CODERS: dict[str, TokenCoder] = {}


class TokenCoder:
    """Same ids as encoding each whole text without special tokens.

    Two kinds of tokenizer never let a token cross a single space or line end between two other
    characters: byte-level ones without a normalizer, where the space starts the next token, and
    those whose split drops all white space. Texts are cut there, and each distinct piece is
    encoded once and remembered by a 128-bit digest, up to a limit. Texts with runs of white space or special tokens,
    and all texts of other tokenizers, are encoded whole. Null is the empty text.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        parts = json.loads(self.tokenizer.to_str())
        first = parts.get("pre_tokenizer") or {}
        steps = first.get("pretokenizers") or [{}]
        self.spaced = bool(
            first.get("type") == "ByteLevel"
            and first.get("use_regex")
            and not first.get("add_prefix_space")
            and parts.get("normalizer") is None
        )
        self.bare = bool(
            first.get("type") == "Sequence"
            and steps[0].get("type") == "Split"
            and steps[0].get("behavior") == "Removed"
            and steps[0].get("invert") is True
            and r"^\s" in steps[0].get("pattern", {}).get("Regex", "")
        )
        self.special = [t["content"] for t in parts.get("added_tokens", [])]
        self.line = self.whole("\n")
        self.spaced = self.spaced and len(self.line) == 1
        self._forget()

    def _forget(self) -> None:
        # Digests of the pieces in the order of their first half, and the row of each.
        self.first, self.second = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.row = np.empty(0, np.int32)
        # By row: where its ids end in `ids`, and whether its text must be encoded whole.
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.ends = np.zeros(1, np.int64)
        self.alone = np.zeros(0, bool)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Slices (first row, ids of its texts end to end, bounds of each text's ids)."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            start = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, start + _SLICE_BYTES)))
            ids, bounds = self._slice(texts.slice(at, end - at))
            yield at, ids, bounds
            at = end
        pa.default_memory_pool().release_unused()

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not (self.spaced or self.bare):
            return _join([self.whole(t) for t in texts.to_pylist()])
        if self.spaced:
            # Each line starts a piece with its line end; the one before the first goes at the end.
            marked = pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), "")
        else:
            marked = pc.replace_substring(texts, "\n", " ")
        split = pc.split_pattern(marked, " ")
        coded = split.flatten().dictionary_encode()
        rows = self._learn(coded.dictionary.cast(pa.binary()).to_pylist())
        piece = rows[coded.indices.to_numpy(zero_copy_only=False)]
        row_ends = split.offsets.to_numpy().astype(np.int64)
        row_ends = row_ends - row_ends[0]
        size = self.ends[piece + 1] - self.ends[piece]
        placed = np.concatenate(([0], np.cumsum(size)))
        where = np.repeat((self.ends[piece] - placed[:-1]).astype(np.int32), size)
        where += np.arange(placed[-1], dtype=np.int32)
        ids, bounds = self.ids[where], placed[row_ends]
        bad = np.concatenate(([0], np.cumsum(self.alone[piece])))[row_ends]
        odd = np.diff(bad) > 0
        if not (self.spaced or odd.any()):
            return ids, bounds
        if not odd.any():
            keep = np.ones(len(ids), bool)
            keep[bounds[:-1]] = False
            return ids[keep], bounds - np.arange(len(bounds))
        own = [ids[a + self.spaced : b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for k in np.flatnonzero(odd).tolist():
            own[k] = self.whole(texts[k].as_py())
        return _join(own)

    def _learn(self, raw: list[bytes]) -> np.ndarray:
        """The row of each piece; new ones are encoded."""
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, raw)), "<u8").reshape(-1, 2)
        first, second = digests[:, 0].copy(), digests[:, 1].copy()
        rows = np.full(len(raw), -1, np.int64)
        if len(self.row):
            at = np.minimum(np.searchsorted(self.first, first), len(self.row) - 1)
            hit = (self.first[at] == first) & (self.second[at] == second)
            rows[hit] = self.row[at[hit]]
        new = np.flatnonzero(rows < 0)
        if len(self.row) + len(new) > _PIECES:
            self._forget()
            new = np.arange(len(raw))
        pieces = dict(zip(new.tolist(), (raw[k].decode() for k in new.tolist()), strict=True))
        together = "\n".join(pieces.values())
        some_special = any(s in together for s in self.special)
        heads, tails, alone = [], [], []
        if not (self.spaced or some_special):
            tails = list(pieces)
        else:
            for k, piece in pieces.items():
                head = self.spaced and piece[:1] == "\n"
                edges = piece[head : head + 1], piece[-1:]
                if self.spaced and (len(piece) == head or edges[0].isspace() or edges[1].isspace()):
                    alone.append(k)
                elif some_special and any(s in piece for s in self.special):
                    alone.append(k)
                else:
                    (heads if head else tails).append(k)
        ids, sizes, order = [np.empty(0, np.uint32)], [np.empty(0, np.int64)], []
        for group, prefix in ((heads, ""), (tails, " " if self.spaced else "")):
            for at in range(0, len(group), _JOINED):
                some = group[at : at + _JOINED]
                found, size = self._ids_of([prefix + pieces[k] for k in some], prefix)
                ids.append(found)
                sizes.append(size)
                order += some
        mark = self.line if self.spaced else np.empty(0, np.uint32)
        ids.append(np.tile(mark, len(alone)))
        sizes.append(np.full(len(alone), len(mark)))
        self._add(np.concatenate(ids), np.concatenate(sizes), len(alone))
        order = np.array(order + alone, np.int64)
        rows[order] = np.arange(len(self.alone) - len(order), len(self.alone))
        order = order[np.argsort(first[order], kind="stable")]
        at = np.searchsorted(self.first, first[order])
        self.first = np.insert(self.first, at, first[order])
        self.second = np.insert(self.second, at, second[order])
        self.row = np.insert(self.row, at, rows[order])
        return rows

    def _add(self, ids: np.ndarray, sizes: np.ndarray, alone: int) -> None:
        """Rows for new pieces; the last `alone` of them must not stand alone."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty(max(len(self.ids), len(ids)), np.uint32)))
        self.ids[self.used : self.used + len(ids)] = ids
        self.ends = np.concatenate((self.ends, self.used + np.cumsum(sizes, dtype=np.int64)))
        self.used += len(ids)
        flags = np.zeros(len(sizes), bool)
        flags[len(sizes) - alone :] = True
        self.alone = np.concatenate((self.alone, flags))

    def _ids_of(self, pieces: list[str], prefix: str) -> tuple[np.ndarray, np.ndarray]:
        """Encode the pieces as the lines of one text: ids without line ends, ids per piece.

        Pieces that start with a line end of their own keep it.
        """
        if not self.spaced:
            found = self.tokenizer.encode("\n".join(pieces), add_special_tokens=False)
            ids = np.array(found.ids, np.uint32)
            starts = np.fromiter((s for s, _ in found.offsets), np.int64, len(ids))
            ends = np.searchsorted(starts, np.cumsum([len(p) + 1 for p in pieces]))
            return ids, np.diff(ends, prepend=0)
        text = "\n".join(pieces) if prefix else "".join(pieces)
        found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
        ids = np.array(found.ids, np.uint32)
        marks = np.flatnonzero(ids == self.line[0])
        if prefix:
            sizes = np.diff(np.concatenate(([-1], marks, [len(ids)]))) - 1
            return np.delete(ids, marks), sizes
        return ids, np.diff(np.concatenate((marks, [len(ids)])))


def _join(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    return np.concatenate([np.empty(0, np.uint32), *parts]), bounds


def coder(path: str) -> TokenCoder:
    """The coder of a file, kept by the worker process with its memory of pieces."""
    if path not in _CODERS:
        _CODERS[path] = TokenCoder(path)
    return _CODERS[path]


def release() -> None:
    """Give the memory of all coders back, in worker processes that turn to other work."""
    _CODERS.clear()
