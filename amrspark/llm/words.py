"""Words of a text and their hashes: small helpers used inside Spark tasks."""

from __future__ import annotations

import re

import numpy as np
import xxhash

# Every ASCII character but letters and digits separates words; all other bytes belong to words.
_TO_SPACE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

_CACHE_LIMIT = 400_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def plain_words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of letters, digits and non-ASCII characters."""
    return text.lower().translate(_TO_SPACE).split() if text else []


def spaced_words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) words between ASCII white space."""
    return text.lower().split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a limit; the hash never depends on the memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """A mixed 64-bit hash of each run of n words; empty when there are fewer."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    acc = hashes[:count].copy()
    for j in range(1, n):
        acc *= _STEP
        acc += hashes[j : j + count]
    return mix(acc)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h
