"""Words and word shingles of texts as 64-bit hashes, for tasks that work on numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

MEMO_WORDS = 200_000
MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, kept while there is room; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = h
        return h


_HASHES = WordHashes()


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of bytes other than blank and \\x09-\\x0D."""
    return text.lower().split() if text else []


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def planes(x: np.ndarray) -> bytes:
    """The bytes of numbers, all first ones first, so that like ones lie together for compression."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def numbers(raw: bytes, kind: type) -> np.ndarray:
    """The numbers of ``planes``."""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, in order; of the whole sequence where it is shorter."""
    size = min(size, len(hashes))
    if not size:
        return hashes
    n = len(hashes) - size + 1
    out = hashes[:n].copy()
    for k in range(1, size):
        out = mixed(out * MIX + hashes[k:k + n])
    return out + np.uint64(size)


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; empty without words."""
    return np.unique(window_hashes(word_hashes(words(text)), size))
