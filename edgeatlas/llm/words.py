"""Vectorised words and windows over Arrow string columns.

A word is a maximal run of bytes other than space and 0x09-0x0D (the UTF-8 bytes of other characters never
collide with these). Hashes are 64-bit: a random value per byte, summed with powers of an odd base modulo 2**64 through
one prefix sum, then mixed. Windows hash the same way over the word hashes. A second family, with values and bases of its own,
makes 128 bits where a hash has to stand for the words themselves. Temporary arrays take some 60 bytes per byte of the block at
hand, which is ``BLOCK`` bytes or the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; bounds the temporary arrays whatever the batch holds.
BLOCK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of letters and digits; whatever is not ASCII counts as a letter.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Both families of hashes: byte values, base of words, base of windows.
_TABLES = [np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed in (20240607, 20250911)]
_BASES = ((0x9E3779B97F4A7C15, 0xD1342543DE82EF95), (0xC2B2AE3D27D4EB4F, 0xDA942042E4DD58B5))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i below n or more."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p))
        _powers[base] = have = (both[0], both[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    if off is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(off, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def blocks(data: np.ndarray, off: np.ndarray, block: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about ``block`` bytes: (first, last, bytes, offsets)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + block, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


class Words:
    """The words of a run of documents: byte starts and ends, and each document's first word (``first``, n+1 entries)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = False, inner: np.ndarray | None = None):
        self.data, self.off = LOWER[data] if lower else data, off
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~_SPACE[data] if inner is None else inner[data]
        edge = off[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        start = inside[1:-1] & ~inside[:-2]
        end = inside[1:-1] & ~inside[2:]
        start[edge] |= inside[edge + 1]
        end[edge - 1] |= inside[edge]
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, off)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, family: int = 0) -> np.ndarray:
        power, inverse = powers(_BASES[family][0], len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_TABLES[family][self.data] * power[: len(self.data)], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))

    def windows(self, hashes: np.ndarray, k: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Start words (indices) of every window of k words of one document, and the windows' hashes."""
        base = _BASES[family][1]
        n = len(hashes)
        left = np.repeat(self.first[1:], self.counts()) - np.arange(n)
        at = np.flatnonzero(left >= k)
        power, inverse = powers(base, n + k + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * power[:n], out=sums[1:])
        return at, mix((sums[at + k] - sums[at]) * inverse[at] + np.uint64(k))

    def doc_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, word, "right") - 1


def covered(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Mask of n words covered by windows of k words that start at ``at``."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, at, 1)
    np.add.at(d, at + k, -1)
    return np.cumsum(d[:-1]) > 0
