"""Vectorised word helpers over Arrow string arrays (used inside Spark tasks).

A word is a run of ``[^\\x20\\x09-\\x0D]``.  Those separators are single ASCII bytes, so
word borders can be found in the UTF-8 bytes themselves, without decoding, for a whole
batch at once.  Hashes are 64-bit polynomials finished by a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 4 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C55)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) of an unsigned array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _C1
    x ^= x >> np.uint64(27)
    x *= _C2
    x ^= x >> np.uint64(31)
    return x


def uniform(h: np.ndarray) -> np.ndarray:
    """Hashes -> doubles in (0, 1)."""
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive combination of two hash arrays."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + b)


def powers(n: int) -> np.ndarray:
    p = np.full(max(n, 1), _BASE, dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def as_large_strings(col) -> pa.Array:
    """Any Arrow string column as one large_string array, nulls as empty strings."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.cast(pa.large_string()).fill_null("")


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array without nulls; offsets start at 0."""
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offs = np.frombuffer(off, dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offs[0]:offs[-1]], offs - offs[0]


def slices(col: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``max_bytes`` text each (a longer row alone)."""
    _, offs = buffers(col)
    a, n = 0, len(col)
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + max_bytes, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


class Words:
    """Words of a batch: ``start``/``end`` byte spans, ``doc`` row number, ``hash``."""

    def __init__(self, col: pa.Array, lower: bool = False, separators: np.ndarray = _SPACE):
        buf, offs = buffers(col)
        self.buf, self.offs, self.n_docs = buf, offs, len(col)
        if len(buf) == 0:
            self.start = self.end = np.zeros(0, np.int64)
            self.doc = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            self.count = np.zeros(self.n_docs, np.int64)
            return
        space = separators[buf]
        border = np.zeros(len(buf) + 1, dtype=bool)   # a text begins here
        border[offs[:-1]] = True
        border = border[:-1]
        first = ~space
        first[1:] &= space[:-1] | border[1:]
        self.start = np.flatnonzero(first)
        last = ~space
        last[:-1] &= space[1:] | border[1:]
        self.end = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offs, self.start, side="right") - 1
        self.count = np.bincount(self.doc, minlength=self.n_docs).astype(np.int64)
        self.hash = span_hash(_LOWER[buf] if lower else buf, self.start, self.end)

    @property
    def first_word(self) -> np.ndarray:
        """Number of the first word of each row (with the total at the end)."""
        return np.concatenate([[0], np.cumsum(self.count)])


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each disjoint, ascending byte span."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    size = end - start
    total = int(size.sum())
    at = np.cumsum(size) - size
    kind = np.int32 if len(buf) < 1 << 31 else np.int64
    pos = np.arange(total, dtype=kind) - np.repeat(at.astype(kind), size)
    byte = buf[pos + np.repeat(start.astype(kind), size)].astype(np.uint64) + np.uint64(1)
    byte *= powers(int(size.max()))[pos]
    return mix(np.add.reduceat(byte, at) + size.astype(np.uint64))


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every window of ``n`` words that lies in one row."""
    m = len(words.hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = words.hash[:m]
    for k in range(1, n):
        h = chain(h, words.hash[k:m + k])
    ok = words.doc[:m] == words.doc[n - 1:]
    return h[ok], words.doc[:m][ok]
