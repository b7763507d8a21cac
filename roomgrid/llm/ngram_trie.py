"""A two-level n-gram trie of Elias-Fano sequences, kept in one memory-mapped file.

Level one holds the contexts (ascending ids) and pointers to their successors, level two the
successors.  A successor is stored relative to its context, as rank(context) * width + id, so
the whole level is one ascending sequence; a pair is found by a successor search in the
bucket of its high bits.  Log-probabilities are 16-bit codes between the smallest and the
largest.  All searches take arrays.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

_U = np.uint64


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Values of ``bits`` bits each, end to end in 64-bit words (one spare word)."""
    n = len(values)
    out = np.zeros((n * bits + 63) // 64 + 1, np.uint64)
    if bits == 0 or n == 0:
        return out
    at = np.arange(n, dtype=np.uint64) * _U(bits)
    word, off = (at >> _U(6)).astype(np.int64), at & _U(63)
    v = values.astype(np.uint64)
    # consecutive values share words: or them together word by word
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[starts]] |= np.bitwise_or.reduceat(v << off, starts)
    spill = np.flatnonzero(off + _U(bits) > _U(64))
    out[word[spill] + 1] |= v[spill] >> (_U(64) - off[spill])
    return out


def _unpack(words: np.ndarray, i: np.ndarray, bits: int) -> np.ndarray:
    if bits == 0:
        return np.zeros(len(i), np.uint64)
    at = i.astype(np.uint64) * _U(bits)
    word, off = (at >> _U(6)).astype(np.int64), at & _U(63)
    low = words[word] >> off
    high = np.where(off > 0, words[word + 1] << ((_U(64) - off) & _U(63)), _U(0))
    return (low | high) & _U((1 << bits) - 1)


def _select_in_word(w: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) one bit of each word."""
    place = np.zeros(len(w), np.uint64)
    k = k.astype(np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count((w >> place) & _U((1 << width) - 1)).astype(np.int64)
        right = k >= low
        k = np.where(right, k - low, k)
        place = np.where(right, place + _U(width), place)
    return place.astype(np.int64)


class EliasFano:
    """An ascending sequence of non-negative integers."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.bits, self.low, self.high = n, bits, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)])      # before each word
        self.zeros = np.arange(len(high) + 1) * 64 - self.ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1) if n else 0
        v = values.astype(np.uint64)
        at = (v >> _U(bits)).astype(np.int64) + np.arange(n)
        size = (int(at[-1]) + 2 if n else 1) + 63
        high = np.zeros(size // 64 + 1, np.uint64)
        if n:
            word = at >> 6
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            high[word[starts]] = np.bitwise_or.reduceat(_U(1) << (at & 63).astype(np.uint64), starts)
        return cls(n, bits, _pack(v & _U((1 << bits) - 1), bits), high)

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.bits, len(self.low), len(self.high)], np.uint64), self.low, self.high]

    def _select1(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, k, side="right") - 1
        return word * 64 + _select_in_word(self.high[word], k - self.ones[word])

    def _select0(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.zeros, k, side="right") - 1
        return word * 64 + _select_in_word(~self.high[word], k - self.zeros[word])

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places ``i``."""
        i = np.asarray(i, np.int64)
        high = (self._select1(i) - i).astype(np.uint64)
        return (high << _U(self.bits)) | _unpack(self.low, i, self.bits)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Place of the first value at or above each ``x`` (n where there is none)."""
        x = np.asarray(x).astype(np.uint64)
        h = (x >> _U(self.bits)).astype(np.int64)
        last = int(self.zeros[-1]) - 1
        h_in = np.minimum(h, last)       # buckets past the end are empty
        begin = np.where(h_in > 0, self._select0(np.maximum(h_in - 1, 0)) - np.maximum(h_in - 1, 0), 0)
        end = self._select0(h_in) - h_in
        begin, end = np.minimum(begin, self.n), np.minimum(end, self.n)
        begin, end = np.where(h > last, self.n, begin), np.where(h > last, self.n, end)
        low = x & _U((1 << self.bits) - 1)
        live = np.flatnonzero(begin < end)
        while len(live):                 # binary search among the bucket's low bits
            mid = (begin[live] + end[live]) // 2
            less = _unpack(self.low, mid, self.bits) < low[live]
            begin[live] = np.where(less, mid + 1, begin[live])
            end[live] = np.where(less, end[live], mid)
            live = live[begin[live] < end[live]]
        return begin


class Trie:
    """Pairs (context, successor) with a log-probability each."""

    def __init__(self, words: np.ndarray):
        at = 0

        def take(n):
            nonlocal at
            at += n
            return words[at - n:at]

        def sequence():
            n, bits, low, high = (int(x) for x in take(4))
            return EliasFano(n, bits, take(low), take(high))

        self.width, self.pairs = (int(x) for x in take(2))
        self.least, self.step = take(2).view(np.float64)
        self.contexts, self.pointers, self.successors = sequence(), sequence(), sequence()
        self.codes = take((self.pairs + 3) // 4).view(np.uint16)

    @staticmethod
    def levels(context: np.ndarray, successor: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """The trie's words, from pairs in ascending order without repetition."""
        n = len(context)
        first = np.flatnonzero(np.diff(context, prepend=-1))
        rank = np.cumsum(np.diff(context, prepend=-1) != 0) - 1
        width = int(successor.max()) + 1 if n else 1
        least = float(logp.min()) if n else 0.0
        step = (float(logp.max()) - least) / 65535 if n else 0.0
        codes = np.zeros((n + 3) // 4 * 4, np.uint16)
        if n and step > 0:
            codes[:n] = np.rint((logp - least) / step)
        parts = [np.array([width, n], np.uint64), np.array([least, step]).view(np.uint64)]
        for values in (context[first], np.append(first, n), rank * width + successor):
            parts += EliasFano.build(np.asarray(values)).parts()
        return np.concatenate(parts + [codes.view(np.uint64)])

    @classmethod
    def mapped(cls, levels: np.ndarray) -> Trie:
        """The same levels from a memory-mapped file of this task (unlinked at once)."""
        with tempfile.NamedTemporaryFile(prefix="trie-", delete=False) as f:
            levels.tofile(f)
        try:
            return cls(np.memmap(f.name, np.uint64, "r"))
        finally:
            os.unlink(f.name)

    def find(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Log-probabilities of pairs; NaN for those that are not in the trie."""
        out = np.full(len(context), np.nan)
        if self.pairs == 0 or len(context) == 0:
            return out
        rank = self.contexts.successor(context)
        ok = (rank < self.contexts.n) & (successor < self.width)
        ok[ok] = self.contexts.get(rank[ok]).astype(np.int64) == context[ok]
        at = np.flatnonzero(ok)
        x = rank[at] * self.width + successor[at]
        i = self.successors.successor(x)
        hit = i < self.pointers.get(rank[at] + 1).astype(np.int64)   # inside the context's range
        hit[hit] = self.successors.get(i[hit]).astype(np.int64) == x[hit]
        out[at[hit]] = self.least + self.step * self.codes[i[hit]]
        return out
