"""Elias-Fano coded sequences on numpy arrays, for batches of queries."""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` low bits of each value, one after the other, in 64-bit words (one spare word at the end)."""
    if bits == 0 or not len(values):
        return np.zeros(2, dtype=np.uint64)
    parts = []
    places = np.arange(bits, dtype=np.uint64)
    for at in range(0, len(values), 1 << 16):  # a multiple of 64 values fills whole words
        matrix = (values[at:at + (1 << 16), None] >> places) & ONE
        parts.append(np.packbits(matrix.astype(np.uint8).ravel(), bitorder="little"))
    raw = np.concatenate(parts).tobytes()
    return np.frombuffer(raw + b"\0" * (-len(raw) % 8 + 16), dtype=np.uint64)


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of a rising sequence below ``universe`` (< 2**63): packed low bits, unary high bits, ones and zeros before a
    word."""
    values = np.asarray(values, dtype=np.uint64)
    n = len(values)
    low = max(0, (universe // max(n, 1)).bit_length() - 1)
    high = (values >> np.uint64(low)).astype(np.int64)
    bits = n + (universe >> low) + 2
    marks = np.zeros((bits + 63) // 64 * 64, dtype=np.uint8)
    marks[high + np.arange(n)] = 1
    words = np.frombuffer(np.packbits(marks, bitorder="little").tobytes(), dtype=np.uint64)
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
    zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones
    return {"size": np.array([n, low], dtype=np.int64), "low": _pack(values, low), "high": words,
            "ones": ones.astype(np.uint32), "zeros": zeros.astype(np.uint32)}


#: Place of the nth (0-based) set bit of a byte, at 8 * byte + n.
PLACES = np.array([p[n] if n < len(p) else 0 for p in ([i for i in range(8) if b >> i & 1] for b in range(256)) for n in range(8)],
                  dtype=np.uint8)
STEPS = 4  # elements of a bucket that are looked at one by one


class EliasFano:
    """Reads the arrays of ``encode``, which may be memory-mapped."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.bits = (int(x) for x in arrays["size"])
        self.low, self.high, self.ones, self.zeros = (arrays[k] for k in ("low", "high", "ones", "zeros"))
        self.mask = np.uint64((1 << self.bits) - 1)

    def _nth(self, words: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """Position of the nth (0-based) set bit in each word: by halving down to its byte, then by table."""
        at = np.zeros(len(words), dtype=np.uint64)
        for width in (32, 16, 8):
            count = np.bitwise_count((words >> at) & np.uint64((1 << width) - 1)).astype(np.int64)
            beyond = nth >= count
            nth = nth - count * beyond
            at += beyond.astype(np.uint64) * np.uint64(width)
        byte = ((words >> at) & np.uint64(255)).astype(np.int64)
        return at.astype(np.int64) + PLACES[byte * 8 + nth]

    def _select(self, directory: np.ndarray, words: np.ndarray, nth: np.ndarray, flip: bool) -> np.ndarray:
        word = np.searchsorted(directory, nth.astype(directory.dtype), side="right") - 1
        content = words[word]
        return word * 64 + self._nth(~content if flip else content, nth - directory[word].astype(np.int64))

    def _low(self, at: np.ndarray) -> np.ndarray:
        if self.bits == 0:
            return np.zeros(len(at), dtype=np.uint64)
        bit = at * self.bits
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        first = self.low[word] >> shift
        second = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (first | second) & self.mask

    def access(self, at: np.ndarray) -> np.ndarray:
        at = np.asarray(at, dtype=np.int64)
        high = self._select(self.ones, self.high, at, False) - at
        return (high.astype(np.uint64) << np.uint64(self.bits)) | self._low(at)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first element not below each x; n where none is."""
        x = np.asarray(x, dtype=np.uint64)
        bucket = (x >> np.uint64(self.bits)).astype(np.int64)
        last = int(self.zeros[-1]) - 1
        inside = bucket <= last
        bucket = np.minimum(bucket, last)
        end = self._select(self.zeros, self.high, bucket, True) - bucket
        before = np.maximum(bucket - 1, 0)
        begin = np.where(bucket > 0, self._select(self.zeros, self.high, before, True) - before, 0)
        target = x & self.mask
        a, b = begin.copy(), end.copy()
        open_ = np.flatnonzero(a < b)
        while len(open_):
            middle = (a[open_] + b[open_]) // 2
            below = self._low(middle) < target[open_]
            a[open_[below]] = middle[below] + 1
            b[open_[~below]] = middle[~below]
            open_ = open_[a[open_] < b[open_]]
        return np.where(inside, a, self.n)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each x, -1 where it is not in the sequence. A bucket's first elements are compared one by one from its
        border in the high bits; only what lies deeper in a large bucket is searched by halving."""
        x = np.asarray(x, dtype=np.uint64)
        out = np.full(len(x), -1, dtype=np.int64)
        bucket = (x >> np.uint64(self.bits)).astype(np.int64)
        left = np.flatnonzero(bucket < int(self.zeros[-1]))
        bucket = bucket[left]
        at = np.zeros(len(left), dtype=np.int64)  # in the high bits
        later = np.flatnonzero(bucket > 0)
        at[later] = self._select(self.zeros, self.high, bucket[later] - 1, True) + 1
        element, target = at - bucket, x[left] & self.mask
        for _ in range(STEPS):
            if not len(left):
                return out
            inside = np.flatnonzero((self.high[at >> 6] >> (at & 63).astype(np.uint64)) & ONE)
            left, at, element, target = left[inside], at[inside], element[inside], target[inside]
            low = self._low(element)
            same = low == target
            out[left[same]] = element[same]
            on = np.flatnonzero(low < target)
            left, at, element, target = left[on], at[on] + 1, element[on] + 1, target[on]
        if len(left):
            found = self.successor(x[left])
            there = np.flatnonzero(found < self.n)
            there = there[self.access(found[there]) == x[left[there]]]
            out[left[there]] = found[there]
        return out
