"""Elias-Fano coding of sorted integers, with byte-aligned low parts.

A sorted sequence is split into low bits, stored as they are, and high parts,
stored as a unary bit vector. The low width is a whole number of bytes, which
costs a few bits a value and lets numpy read and write without bit loops.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QBQ")


def encode(values: np.ndarray, least: int = 0) -> bytes:
    """Bytes for a sorted (repeats allowed) array of uint64, with low parts of `least` bytes or more."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    if n == 0:
        return _HEAD.pack(0, 0, 0)
    top = int(values[-1])
    low = min(range(least, 8), key=lambda k: n * 8 * k + (top >> (8 * k)))
    high = (values >> np.uint64(8 * low)).astype(np.int64)
    bits = np.zeros(n + int(high[-1]) + 1, dtype=bool)
    bits[high + np.arange(n)] = True
    lows = values.view(np.uint8).reshape(n, 8)[:, :low]
    packed = np.packbits(bits)
    return _HEAD.pack(n, low, len(packed)) + packed.tobytes() + np.ascontiguousarray(lows).tobytes()


class Sequence:
    """A coded sequence over bytes or a memory map; low parts are read in place."""

    def __init__(self, data):
        raw = np.frombuffer(data, np.uint8) if not isinstance(data, np.ndarray) else data
        self.n, self.low, size = _HEAD.unpack(raw[: _HEAD.size].tobytes())
        self._bits = raw[_HEAD.size : _HEAD.size + size]
        at = _HEAD.size + size
        self._lows = raw[at : at + self.n * self.low].reshape(self.n, self.low)
        self._first: np.ndarray | None = None
        self._highs: np.ndarray | None = None

    def at(self, index: np.ndarray) -> np.ndarray:
        """Values at the given indices."""
        if self._highs is None:
            self._highs = self._high().astype(np.uint32)
        return (self._highs[index].astype(np.uint64) << np.uint64(8 * self.low)) | self._low_of(index)

    def _high(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self._bits))[: self.n] - np.arange(self.n)

    def _starts(self) -> np.ndarray:
        """For each high part the first index that has it or a greater one, from the unary part's zeros."""
        zeros = np.flatnonzero(np.unpackbits(self._bits) == 0)
        top = len(zeros) if self.n else 0
        starts = np.concatenate(([0], zeros - np.arange(top))).astype(np.uint32 if self.n < 1 << 32 else np.uint64)
        return starts[: int(np.searchsorted(starts, self.n)) + 1]

    def _low_of(self, index) -> np.ndarray:
        rows = self._lows[index]
        out = np.zeros(len(rows), dtype=np.uint64)
        for k in range(self.low):
            out |= rows[:, k].astype(np.uint64) << np.uint64(8 * k)
        return out

    def all(self) -> np.ndarray:
        """The whole sequence as uint64."""
        if not self.n:
            return np.zeros(0, np.uint64)
        return (self._high().astype(np.uint64) << np.uint64(8 * self.low)) | self._low_of(slice(None))

    def successor(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first value not below each query, and whether it is equal.

        The unary part gives each high part's range of indices; a bisection of
        that range reads the low parts only.
        """
        queries = np.asarray(queries, dtype=np.uint64)
        if not self.n:
            return np.zeros(len(queries), np.int64), np.zeros(len(queries), bool)
        if self._first is None:
            self._first = self._starts()
        q_high = (queries >> np.uint64(8 * self.low)).astype(np.int64)
        q_low = queries & np.uint64((1 << (8 * self.low)) - 1)
        known = q_high < len(self._first) - 1
        slot = np.where(known, q_high, 0)
        lo = np.where(known, self._first[slot], self.n).astype(np.int64)
        end = np.where(known, self._first[slot + 1], self.n).astype(np.int64)
        return self._bisected(q_low, lo, end)

    def within(self, queries: np.ndarray, lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As `successor`, for each query among the indices from lo to end, whose values may differ in their low part only."""
        queries = np.asarray(queries, dtype=np.uint64)
        return self._bisected(queries & np.uint64((1 << (8 * self.low)) - 1), lo.astype(np.int64), end.astype(np.int64))

    def _bisected(self, q_low: np.ndarray, lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hi = end.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            below = self._low_of(mid) < q_low[open_]
            lo[open_] = np.where(below, mid + 1, lo[open_])
            hi[open_] = np.where(below, hi[open_], mid)
        equal = np.zeros(len(q_low), bool)
        inside = np.flatnonzero(lo < end)
        equal[inside] = self._low_of(lo[inside]) == q_low[inside]
        return lo, equal


def decode(data) -> np.ndarray:
    return Sequence(data).all()
