"""Counting quotient filters over packed n-grams of word ids.

An n-gram of ids is packed into two halves of a fixed width and permuted by an
invertible Feistel network, so that the result is spread evenly whatever the
ids are. A filter keeps the permuted keys sorted: the high bits are the
quotient, told by two bit vectors (which quotients occur, and where each one's
run ends); all bits below are the remainder, kept in full. Nothing is lost, so
counts are exact and the n-gram comes back by undoing the permutation. Counters
take no space for keys seen once. Filters of one range merge as sorted runs do.
"""

from __future__ import annotations

import struct
from typing import NamedTuple

import numpy as np

from latticework.llm.textkernel import mix64

U64 = np.uint64
ROUNDS = 4
_HEAD = struct.Struct("<QBBBQ")


class Keys(NamedTuple):
    """Keys of up to 128 bits: a high and a low part, of which the low one is absent if the high one holds all bits."""

    high: np.ndarray
    low: np.ndarray | None

    def take(self, index) -> "Keys":
        return Keys(self.high[index], None if self.low is None else self.low[index])


def _mask(bits: int) -> np.uint64:
    return U64((1 << bits) - 1)


def _round(x: np.ndarray, k: int, bits: int) -> np.ndarray:
    return mix64(x + U64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) & _mask(bits)


def widths(words: int, bits: int) -> tuple[int, int]:
    """Bits of the two halves of an n-gram of `words` ids of `bits` bits."""
    left = (words + 1) // 2
    return left * bits, (words - left) * bits


def permuted(ids: list[np.ndarray], bits: int) -> Keys:
    """The keys of n-grams given as one array of ids for each place (bits <= 32)."""
    a, b = widths(len(ids), bits)
    half = (len(ids) + 1) // 2
    left, right = (_packed(part, bits) for part in (ids[:half], ids[half:]))
    for k in range(ROUNDS):
        left = left ^ _round(right, 2 * k, a)
        right = right ^ _round(left, 2 * k + 1, b)
    return Keys(left << U64(b) | right, None) if a + b <= 64 else Keys(left, right)


def restored(keys: Keys, words: int, bits: int) -> list[np.ndarray]:
    """The ids of each place: the inverse of `permuted`."""
    a, b = widths(words, bits)
    left, right = (keys.high >> U64(b), keys.high & _mask(b)) if keys.low is None else keys
    for k in reversed(range(ROUNDS)):
        right = right ^ _round(left, 2 * k + 1, b)
        left = left ^ _round(right, 2 * k, a)
    half = (words + 1) // 2
    return _unpacked(left, half, bits) + _unpacked(right, words - half, bits)


def _packed(ids: list[np.ndarray], bits: int) -> np.ndarray:
    out = ids[0].astype(U64)
    for x in ids[1:]:
        out = out << U64(bits) | x.astype(U64)
    return out


def _unpacked(x: np.ndarray, n: int, bits: int) -> list[np.ndarray]:
    return [(x >> U64(bits * (n - 1 - i))) & _mask(bits) for i in range(n)]


def key_bits(words: int, bits: int) -> tuple[int, int]:
    """Bits of the high and of the low part of a key."""
    a, b = widths(words, bits)
    return (a + b, 0) if a + b <= 64 else (a, b)


def _order(keys: Keys) -> np.ndarray:
    return np.argsort(keys.high, kind="stable") if keys.low is None else np.lexsort((keys.low, keys.high))


def counted(keys: Keys, counts: np.ndarray | None = None) -> tuple[Keys, np.ndarray, np.ndarray]:
    """Distinct keys in order, their totals, and the number of each given key among them."""
    n = len(keys.high)
    if not n:
        return keys, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = _order(keys)
    at = keys.take(order)
    new = np.ones(n, bool)
    new[1:] = at.high[1:] != at.high[:-1]
    if at.low is not None:
        new[1:] |= at.low[1:] != at.low[:-1]
    first = np.flatnonzero(new)
    inverse = np.empty(n, np.int64)
    inverse[order] = np.cumsum(new) - 1
    total = np.diff(np.append(first, n)) if counts is None else np.add.reduceat(counts.astype(np.int64)[order], first)
    return at.take(first), total, inverse


def ranges(high_bits: int, shards: int) -> tuple[int, list[int]]:
    """Width of a shard's range of high parts, and where the shards begin."""
    step = -(-(1 << high_bits) // shards)
    return step, [min(s * step, (1 << high_bits) - 1) if s else 0 for s in range(shards) if s == 0 or s * step < 1 << high_bits]


def encode(keys: Keys, counts: np.ndarray, begin: int, step: int, low_bits: int) -> bytes:
    """The filter of sorted distinct keys whose high parts lie in [begin, begin + step)."""
    n = len(counts)
    rel = keys.high - U64(begin)
    span = max(1, (step - 1).bit_length())
    q = min(span, max(1, n.bit_length()))
    r = span - q
    quotient = (rel >> U64(r)).astype(np.int64) if r < 64 else np.zeros(n, np.int64)
    occupied, ends = np.zeros(1 << q, bool), np.ones(n, bool)
    occupied[quotient] = True
    ends[:-1] = quotient[1:] != quotient[:-1]
    many = counts > 1
    extra = counts[many].astype(np.int64) - 2
    large = extra[extra > 254].astype("<u8")
    parts = [np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), _bytes(rel & _mask(r), r)]
    if low_bits:
        parts.append(_bytes(keys.low, low_bits))
    parts += [np.packbits(many).tobytes(), np.minimum(extra, 255).astype(np.uint8).tobytes(), large.tobytes()]
    return _HEAD.pack(n, span, q, low_bits, begin) + b"".join(parts)


def _bytes(x: np.ndarray, bits: int) -> bytes:
    width = -(-bits // 8)
    return np.ascontiguousarray(np.ascontiguousarray(x, dtype="<u8").view(np.uint8).reshape(len(x), 8)[:, :width]).tobytes()


def decode(data) -> tuple[Keys, np.ndarray]:
    """Sorted keys and counts of a filter."""
    raw = np.frombuffer(data, np.uint8)
    n, span, q, low_bits, begin = _HEAD.unpack(raw[: _HEAD.size].tobytes())
    at, r = _HEAD.size, span - q

    def take(size: int) -> np.ndarray:
        nonlocal at
        at += size
        return raw[at - size : at]

    def values(bits: int) -> np.ndarray:
        width = -(-bits // 8)
        out = np.zeros((n, 8), np.uint8)
        out[:, :width] = take(n * width).reshape(n, width)
        return out.view("<u8").reshape(n).astype(U64)

    occupied = np.flatnonzero(np.unpackbits(take(-(-(1 << q) // 8)))[: 1 << q]).astype(U64)
    ends = np.flatnonzero(np.unpackbits(take(-(-n // 8)))[:n])
    quotient = np.repeat(occupied, np.diff(ends, prepend=-1))
    high = (quotient << U64(r) if r < 64 else np.zeros(n, U64)) | values(r)
    low = values(low_bits) if low_bits else None
    many = np.unpackbits(take(-(-n // 8)))[:n].astype(bool)
    extra = take(int(many.sum())).astype(np.int64)
    extra[extra == 255] = raw[at:].view("<u8").astype(np.int64) if at < len(raw) else 0
    counts = np.ones(n, np.int64)
    counts[many] = extra + 2
    return Keys(high + U64(begin), low), counts


def merged(filters: list) -> tuple[Keys, np.ndarray, list[np.ndarray]]:
    """Distinct keys and totals of several filters, and for each filter its keys' numbers among them."""
    parts = [decode(f) for f in filters]
    low = None if parts[0][0].low is None else np.concatenate([k.low for k, _ in parts])
    keys, total, inverse = counted(Keys(np.concatenate([k.high for k, _ in parts]), low), np.concatenate([c for _, c in parts]))
    return keys, total, np.split(inverse, np.cumsum([len(c) for _, c in parts])[:-1])
