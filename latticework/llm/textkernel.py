"""Vectorised word and shingle hashing over Arrow text columns.

The functions work on whole Arrow batches as flat byte buffers, so no Python
object is made per document or per word. Words are maximal runs of bytes that
are not separators; A-Z is lower-cased byte by byte, everything else is kept.
All hashes are 64 bit and depend on the bytes alone, so they agree between
tasks, executors and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A full-avalanche finaliser for 64-bit values (returns a new array)."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = _lower_table()
#: separators of `[^\x20\x09-\x0D]+`
SPACE_WORD = np.ones(256, dtype=bool)
SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z is lower-cased
ALNUM_WORD = np.zeros(256, dtype=bool)
ALNUM_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)]] = True

with np.errstate(over="ignore"):
    _BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))[LOWER]  # A and a share a value
    _RAW_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_R = 0x5851F42D4C957F2D
_R_INV = pow(_R, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_GRAM = mix64(np.arange(101, 133, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**i and r**-i modulo 2**64 for i < n, kept for the worker's life."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        up, down = np.full(size, _R, dtype=U64), np.full(size, _R_INV, dtype=U64)
        up[0] = down[0] = 1
        if size <= 1 << 23:
            _POWERS.clear()
            _POWERS[size] = np.cumprod(up), np.cumprod(down)
        else:
            return np.cumprod(up), np.cumprod(down)
    return _POWERS[size]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes (a longer row stands alone)."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_bounds(buf: np.ndarray, offs: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and each row's first word (n + 1 values)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    is_word = word[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offs] = True
    before = np.concatenate(([False], is_word[:-1])) & ~edge[:-1]
    starts = np.flatnonzero(is_word & ~before)
    after = np.concatenate((is_word[1:], [False])) & ~edge[1:]
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each byte span, from one cumulative sum."""
    if not len(starts):
        return np.zeros(0, U64)
    up, down = _powers(len(buf))
    total = np.zeros(len(buf) + 1, dtype=U64)
    np.cumsum((_BYTE if lower else _RAW_BYTE)[buf] * up[: len(buf)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix64(h + (ends - starts).astype(U64))


def gram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n consecutive word hashes (rows are not told apart)."""
    if len(words) < n:
        return np.zeros(0, U64)
    out = np.full(len(words) - n + 1, _GRAM[n], dtype=U64)
    for i in range(n):
        out += words[i : len(words) - n + 1 + i] * _GRAM[10 + i]
    return mix64(out)


def shingle_rows(buf: np.ndarray, offs: np.ndarray, n: int = 5, word: np.ndarray = SPACE_WORD) -> Iterator[np.ndarray]:
    """Per row its sorted distinct n-word shingle hashes.

    A row of fewer words, but not none, has one shingle: the whole sequence.
    """
    for lo, hi in chunks(offs):
        part = buf[offs[lo] : offs[hi]]
        starts, ends, first = word_bounds(part, offs[lo : hi + 1] - offs[lo], word)
        h = hash_spans(part, starts, ends)
        grams = gram_hash(h, n)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                yield gram_hash(h[a:b], b - a)
            else:
                yield np.zeros(0, U64)
