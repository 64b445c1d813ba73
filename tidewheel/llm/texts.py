"""Whole texts as byte arrays: vectorised words, shingles and n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
STEP = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffers(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, null as empty, and the n + 1 offsets between them."""
    column = pc.fill_null(column, "")
    if lower:
        column = pc.utf8_lower(column)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + n + 1].astype(np.int64)
    found = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return found, at - at[0]


def byte_slices(column: pa.Array, size: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `size` bytes at most, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(ends):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + size, "right")))
        yield begin, end
        begin = end


_WORD = np.zeros(256, bool)
for _c in range(256):
    _WORD[_c] = _c >= 128 or chr(_c).isalnum()
_TABLE = mix(np.arange(1, 257, dtype=U64) * STEP) * _WORD  # separators add nothing
_PRIME = 0x100000001B3
_INVERSE = pow(_PRIME, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        size = max(n, 1 << 19)
        steps = np.full(size, base, dtype=U64)
        steps[0] = 1
        _powers[key] = np.multiply.accumulate(steps)
    return _powers[key][:n]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (letters, digits and non-ASCII bytes) and the number of words before each text."""
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    inside = _WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    total = np.cumsum(_TABLE[data] * _power(_PRIME, n))
    found = total[ends] - np.where(starts > 0, total[starts - 1], U64(0))
    return mix(found * _power(_INVERSE, n)[starts]), np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, before: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `width` words and the text it is in; a text of fewer words has one of them all."""
    n, per = len(hashes), np.diff(before)
    text = np.repeat(np.arange(len(per)), per)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    rolled = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        for i in range(width):
            shifted = np.zeros(n, U64)
            m = max(0, n - i)
            shifted[:m] = hashes[i:] * (text[i:] == text[:m])
            rolled = rolled * STEP + shifted
    whole = np.arange(n) <= np.maximum(before[1:] - width, before[:-1])[text]
    return mix(rolled[whole]), text[whole]
