"""Vectorised word kernels over Arrow string buffers (numpy, inside tasks).

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. All such separators
are single ASCII bytes, so words of UTF-8 text can be cut on bytes. A word's hash
is a polynomial over a random table of its bytes modulo 2**64, finished by a mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SEGMENT = 1 << 18  # bytes hashed at a time

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, size=256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_COEF = _rng.integers(1, 2**63, size=64, dtype=np.uint64) * U64(2) + U64(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with good avalanche."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(SEGMENT + 1, 1 << (n - 1).bit_length())
        have = np.ones(size, dtype=np.uint64)
        have[1:] = U64(base)
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    wide = kind == pa.large_binary()
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)
    offs = offs[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offs[0]:offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return offs - offs[0], data


def blocks(offs: np.ndarray, limit: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes (a longer text is a range of its own)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def word_bounds(data: np.ndarray, offs: np.ndarray, separator: np.ndarray = SEPARATOR
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    inside = ~separator[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    cut = offs[(offs > 0) & (offs < n)]
    before[cut] = False
    after[cut - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(offs, start, side="right") - 1


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of each span; spans are in order and do not overlap."""
    out = np.empty(len(start), dtype=np.uint64)
    i, n = 0, len(start)
    while i < n:
        j = max(i + 1, int(np.searchsorted(end, start[i] + SEGMENT, side="right")))
        lo, hi = int(start[i]), int(end[j - 1])
        part = data[lo:hi]
        if lower:
            part = LOWER[part]
        prefix = np.empty(hi - lo + 1, dtype=np.uint64)
        prefix[0] = 0
        val = _BYTE[part]
        val *= _power_table(_BASE, hi - lo)[:hi - lo]
        np.cumsum(val, out=prefix[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        h = prefix[e]
        h -= prefix[s]
        h *= _power_table(_BASE_INV, hi - lo + 1)[s]
        h += (e - s).astype(np.uint64) * _COEF[63]
        out[i:j] = mix(h)
        i = j
    return out


def words(data: np.ndarray, offs: np.ndarray, lower: bool = True):
    """(hash, row, start, end) of every word of the rows."""
    start, end, row = word_bounds(data, offs)
    return hash_spans(data, start, end, lower), row, start, end


def combine(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes (ignores row limits)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    acc = h[:n] * _COEF[0]
    for j in range(1, k):
        acc += h[j:j + n] * _COEF[j]
    acc += U64(int(_COEF[62]) * k % 2**64)
    return mix(acc)


def row_ptr(row: np.ndarray, n: int) -> np.ndarray:
    """Bounds of each row's words: words of row i are ptr[i]:ptr[i+1]."""
    return np.searchsorted(row, np.arange(n + 1))


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Per row, the sorted distinct hashes of its ``k``-word shingles.

    Words are lower-cased (A-Z). A text of fewer words is one shingle (its whole
    word sequence); a text without words gives an empty set.
    """
    offs, data = buffers(column)
    for i, j in blocks(offs):
        part = data[offs[i]:offs[j]]
        h, row, _, _ = words(part, offs[i:j + 1] - offs[i])
        ptr = row_ptr(row, j - i)
        full = combine(h, k)
        for r in range(j - i):
            a, b = int(ptr[r]), int(ptr[r + 1])
            if b - a >= k:
                yield np.unique(full[a:b - k + 1])
            elif b > a:
                yield combine(h[a:b], b - a)
            else:
                yield h[:0]
