"""Vectorised text kernels over Arrow string columns.

A batch of texts is handled as one byte array plus row offsets, so lower-casing, word finding, word
hashing and shingling are numpy passes over the batch and no Python string is made.  Words are the
runs of ``[^\\x20\\x09-\\x0D]+`` after A-Z is lower-cased.  Hashes are 64 bits wide.
"""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (one more than rows) of a string column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if offsets is not None and n else np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and n else np.zeros(0, np.uint8)
    return raw, off - off[0]


_inverse = pow(int(_BASE), -1, 2**64)


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n + 1, base, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_STEP = 1 << 12


@lru_cache(maxsize=8)
def _table(base: int) -> np.ndarray:
    return _powers(_STEP - 1, base)


def _powers_to(n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), from the powers below and above a step."""
    base = int(_BASE)
    return (_powers(n // _STEP, pow(base, _STEP, 2**64))[:, None] * _table(base)).ravel()[:n]


def _inverse_at(place: np.ndarray) -> np.ndarray:
    high = _powers(int(place[-1]) // _STEP, pow(_inverse, _STEP, 2**64)) if len(place) else np.ones(1, np.uint64)
    return _table(_inverse)[place % _STEP] * high[place // _STEP]


class Words:
    """The words of a batch: ``start``, ``end`` (byte positions), ``row`` and 64-bit ``hash``; words of
    row r are ``first[r]:first[r + 1]``."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, hashes: bool = True):
        low = LOWER[raw]
        n = len(low)
        gap = np.ones(n + 2, dtype=bool)
        gap[1:-1] = SPACE[low]
        edge = np.diff(gap)
        if n:  # a row's end ends a word too
            cut = off[1:-1]
            cut = cut[(cut > 0) & (cut < n)]
            joined = cut[~gap[cut] & ~gap[cut + 1]]
        else:
            joined = np.zeros(0, np.int64)
        at = np.flatnonzero(edge)
        start, end = at[0::2], at[1::2]
        if len(joined):
            joined = np.unique(joined)
            start = np.sort(np.concatenate([start, joined]))
            end = np.sort(np.concatenate([end, joined]))
        self.low, self.start, self.end, self.off = low, start, end, off
        self.first = np.searchsorted(start, off)
        self.first[-1] = len(start)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(off) - 1), self.count)
        if hashes:
            self.hash = span_hash(low, start, end)


def span_hash(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span low[start:end], a polynomial in an odd base over random byte codes, mixed."""
    if not len(start):
        return np.zeros(0, np.uint64)
    total = BYTE_CODE[low]
    total *= _powers_to(len(low))
    np.cumsum(total, out=total)
    value = total[end - 1]
    value[start > 0] -= total[start[start > 0] - 1]
    value *= _inverse_at(start)
    return mix(value + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every ``size``-word shingle; a row with fewer words, but some, has its whole
    sequence as the only one."""
    h, n = words.hash, len(words.hash)
    salt = mix(np.arange(1, size + 1, dtype=np.uint64) * _U(0xA24BAED4963EE407)) | _U(1)
    rows, values = [], []
    if n >= size:
        acc = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            acc += h[k : n - size + 1 + k] * salt[k]
        row = words.row[: n - size + 1]
        whole = row == words.row[size - 1 :]
        rows.append(row[whole])
        values.append(mix(acc[whole]))
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    if len(short):
        acc = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = words.count[short] > k
            acc[has] += h[words.first[short[has]] + k] * salt[k]
        rows.append(short)
        values.append(mix(acc + words.count[short].astype(np.uint64) * _U(0x8CB92BA72F3D8DD7)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(values)


@lru_cache(maxsize=1)
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give freed memory back to the machine where the C library can, so that workers which wait hold little."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def narrow(x: np.ndarray) -> bytes:
    """Integers as their least and the differences from it, in as few bytes as hold them."""
    if not len(x):
        return b""
    x = x.astype(np.int64)
    gap = x.view(np.uint64) - x.min().view(np.uint64)
    size = next(s for s in (1, 2, 4, 8) if s == 8 or int(gap.max()) < 1 << 8 * s)
    return bytes([size]) + x.min().tobytes() + gap.astype(f"<u{size}").tobytes()


def widen(data: bytes) -> np.ndarray:
    """The 64-bit integers of :func:`narrow`."""
    if not data:
        return np.zeros(0, np.int64)
    return (np.frombuffer(data, f"<u{data[0]}", offset=9).astype(np.uint64) + np.frombuffer(data, np.uint64, 1, 1)).view(np.int64)


TOKEN_BITS = 52
PIECE_ROWS = 1 << (64 - TOKEN_BITS)
_TOKEN = _U((1 << TOKEN_BITS) - 1)


def distinct_sets(row: np.ndarray, value: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 52-bit tokens of each row: flat tokens and row offsets.  A piece has at most 4,096
    rows, so a row and a token share a word and one plain sort orders both."""
    packed = np.sort((row.astype(np.uint64) << _U(TOKEN_BITS)) | (value >> _U(64 - TOKEN_BITS)))
    keep = np.ones(len(packed), bool)
    keep[1:] = packed[1:] != packed[:-1]
    packed = packed[keep]
    off = np.searchsorted(packed, np.arange(n_rows + 1, dtype=np.uint64) << _U(TOKEN_BITS)) if n_rows < PIECE_ROWS else np.append(np.searchsorted(packed, np.arange(n_rows, dtype=np.uint64) << _U(TOKEN_BITS)), len(packed))
    return packed & _TOKEN, off.astype(np.int64)


def pieces(column: pa.Array, most: int = 2_000_000, rows: int = PIECE_ROWS):
    """(begin, end) slices of a column of at most about ``most`` bytes (one row at least) and ``rows`` rows."""
    size = np.diff(buffers(column)[1])
    begin, total = 0, 0
    for i, s in enumerate(size):
        if (total and total + s > most) or i - begin == rows:
            yield begin, i
            begin, total = i, 0
        total += int(s)
    if begin < len(size):
        yield begin, len(size)
    release()
