"""Text columns of Arrow batches as numpy bytes: word places, word hashes and shingle hashes without Python strings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; tables and temporaries stay a small multiple of this.
BLOCK = 1 << 18
#: Words of more bytes than this are hashed by a digest.
LONG_WORD = 64
_P = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
#: Bytes of white space between plain words.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_tables: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd constant and of its inverse, modulo 2**64."""
    if not _tables:
        for p in (_P, pow(_P, -1, 1 << 64)):
            full = np.full(BLOCK + 1, p, _U)
            full[0] = 1
            _tables.append(np.multiply.accumulate(full))
    return _tables[0], _tables[1]


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of a string column; null is an empty text."""
    col = batch.column(batch.schema.get_field_index(name))
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    starts, ends = offs[:-1], offs[1:].copy()
    if col.null_count:
        ends = np.where(np.asarray(col.is_null()), starts, ends)
    return raw, starts, ends


def parts(starts: np.ndarray, ends: np.ndarray, limit: int = 2 * BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of rows with about this many bytes, one row at least."""
    if not len(starts):
        return
    row, n = 0, len(starts)
    while row < n:
        to = max(row + 1, int(np.searchsorted(ends, starts[row] + limit, "right")))
        yield row, min(to, n)
        row = min(to, n)


def words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, separator: np.ndarray = BLANK):
    """(starts, ends, row) of every word in rows that lie one after another in raw."""
    lo, hi = int(starts[0]), int(ends[-1])
    data = raw[lo:hi]
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~separator[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[starts - lo] = True
    cut[ends - lo] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | cut[1:-1]
    s, e = np.flatnonzero(begins) + lo, np.flatnonzero(stops) + 1 + lo
    row = np.searchsorted(starts, s, "right") - 1
    return s, e, row


def word_hashes(raw: np.ndarray, s: np.ndarray, e: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """64-bit hash of every word's folded bytes; the words come in order.

    Short words are polynomials in their bytes, mixed; long ones, for which such polynomials can be made to collide,
    are digests.
    """
    out = np.empty(len(s), _U)
    powers, inverse = _powers()
    i = 0
    while i < len(s):
        base = int(s[i])
        to = max(i + 1, int(np.searchsorted(e, base + BLOCK, "right")))
        if int(e[to - 1]) - base <= BLOCK:  # else one giant word
            block = (fold[raw[base : int(e[to - 1])]].astype(_U) + _U(1)) * powers[: int(e[to - 1]) - base]
            total = np.zeros(len(block) + 1, _U)
            np.cumsum(block, out=total[1:])
            out[i:to] = (total[e[i:to] - base] - total[s[i:to] - base]) * inverse[s[i:to] - base]
        i = to
    for k in np.flatnonzero(e - s > LONG_WORD):
        out[k] = int.from_bytes(hashlib.blake2b(fold[raw[int(s[k]) : int(e[k])]].tobytes(), digest_size=8).digest(), "little")
    return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def chained(hashes: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of this many consecutive hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    x = np.full(n, size * 0x632BE59BD9B4E019 + salt & (1 << 64) - 1, _U)
    for k in range(size):
        x = mixed(x * _U(_P) + hashes[k : k + n])
    return x


def shingle_sets(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For every row its sorted distinct shingle hashes: runs of ``size`` words, or all words of a shorter text."""
    s, e, row = words(raw, starts, ends)
    h = word_hashes(raw, s, e)
    runs = chained(h, size)
    first = np.searchsorted(row, np.arange(len(starts) + 1))
    for k in range(len(starts)):
        a, b = int(first[k]), int(first[k + 1])
        if b - a >= size:
            yield np.unique(runs[a : b - size + 1])
        elif b > a:
            yield chained(h[a:b], b - a)
        else:
            yield runs[:0]
