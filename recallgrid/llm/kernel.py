"""Vectorised word splitting and hashing over the UTF-8 buffer of an Arrow string column.

All functions work on slices of a batch, so that memory follows the slice and not the batch; a single
text longer than a slice is a slice of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_BLOCK = 1 << 16
with np.errstate(over="ignore"):
    _POW = np.cumprod(np.full(_BLOCK, 0xD6E8FEB86659FD93, dtype=np.uint64))

#: 1 for bytes that belong to words: all but space, tab, line feed, vertical tab, form feed, carriage return.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: 1 for ASCII letters and digits and every byte of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Maps A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the ordered pair (a, b)."""
    return mix(a * _U(0xA0761D6478BD642F) + mix(b + _ODD))


def slices(texts: pa.ChunkedArray | pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of at most limit bytes; nulls are empty."""
    chunks = texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]
    base = 0
    for c in chunks:
        if len(c):
            c = c.cast(pa.large_string()).fill_null("")
            _, off, data = c.buffers()
            off = np.frombuffer(off, np.int64)[c.offset : c.offset + len(c) + 1]
            data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            i = 0
            while i < len(c):
                j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
                j = min(j, len(c))
                yield base + i, base + j, data[off[i] : off[j]], off[i : j + 1] - off[i]
                i = j
        base += len(c)


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word: a maximal run of member bytes inside one row."""
    return runs(member[data], offsets)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of bytes that are inside and in one row."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(inside) + 1, bool)  # a word can't go on over these places
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def runs_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run data[start:end]; runs are in order and don't overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    first = np.cumsum(size) - size
    at = np.arange(int(first[-1] + size[-1])) - np.repeat(first, size)
    values = (data[np.repeat(starts, size) + at].astype(np.uint64) + _U(1)) * _POW[at & (_BLOCK - 1)]
    if int(size.max()) > _BLOCK:  # the powers start again; bytes beyond a block are told apart by its number
        far = at >= _BLOCK
        values[far] = mix(values[far] + (at[far] // _BLOCK).astype(np.uint64) * _ODD)
    return mix(np.add.reduceat(values, first) + size.astype(np.uint64) * _ODD)


def _crc_table() -> np.ndarray:
    """What each byte adds to a CRC-32 (the reflected polynomial 0xEDB88320), by its definition."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_CRC = _crc_table()
#: Runs longer than this are left to zlib, one by one.
_CRC_BYTES = 64


def runs_crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """The unsigned crc32 of each byte run data[start:end], going on from the crc32 in before where it is given."""
    out = np.zeros(len(starts), np.uint32) if before is None else before.astype(np.uint32)
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    order = order[np.searchsorted(-size[order], -_CRC_BYTES) :]  # of _CRC_BYTES at most, longest first
    at, sizes = starts[order], -size[order]
    crc = ~out[order]
    for k in range(int(-sizes[0]) if len(order) else 0):
        n = int(np.searchsorted(sizes, -k))  # those of more than k bytes
        c = crc[:n]
        crc[:n] = _CRC[(c ^ data[at[:n] + k]) & np.uint32(0xFF)] ^ (c >> np.uint32(8))
    out[order] = ~crc
    for i in np.flatnonzero(size > _CRC_BYTES):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), 0 if before is None else int(before[i]))
    return out


def runs_text(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.LargeStringArray:
    """The byte runs data[start:end] as strings; they have to be whole UTF-8."""
    size = ends - starts
    first = np.cumsum(size) - size
    gathered = data[np.repeat(starts - first, size) + np.arange(int(size.sum()))]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(first, size.sum()).astype(np.int64)), pa.py_buffer(gathered))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of h[i : i + n] for each i; shorter by n - 1 than h. Spans are put together from powers of two."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, have, power, span = None, 0, h, 1
    while True:
        if n & span:
            out = power.copy() if out is None else pair(out[: len(power) - have], power[have:][: len(out)])
            have += span
        if 2 * span > n:
            return out[: len(h) - n + 1]
        power, span = pair(power[:-span], power[span:]), 2 * span


def gram_rows(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first word, hash) of each n-gram that lies inside one row."""
    g = grams(h, n)
    whole = np.flatnonzero(row[: len(g)] == row[n - 1 :]) if len(g) else np.zeros(0, np.int64)
    return whole, g[whole]


def per_row(row: np.ndarray, n_rows: int) -> np.ndarray:
    """Where each row's entries start in row (sorted), with the end appended."""
    return np.searchsorted(row, np.arange(n_rows + 1))
