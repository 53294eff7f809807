"""Words and word shingles of Arrow string columns, hashed with numpy.

Everything works on the UTF-8 bytes of a slice of a column, so no Python object
is made for a word. Words and shingles are hashed with 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time; bounds a worker's memory whatever the batch size.
SLICE_BYTES = 1 << 18
MAX_ROWS = 60_000
KEY_BITS = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes (after A-Z are lowered) that belong to a word.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False


@dataclass
class Words:
    """Words of several rows in order: row number, byte range, 64-bit hash."""

    rows: int
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)

    def firsts(self) -> np.ndarray:
        """Index of each row's first word, and one past the last word at the end."""
        return np.concatenate([[0], np.cumsum(self.counts())])


def column(values) -> pa.Array:
    """A column as one array without nulls (null counts as empty)."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return pc.fill_null(values, "") if values.null_count else values


def raw(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offset of each row in them."""
    wide = pa.types.is_large_string(values.type)
    buffers = values.buffers()
    if len(values) == 0 or buffers[1] is None:
        return np.empty(0, np.uint8), np.zeros(len(values) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)
    offsets = offsets[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(values: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row stands alone, whole."""
    _, offsets = raw(values)
    at, n = 0, len(values)
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), at + MAX_ROWS, n)
        yield at, to
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit integers (an invertible finaliser)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_powers: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _base_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    out = []
    for base in (int(_BASE), pow(int(_BASE), -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps))
    if n <= 4 * SLICE_BYTES:
        _powers[:] = out
    return out[0], out[1]


def words(values: pa.Array, word_bytes: np.ndarray) -> Words:
    """The words of each row: longest runs of ``word_bytes`` once A-Z are lowered."""
    data, offsets = raw(values)
    n, rows = len(data), len(values)
    if n == 0:
        none = np.empty(0, np.int64)
        return Words(rows, none, none, none, np.empty(0, np.uint64), data, offsets)
    data = _LOWER[data]
    inside = word_bytes[data]
    edge = np.zeros(n + 1, dtype=bool)  # a row starts here
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    power, inverse = _base_powers(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    hashed = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    row = np.searchsorted(offsets, start, side="right") - 1
    return Words(rows, row, start, end, hashed, data, offsets)


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether they are in one row."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, bool)
    acc = w.hash[:n].copy()
    for j in range(1, k):
        acc = acc * _STEP + w.hash[j : j + n]
    return mix(acc + np.uint64(k)), w.row[:n] == w.row[k - 1 : k - 1 + n]


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit key of each distinct k-word shingle, sorted by both.

    A row of fewer words, but not none, has its whole sequence as one shingle.
    """
    hashed, whole = windows(w, k)
    row, key = w.row[: len(hashed)][whole], hashed[whole]
    counts, firsts = w.counts(), w.firsts()
    for m in range(1, k):
        short = np.flatnonzero(counts == m)
        if len(short):
            acc = w.hash[firsts[short]].copy()
            for j in range(1, m):
                acc = acc * _STEP + w.hash[firsts[short] + j]
            row, key = np.concatenate([row, short]), np.concatenate([key, mix(acc + np.uint64(m))])
    order = np.argsort(key)
    order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]  # a slice has at most MAX_ROWS rows
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[new], key[new]


def spread(firsts: np.ndarray, lasts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges [first, last), and the number of the range of each."""
    sizes = lasts - firsts
    which = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + firsts[which], which
