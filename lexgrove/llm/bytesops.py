"""Vectorised word and n-gram hashing on the raw UTF-8 buffers of Arrow columns.

A word is a maximal run of ASCII letters or digits (letters folded to lower
case) and non-ASCII bytes; everything else separates words.  Words are told
apart by a mixed 64-bit polynomial hash, so no Python string is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

FOLD = np.zeros(256, np.uint8)
for _c in range(256):
    _ch = chr(_c)
    if _c >= 128 or (_ch.isascii() and _ch.isalnum()):
        FOLD[_c] = ord(_ch.lower()) if _c < 128 else _c

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i in 0..n, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 20)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if size <= 1 << 21:  # those for longer texts aren't kept
            _powers[base] = have
    return have[: n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; nulls have length 0."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_string())
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if off is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``most`` bytes (one row at least)."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


def hash_spans(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans."""
    n = len(folded)
    cum = np.empty(n + 1, np.uint64)
    cum[0] = 0
    np.cumsum((folded.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n)[:n], out=cum[1:])
    h = (cum[ends] - cum[starts]) * _power(_INV, n)[starts]
    h ^= (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(h)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte, byte after the last and row of each word, in order."""
    folded = FOLD[data]
    inside = folded != 0
    if not inside.any():
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return hash_spans(folded, starts, ends), starts, ends, np.repeat(np.arange(len(offsets) - 1), counts)


def ngrams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word and row of each run of n words of one row.

    A row of fewer words than n has one n-gram of all its words.
    """
    m = len(h)
    if not m:
        return h, np.zeros(0, np.int64), row
    start = np.arange(m)
    whole = np.zeros(m, bool)
    if m >= n:
        whole[: m - n + 1] = row[n - 1 :] == row[: m - n + 1]
    opens = np.ones(m, bool)
    opens[1:] = row[1:] != row[:-1]
    at = start[whole | (opens & ~whole)]
    g = np.zeros(len(at), np.uint64)
    for k in range(n):
        to = np.minimum(at + k, m - 1)
        same = (row[to] == row[at]) & (at + k < m)
        part = np.where(same, h[to], np.uint64(0))
        g = mix(g * np.uint64(0x2545F4914F6CDD1D) + part)
    return g, at, row[at]


def order_by_row(row: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Reorders ``order`` so that rows ascend, without moving entries of one row against another."""
    r = row[order]
    if len(r) and r.max() < 1 << 16:
        r = r.astype(np.uint16)
    return order[np.argsort(r, kind="stable")]


def distinct_grams(g: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, row), ordered by row and hash."""
    order = order_by_row(row, np.argsort(g))
    g, row = g[order], row[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    return g[new], row[new]
