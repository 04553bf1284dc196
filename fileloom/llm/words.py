"""Words of texts as numpy arrays: [^\\x20\\x09-\\x0D]+ over UTF-8 bytes, A-Z lower-cased."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _small_powers(base: int) -> tuple[np.ndarray, int]:
    out, step = np.empty(1024, np.uint64), 1
    for k in range(1024):
        out[k] = step
        step = step * base & 0xFFFFFFFFFFFFFFFF
    return out, step


_STEPS = {base: _small_powers(base) for base in (_BASE, _INVERSE)}


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers modulo 2^64, as products of two short tables; nothing long is kept."""
    low, step = _STEPS[base]
    high = np.full(-(-n // 1024), np.uint64(step))
    high[:1] = 1
    return np.multiply.outer(np.multiply.accumulate(high), low).reshape(-1)[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n + 1 sums from which span_hash takes the hash of any span."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers(_BASE, len(data) + 1)[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts:ends] by content alone."""
    back = powers(_INVERSE, len(sums) + 1)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """As span_hash over prefix_hash(data), for spans in order that don't overlap: only places
    within spans are needed, and one short table of powers serves most of them."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    at = np.arange(int(size.sum())) + np.repeat(starts - np.cumsum(size) + size, size)
    off = at - np.repeat(starts, size)
    values = _TABLE[data[at]] * powers(_BASE, int(size.max()))[off]
    some = np.flatnonzero(size > 0)
    out = np.zeros(len(starts), np.uint64)
    out[some] = np.add.reduceat(values, (np.cumsum(size) - size)[some]) if len(some) else 0
    return mix(out + size.astype(np.uint64))


class Words(NamedTuple):
    row: np.ndarray  #: row of each word
    start: np.ndarray  #: byte bounds
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  #: n + 1 bounds of each row's words


def words(data: np.ndarray, bounds: np.ndarray) -> Words:
    data = _LOWER[data]
    inside = ~_SPACE[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    cuts = bounds[:-1][np.diff(bounds) > 0]
    opens[cuts] = inside[cuts]
    start = np.flatnonzero(opens)
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    closes[cuts[1:] - 1] |= inside[cuts[1:] - 1]
    end = np.flatnonzero(closes) + 1
    first = np.searchsorted(start, bounds)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    return Words(row, start, end, spans_hash(data, start, end), first)


def shingle_sets(w: Words, n_rows: int, size: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingles of size words as sorted 64-bit hashes, and the n + 1 bounds of
    the rows. Fewer words are one shingle in whole, and a row without words has none."""
    count = np.diff(w.first)
    length = np.minimum(count, size)
    at = np.flatnonzero(np.arange(len(w.row)) + length[w.row] <= w.first[1:][w.row]) if len(w.row) else np.zeros(0, int)
    row = w.row[at]
    h = np.full(len(at), np.uint64(0x5851F42D4C957F2D)) + length[row].astype(np.uint64)
    for k in range(size):
        more = k < length[row]
        h = np.where(more, mix(h * np.uint64(3) + w.hash[np.minimum(at + k, len(w.hash) - 1)]), h) if len(at) else h
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(n_rows + 1))
