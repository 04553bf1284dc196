"""Cuts of texts at places where byte-level BPE with the usual word pattern never joins, and
a table of what the parts between them are worth.

A tokenizer that first splits by ``'s|'t|... ?letters| ?numbers| ?others|spaces`` has a bound
wherever a white-space character follows another kind of character, and wherever '.' or ','
follows a letter or digit. Cut there, a text's parts are encoded alone with the same result,
and parts repeat often enough to look their results up. Cuts, hashes and look-ups are numpy
operations over whole batches; only parts not seen before are handled one by one.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import spans_hash

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: After these bytes a white-space character certainly opens a new pre-token, if they do not end
#: a white-space character of several bytes.
_FIRM = np.zeros(256, bool)
_FIRM[33:127] = _FIRM[128:] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[[44, 46]] = True
#: Distinct parts whose results a worker keeps.
KEPT_PARTS = 1_500_000


def _wide_spaces(data: np.ndarray) -> np.ndarray:
    """Places of the last bytes of white-space characters beyond ASCII."""
    at = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if not len(at):
        return at
    b = [data[np.minimum(at + k, len(data) - 1)] for k in range(3)]
    two = (b[0] == 0xC2) & ((b[1] == 0x85) | (b[1] == 0xA0))
    general = (b[0] == 0xE2) & (b[1] == 0x80) & ((b[2] <= 0x8A) | (b[2] == 0xA8) | (b[2] == 0xA9) | (b[2] == 0xAF))
    other = ((b[0] == 0xE1) & (b[1] == 0x9A) & (b[2] == 0x80)) | ((b[0] == 0xE2) & (b[1] == 0x81) & (b[2] == 0x9F)) | ((b[0] == 0xE3) & (b[1] == 0x80) & (b[2] == 0x80))
    return np.concatenate([at[two] + 1, at[general | other] + 2])


def cut(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all parts, and the n + 1 bounds of each row's parts among them."""
    opens = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        firm = _FIRM[data[:-1]]
        firm[(wide := _wide_spaces(data))[wide < len(firm)]] = False
        opens[1:-1] = (_SPACE[data[1:]] & firm) | (_STOP[data[1:]] & _ALNUM[data[:-1]])
    opens[bounds[:-1][np.diff(bounds) > 0]] = True
    start = np.flatnonzero(opens[:-1])
    return start, np.searchsorted(start, bounds)


class PartTable:
    """Parts by their 64-bit hashes, with a run of values each, as learn(parts) gives them: all
    values one after another, and how many each part has."""

    def __init__(self, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], kind: np.dtype):
        self.learn, self.kind = learn, kind
        self.clear()

    def clear(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.values = np.zeros(0, self.kind)

    def __call__(self, data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, size) in self.values for each part of data; parts end where the next begins."""
        ends = np.append(start[1:], len(data))
        h, which, back = np.unique(spans_hash(data, start, ends), return_index=True, return_inverse=True)
        if len(self.hash) > KEPT_PARTS:
            self.clear()
        at = np.searchsorted(self.hash, h)
        known = self.hash[np.minimum(at, max(0, len(self.hash) - 1))] == h if len(self.hash) else np.zeros(len(h), bool)
        fresh = np.flatnonzero(~known)
        if len(fresh):
            raw = data.tobytes()
            values, size = self.learn([raw[a:b] for a, b in zip(start[which[fresh]].tolist(), ends[which[fresh]].tolist())])
            first = len(self.values) + np.cumsum(size) - size
            self.values = np.concatenate([self.values, values]).astype(self.kind, copy=False)
            place = at[fresh]
            self.hash, self.first, self.size = (np.insert(x, place, v) for x, v in ((self.hash, h[fresh]), (self.first, first), (self.size, size)))
            at = np.searchsorted(self.hash, h)
        return self.first[at][back], self.size[at][back]


def gather(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All runs of values one after another."""
    ends = np.cumsum(size)
    return values[np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def special_rows(texts: pa.Array, special: list[bytes]) -> np.ndarray:
    """Numbers of the texts that hold one of the special strings."""
    hit = np.zeros(len(texts), bool)
    for s in special:
        hit |= pc.fill_null(pc.match_substring(texts, s.decode()), False).to_numpy(zero_copy_only=False)
    return np.flatnonzero(hit)


_shared: dict[tuple, tuple] = {}


def per_worker(kind: str, path: str, make: Callable[[str], object]):
    """What make(path) gives, made once by each Python worker and file version."""
    key = (kind, path)
    stamp = os.stat(path).st_mtime_ns
    if key not in _shared or _shared[key][0] != stamp:
        _shared[key] = (stamp, make(path))
    return _shared[key][1]
