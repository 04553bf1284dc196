"""Token counts by rank-synchronous merging of ragged numpy arrays.

Distinct pre-tokens of a batch lie one after another in one array of symbols. Each round looks up
the rank of every neighbouring pair, takes each sequence's lowest rank, and merges all of its
non-overlapping occurrences in all sequences at once. A sequence leaves when none of its pairs has
a rank; its surviving symbols are its tokens.

Merging all occurrences of the lowest pair at once equals merging them one by one: a merge made of
the new symbol was learned after it and so ranks higher.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import PartTable, cut, per_worker, special_rows
from .shared import flat, released, slices

#: Symbols merged at once.
BATCH_SYMBOLS = 1 << 20


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others, in order, for code points from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(spare)
            spare += 1
    return [out[b] for b in range(256)]


class Merger:
    """Counts of tokens for one byte-level BPE vocabulary file."""

    def __init__(self, tokenizer: str):
        import regex
        from public_tokenizers import PATTERN

        with open(tokenizer, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.size = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made
        self.byte = np.array([vocab[s] for s in byte_symbols()], np.int32)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.table = PartTable(self._learn, np.dtype(np.int64))

    def ranks(self, symbols: np.ndarray, same: np.ndarray) -> np.ndarray:
        """Rank of each symbol with its right neighbour; the largest int32 where there is none."""
        out = np.full(len(symbols), np.iinfo(np.int32).max, np.int32)
        at = np.flatnonzero(same)
        key = symbols[at].astype(np.int64) * self.size + symbols[at + 1]
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[place] == key
        out[at[hit]] = self.rank[place[hit]]
        return out

    def count(self, tokens: list[str]) -> np.ndarray:
        """Symbols that survive in each pre-token."""
        raw = [t.encode("utf-8", "surrogatepass") for t in tokens]
        sizes = np.array([len(r) for r in raw], np.int64)
        result = sizes.copy()
        none = np.iinfo(np.int32).max
        ends = np.cumsum(sizes)
        at = 0
        while at < len(raw):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_SYMBOLS)))
            symbols = self.byte[np.frombuffer(b"".join(raw[at:to]), np.uint8)]
            owner = np.repeat(np.arange(to - at), sizes[at:to])
            while len(symbols):
                same = np.zeros(len(symbols), bool)
                same[:-1] = owner[:-1] == owner[1:]
                rank = self.ranks(symbols, same)
                first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                lowest = np.minimum.reduceat(rank, first)
                live = lowest < none
                length = np.diff(np.r_[first, len(symbols)])
                ended = ~live
                result[at + owner[first[ended]]] = length[ended]
                if not live.any():
                    break
                lowest = np.repeat(lowest, length)
                take = (rank == lowest) & (rank < none)
                twice = take[1:] & take[:-1]
                if twice.any():  # runs such as "aaaa": every second place, from the run's left
                    where = np.flatnonzero(take)
                    run = np.cumsum(np.r_[True, np.diff(where) > 1])
                    begin = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
                    nth = np.arange(len(where)) - np.repeat(begin, np.diff(np.r_[begin, len(where)]))
                    take[where[nth % 2 == 1]] = False
                symbols = symbols.copy()
                symbols[take] = self.made[rank[take]]
                keep = np.repeat(live, length)
                keep[1:] &= ~take[:-1]
                symbols, owner = symbols[keep], owner[keep]
            at = to
        return result

    def _learn(self, fresh: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.pattern.findall(p.decode()) for p in fresh]
        distinct = list({t for f in found for t in f})
        of = dict(zip(distinct, self.count(distinct).tolist()))
        return np.array([sum(map(of.__getitem__, f)) for f in found], np.int64), np.ones(len(fresh), np.int64)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each whole text. A special string inside a text is one token, as the library
        has it by default, and the text before and after it is split on its own."""
        odd = special_rows(texts, [s.encode() for s in self.special])
        out = self._plain(texts)
        for r in odd:
            pieces = self.cut_special.split(texts[int(r)].as_py())
            out[r] = len(pieces) - 1 + self._plain(pa.array(pieces, pa.string())).sum()
        return out

    def _plain(self, texts: pa.Array) -> np.ndarray:
        data, bounds = flat(texts)
        start, parts = cut(data, bounds)
        first, _ = self.table(data, start)
        return np.diff(np.concatenate([[0], np.cumsum(self.table.values[first])])[parts])


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """Per document: doc_id, n_bytes of UTF-8, n_tokens, over_limit (n_tokens > limit).

    A null text is empty: no bytes, no tokens. Repeated rows each have their row. Texts are read
    where they lie: nothing is shuffled, and a lost executor's partitions are simply read again.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = per_worker("counts", tokenizer, Merger)
        for b in slices(batches):
            n = merger(b.column("text"))
            _, bounds = flat(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(bounds)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(released(count), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
