"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items share seeds of SEED words. For each document and item that share
one, tiles are laid: the longest matches of unmarked words, found through Karp-Rabin hashes, are
marked, longest first, until none of at least SEED words is left. An item is contained in a
document if its tiles cover enough of its words; where they stand in the document doesn't matter.

The benchmark is a stated query set. It is prepared in blocks, one stored file each, and a task
reads one block at a time for each slice of its documents, so that what a task holds is bounded
however large the benchmark is. Nothing of the documents is shuffled and nothing is broadcast.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import discard, flat, read_whole, released, run_dir, slices, small_batches, stored, write_whole
from .words import mix, words

SEED = 5
#: Bytes of item text in a block; an item that is longer has a block of its own.
BLOCK_BYTES = 4 << 20
#: Pairs of equal places that are held at once.
PAIRS = 1 << 20


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all k-word stretches."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = out * base + h[i : len(h) - k + 1 + i]
    return out


def _open(free: np.ndarray, k: int) -> np.ndarray:
    """Places at which k free words begin."""
    marked = np.concatenate([[0], np.cumsum(~free)])
    return marked[k:] == marked[:-k]


def matches(doc: np.ndarray, item: np.ndarray, free_d: np.ndarray, free_i: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(words, place in item, place in doc) of all maximal runs of k equal free words or more.

    Equal k-word hashes are pairs of places; a run is a row of neighbouring pairs on one diagonal.
    Diagonals are taken in blocks, so that no more than about PAIRS pairs are held.
    """
    if len(doc) < k or len(item) < k:
        return []
    gi, gd = grams(item, k), grams(doc, k)
    at_i, at_d = np.flatnonzero(_open(free_i, k)), np.flatnonzero(_open(free_d, k))
    known = np.unique(gi[at_i])
    if not len(known):
        return []
    code = np.searchsorted(known, gd[at_d])
    hit = known[np.minimum(code, len(known) - 1)] == gd[at_d]
    at_d, code = at_d[hit], code[hit]
    n = len(doc)
    keys = np.sort(code * n + at_d)
    want = np.searchsorted(known, gi[at_i])
    total = int((np.searchsorted(keys, want * n + n) - np.searchsorted(keys, want * n)).sum())
    low, high = -len(item), n
    width = max(1, -(-(high - low) // max(1, -(-total // PAIRS))))
    out: list[tuple[int, int, int]] = []
    for first in range(low, high, width):
        a = np.searchsorted(keys, want * n + np.clip(at_i + first, 0, n))
        b = np.searchsorted(keys, want * n + np.clip(at_i + first + width, 0, n))
        count = b - a
        if not count.sum():
            continue
        p = np.repeat(at_i, count)
        q = keys[np.repeat(a - np.cumsum(count) + count, count) + np.arange(count.sum())] % n
        order = np.argsort((q - p + len(item)) * n + q, kind="stable")
        p, q = p[order], q[order]
        new = np.ones(len(p), bool)
        new[1:] = (q[1:] != q[:-1] + 1) | (p[1:] != p[:-1] + 1)
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, len(p))) + k - 1
        out += zip(length.tolist(), p[start].tolist(), q[start].tolist())
    return out


def tiles(doc: np.ndarray, item: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """(place in doc, place in item, words) of maximal non-overlapping matches, longest first;
    equal lengths in the order of their places in the item, then in the document.

    Matches of k words or more wait in a heap. One that a longer tile has cut is put back as the
    stretches that are left of it; when the heap is empty, k is halved down to least.
    """
    free_d, free_i = np.ones(len(doc), bool), np.ones(len(item), bool)
    found: list[tuple[int, int, int]] = []
    k = max(least, min(len(item), 64))
    while True:
        heap = [(-n, p, q) for n, p, q in matches(doc, item, free_d, free_i, k)]
        heapq.heapify(heap)
        while heap:
            n, p, q = heapq.heappop(heap)
            n = -n
            good = free_d[q : q + n] & free_i[p : p + n] & (doc[q : q + n] == item[p : p + n])
            if good.all():
                free_d[q : q + n] = free_i[p : p + n] = False
                found.append((q, p, n))
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]])))
            for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if y - x >= k:
                    heapq.heappush(heap, (x - y, p + x, q + x))
        if k == least or not free_i.any():
            return found
        k = max(least, k // 2)


class Items:
    """One block of the benchmark, ready for search."""

    def __init__(self, ids: np.ndarray, h: np.ndarray, first: np.ndarray):
        self.ids, self.hash, self.first = ids, h, first
        size = np.minimum(np.diff(first), SEED)
        self.lengths = np.unique(size[size > 0]).tolist()
        seeds, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        item = np.repeat(np.arange(len(ids)), np.diff(first))
        for k in self.lengths:
            g = grams(h, k)
            own = item[: len(g)]
            take = (own == item[k - 1 :]) & (size[own] == k)
            seeds.append(mix(g[take] + np.uint64(k)))
            owner.append(own[take])
        seeds, owner = np.concatenate(seeds), np.concatenate(owner)
        order = np.lexsort((owner, seeds))
        seeds, owner = seeds[order], owner[order]
        new = np.ones(len(seeds), bool)
        new[1:] = (seeds[1:] != seeds[:-1]) | (owner[1:] != owner[:-1])
        self.seeds, self.owner = seeds[new], owner[new]

    def words(self, i: int) -> np.ndarray:
        return self.hash[self.first[i] : self.first[i + 1]]

    def hits(self, h: np.ndarray, row: np.ndarray) -> list[tuple[int, int]]:
        """(row, item) that share a seed, in order."""
        found = [np.zeros(0, np.int64)]
        for k in self.lengths:
            if len(h) < k:
                continue
            g = mix(grams(h, k) + np.uint64(k))
            left = np.searchsorted(self.seeds, g)
            at = np.flatnonzero((self.seeds[np.minimum(left, len(self.seeds) - 1)] == g) & (row[: len(g)] == row[k - 1 :]))
            place = np.unique(row[at] * len(self.seeds) + left[at])  # a seed once in each row
            r, left = place // len(self.seeds), place % len(self.seeds)
            count = np.searchsorted(self.seeds, self.seeds[left], side="right") - left
            for x in range(0, len(r), 4096):
                y = slice(x, x + 4096)
                own = self.owner[np.repeat(left[y] - np.cumsum(count[y]) + count[y], count[y]) + np.arange(count[y].sum())]
                found.append(np.unique(np.repeat(r[y], count[y]) * len(self.ids) + own))
        both = np.unique(np.concatenate(found))
        return list(zip((both // max(1, len(self.ids))).tolist(), (both % max(1, len(self.ids))).tolist()))


def prepared(benchmark: DataFrame) -> list[str]:
    """Files of the benchmark's blocks: ids, hashes of words and their bounds by item."""
    spark = benchmark.sparkSession
    items = stored(benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropDuplicates(), "items")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, folder = max(1, -(-size // BLOCK_BYTES)), run_dir(spark, "benchmark")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None

        def done(block: int) -> pa.RecordBatch:
            ids, h, count = (np.concatenate(x) for x in zip(*held))
            out = io.BytesIO()
            np.savez(out, ids=ids, hash=h, first=np.concatenate([[0], np.cumsum(count)]))
            uri = f"{folder}/block-{block:06d}.npz"
            write_whole(uri, lambda f: f.write(out.getvalue()))
            held.clear()
            return pa.RecordBatch.from_pydict({"uri": [uri]})

        for b in slices(batches):
            block = b.column("block").to_numpy()
            for x in np.flatnonzero(np.r_[True, block[1:] != block[:-1]]).tolist():
                part = b.slice(x, int((block == block[x]).sum()))
                if last is not None and block[x] != last:
                    yield done(last)
                last = int(block[x])
                w = words(*flat(part.column("text")))
                held.append((part.column("item_id").to_numpy(), w.hash, np.diff(w.first)))
        if held:
            yield done(last)

    placed = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block").sortWithinPartitions("block", "item_id", "text")
    uris = sorted(r.uri for r in stored(placed.mapInArrow(released(write), "uri string"), "blocks").collect())
    discard(items)
    return uris


def _tiled(docs: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame:
    """Each row of docs as a struct _row, beside what its tiles say."""
    uris = prepared(benchmark)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").cast("string").alias("_text"))
    schema = rows.select("_row", F.array().cast("array<long>").alias("_hits"), F.lit(None).cast("long").alias("_best"), F.lit(0.0).alias("_cover"), F.lit(0).cast("long").alias("_tiles")).schema

    def load(uri: str) -> Items:
        with np.load(io.BytesIO(read_whole(uri))) as x:
            return Items(x["ids"], x["hash"], x["first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = load(uris[0]) if len(uris) == 1 else None
        for b in slices(batches, "_text", 4 << 20 if len(uris) > 1 else 1 << 20):
            w = words(*flat(b.column("_text")))
            n = b.num_rows
            hits: dict[int, set[int]] = {}
            best: dict[int, tuple[float, int, int]] = {}
            for uri in uris:
                find = one or load(uri)
                for r, i in find.hits(w.hash, w.row):
                    item = find.words(i)
                    found = tiles(w.hash[w.first[r] : w.first[r + 1]], item, min(SEED, len(item)))
                    cover = sum(x for _, _, x in found) / len(item)
                    best[r] = max(best.get(r, (0.0, -(1 << 63), 0)), (cover, -int(find.ids[i]), len(found)))
                    if cover >= threshold:
                        hits.setdefault(r, set()).add(int(find.ids[i]))
            none = (0.0, None, 0)
            some = [best.get(r, none) for r in range(n)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("_row"),
                    pa.array([sorted(hits.get(r, ())) for r in range(n)], pa.list_(pa.int64())),
                    pa.array([None if i is None else -i for _, i, _ in some], pa.int64()),
                    pa.array([c for c, _, _ in some], pa.float64()),
                    pa.array([t for _, _, t in some], pa.int64()),
                ],
                ["_row", "_hits", "_best", "_cover", "_tiles"],
            )

    small_batches(docs.sparkSession)
    return rows.mapInArrow(released(run), schema)


def tile(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs with hit_items (ids of contained items, ascending), best_item (most covered; smallest
    id of equals), its coverage and n_tiles (null, 0 and 0 without any seed), contaminated. Columns
    of docs with one of these names are left out.

    Words are compared without ASCII case. Null or empty texts and items contain nothing. An item
    under SEED words must stand in whole. Items repeated under several ids are all listed. Repeated
    rows each have their row. Very long and repetitive texts are tiled whole: pairs of equal places
    are held PAIRS at a time.
    """
    added = {"hit_items": F.col("_hits"), "best_item": F.col("_best"), "coverage": F.col("_cover"), "n_tiles": F.col("_tiles"), "contaminated": F.size("_hits") > 0}
    own = [F.col("_row")[c].alias(c) for c in docs.columns if c not in added]
    return _tiled(docs, benchmark, threshold).select(*own, *(c.alias(k) for k, c in added.items()))


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that contain no benchmark item, with all of their own columns."""
    return _tiled(docs, benchmark, threshold).filter(F.size("_hits") == 0).select("_row.*")
