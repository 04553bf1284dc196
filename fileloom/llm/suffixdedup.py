"""Suffix-array dedup: bytes covered by a LENGTH-byte string that also starts anywhere else.

Every LENGTH-byte string contains one anchor, chosen by its content alone: the GRAM-byte stretch
of the smallest hash in it, the leftmost of equals. Two equal strings have equal anchors at equal
places in them, so a repeated string is found by comparing what surrounds equal anchors, and only
anchors whose stretch occurs again are looked at.

The texts from the anchors on form a sparse suffix array. It is sorted deep-shallow: multikey
quicksort on 8-byte keys to SHALLOW bytes, then a blind trie for each group that is still equal.
The texts before the anchors are sorted the same way, read backwards. Neighbours' common prefixes
give, for any depths, classes of suffixes that agree so far. A string that starts o bytes before
its anchor is repeated where two anchors share both the backward class at depth o and the forward
class at depth LENGTH - o.

Equal texts are one text with a count, and equal surroundings are one row with a count, both
combined before they are shuffled. Anchors that very many different surroundings share are not
sorted in one place: see halved().

Beside the bytes, runs of RUN words that stand in several texts are found the same way, by the
least RUN_GRAM-word stretch in each run, and confirmed by the hash of the whole run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .shared import discard, flat, released, slices, stored
from .words import Words, mix, prefix_hash, span_hash, words

LENGTH = 400
GRAM = 128
SHALLOW = 160
#: Different surroundings of one anchor that are sorted together, in about a second; more are halved.
GROUP = 4000
PIECE = 16_000  #: surroundings that a task sorts at once, of as many groups as fit
RUN = 50
RUN_GRAM = 16
_PLACE = 24  #: bits of a place in a segment
_SEGMENT = 1 << 20


def leftmost_least(h: np.ndarray, span: int) -> np.ndarray:
    """Place of the least hash, the leftmost of equals, in each stretch of span hashes."""
    n = len(h)
    key = ((h >> np.uint64(_PLACE)) << np.uint64(_PLACE)) | np.arange(n).astype(np.uint64)
    padded = np.full(-(-n // span) * span, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = key
    ahead = np.minimum.accumulate(padded.reshape(-1, span), axis=1).reshape(-1)
    back = np.minimum.accumulate(padded.reshape(-1, span)[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(back[: n - span + 1], ahead[span - 1 : n])
    return (least & np.uint64((1 << _PLACE) - 1)).astype(np.int64)


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in row, hash) of every row's anchors, in order."""
    span = length - gram + 1
    rows, places, hashes = [], [], []
    starts = bounds[:-1]
    usable = np.diff(bounds) - length + 1
    for base in range(0, max(0, len(data) - length + 1), _SEGMENT):
        part = data[base : base + _SEGMENT + length - 1]
        n = len(part) - length + 1  # strings that start here
        sums = prefix_hash(part)
        at = np.arange(len(part) - gram + 1)
        h = span_hash(sums, at, at + gram)
        chosen = leftmost_least(h, span)
        row = np.searchsorted(bounds, base + np.arange(n), side="right") - 1
        whole = base + np.arange(n) - starts[row] < usable[row]
        new = np.ones(n, bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | ~whole[:-1]
        new &= whole
        pick = chosen[new]
        rows.append(row[new])
        places.append(base + pick - starts[row[new]])
        hashes.append(h[pick])
    if not rows:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.uint64)
    row, place, h = np.concatenate(rows), np.concatenate(places), np.concatenate(hashes)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1])  # of two segments
    return row[new], place[new], h[new]


def _rolled(h: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
    return mix(out)


def run_anchors(w: Words, run: int = RUN, gram: int = RUN_GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, first word in the slice, hash of its anchor) of every run of words within a row."""
    for base in range(0, max(0, len(w.hash) - run + 1), _SEGMENT):
        h, row = w.hash[base : base + _SEGMENT + run - 1], w.row[base : base + _SEGMENT + run - 1]
        g = _rolled(h, gram) ^ np.uint64(0x94D049BB133111EB)
        n = len(h) - run + 1
        good = np.flatnonzero(row[:n] == row[run - 1 :])
        yield row[good], base + good, g[leftmost_least(g, run - gram + 1)[good]]


class BlindTrie:
    """Orders suffixes that agree up to a depth. Inner nodes hold only where they branch and the
    bytes they branch by; a suffix is compared with one leaf, not with the way to it."""

    def __init__(self, rows: np.ndarray, lengths: np.ndarray, first: int):
        self.rows, self.lengths = rows, lengths
        self.root = [first]  # a leaf: suffixes that are equal

    def _byte(self, i: int, depth: int) -> int:
        return int(self.rows[i, depth]) if depth < self.lengths[i] else -1

    def insert(self, i: int) -> None:
        way, node = [], self.root
        while isinstance(node, tuple):
            way.append(node)
            depth, below = node
            node = below.get(self._byte(i, depth)) or next(iter(below.values()))
        j = node[0]
        n = int(min(self.lengths[i], self.lengths[j]))
        differ = self.rows[i, :n] != self.rows[j, :n]
        common = int(differ.argmax()) if differ.any() else n
        if common == n and self.lengths[i] == self.lengths[j]:
            node.append(i)
            return
        for k, (depth, below) in enumerate(way):
            if depth == common:
                below[self._byte(i, common)] = [i]
                return
            if depth > common:
                break
        else:
            k = len(way)
        old = way[k] if k < len(way) else node
        fresh = (common, {self._byte(j, common): old, self._byte(i, common): [i]})
        if k == 0:
            self.root = fresh
        else:
            depth, below = way[k - 1]
            below[self._byte(i, depth)] = fresh

    def ordered(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
            else:
                out.extend(node)
        return out


def deep_shallow(rows: np.ndarray, lengths: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """Order of the rows (n x width bytes, zero beyond their lengths; width a multiple of 8)."""
    keys = rows.view(">u8").astype(np.uint64)
    deepest = min(shallow // 8, keys.shape[1])
    out: list[int] = []
    stack = [(np.arange(len(rows)), 0)]
    while stack:
        some, d = stack.pop()
        if len(some) <= 1:
            out.extend(some.tolist())
        elif d >= deepest:
            some = some.tolist()
            trie = BlindTrie(rows, lengths, some[0])
            for i in some[1:]:
                trie.insert(i)
            out.extend(trie.ordered())
        else:
            key = keys[some, d]
            a, b, c = key[0], key[len(key) // 2], key[-1]
            pivot = max(min(a, b), min(max(a, b), c))
            low, high = key < pivot, key > pivot
            stack += [(some[high], d), (some[~(low | high)], d + 1), (some[low], d)]
    return np.array(out, np.int64)


def common_prefixes(rows: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before it in the order; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    for at in range(1, len(order), 1 << 15):
        x, y = order[at : at + (1 << 15)], order[at - 1 : at - 1 + (1 << 15)][: len(order[at : at + (1 << 15)])]
        differ = rows[x] != rows[y]
        n = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        out[at : at + len(x)] = np.minimum(n, np.minimum(lengths[x], lengths[y]))
    return out


def _padded(values: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    width = -(-width // 8) * 8
    lengths = np.array([len(v) for v in values], np.int64)
    rows = np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint8).reshape(len(values), width)
    return rows, lengths


def reach(before: list[bytes], after: list[bytes], times: np.ndarray, low: int = 0, high: int | None = None, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """How far before and after its anchor each row is covered by strings that start low to high - 1
    bytes before it; (0, 0) where it isn't. before is read backwards from the anchor; equal rows
    must be given once, with the times they occur."""
    n = len(after)
    rows, sizes = _padded(after, length)
    order = deep_shallow(rows, sizes)
    lcp = common_prefixes(rows, sizes, order)
    back_rows, back_sizes = _padded(before, length - gram)
    back_order = deep_shallow(back_rows, back_sizes)
    back_lcp = common_prefixes(back_rows, back_sizes, back_order)
    left, right = np.full(n, -1), np.full(n, -1)
    forward, backward = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for o in range(low, length - gram + 1 if high is None else high):
        forward[order] = np.cumsum(lcp < length - o)
        backward[back_order] = np.cumsum(back_lcp < o)
        both = forward * (n + 1) + backward
        by = np.argsort(both)
        same = np.zeros(n, bool)
        equal = both[by[1:]] == both[by[:-1]]
        same[by[1:]] |= equal
        same[by[:-1]] |= equal
        same |= times > 1
        same &= (sizes >= length - o) & (back_sizes >= o)
        left[same] = o
        first = same & (right < 0)
        right[first] = length - o
    # a pair that agrees further than the string needs is found at its own o
    return np.maximum(left, 0), np.maximum(right, 0)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (low, g) to (h, c, back, ahead) of those that are covered."""
    held: list[pa.RecordBatch] = []
    count = 0

    def done() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        left, right = reach(t.column("before").to_pylist(), t.column("after").to_pylist(), t.column("times").to_numpy(), t.column("low")[0].as_py(), t.column("high")[0].as_py())
        held.clear()
        return pa.RecordBatch.from_arrays([t.column("h").combine_chunks(), t.column("c").combine_chunks(), pa.array(left, pa.int32()), pa.array(right, pa.int32())], ["h", "c", "back", "ahead"]).filter(pa.array(right > 0))

    last = None
    for b in batches:
        if not b.num_rows:
            continue
        low, g = b.column("low").to_numpy(), b.column("g").to_numpy()
        new = np.r_[True, (low[1:] != low[:-1]) | (g[1:] != g[:-1])]
        new[0] = last != (low[0], g[0])
        starts = np.flatnonzero(new).tolist()
        at = 0
        for x in [*starts, b.num_rows]:  # a piece ends where a group does, and with each range
            if x > at:
                held.append(b.slice(at, x - at))
                count += x - at
            if x < b.num_rows and count and (count >= PIECE or (low[x - 1] if x else last[0]) != low[x]):
                yield done()
                count = 0
            at = x
        last = (low[-1], g[-1])
    if held:
        yield done()


#: What tells one half of one row's range, and what it can reach there, from others.
KEY = ["h", "low", "high", "g", "strong"]


def halved(state: DataFrame) -> DataFrame:
    """Surroundings whose group is too large, once for each half of the range of places, low to
    high - 1 bytes before the anchor, at which strings start and which their lengths allow.

    Two rows can only share a string of a range if they agree in low bytes before the anchor and in
    LENGTH - high + 1 from it on: that is the new group. Rows that agree in all that any string of
    the range can reach are one class, and one row from now on; if they are two or more, all of them
    are covered as far as the range goes. So each level leaves of a passage only those rows that see
    its edge, and in a range of one place rows that are still alone share no string.
    """
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    halves = F.array(F.struct("low", middle.alias("high")), F.struct(middle.alias("low"), "high"))
    halves = F.filter(halves, lambda x: (F.octet_length("before") >= x.low) & (F.octet_length("after") >= LENGTH - x.high + 1))
    own = state.withColumn("half", F.explode(halves)).withColumns({"low": F.col("half.low"), "high": F.col("half.high")})
    one = F.lit(1)
    near, far = F.substr("before", one, F.col("high") - 1), F.substr("after", one, LENGTH - F.col("low"))
    strong = F.md5(F.concat(near, F.lit(b"|"), far, F.octet_length(near).cast("string").cast("binary")))
    g = F.xxhash64("h", "low", F.substr("before", one, "low"), F.substr("after", one, LENGTH - F.col("high") + 1))
    return own.select("h", "c", "before", "after", "times", "low", "high", g.alias("g"), strong.alias("strong"))


def classes_of(own: DataFrame) -> DataFrame:
    """Each class of halved rows, with one row that stands for it and the times that all occur."""
    return own.groupBy(KEY).agg(F.min(F.struct("c", "before", "after")).alias("r"), F.sum("times").alias("times")).select(*KEY, "r.*", "times")


def known(own: DataFrame, classes: DataFrame) -> DataFrame:
    """(h, c, back, ahead) of the halved rows in classes that occur twice or more."""
    back, ahead = F.least(F.octet_length("before"), F.col("high") - 1), F.least(F.octet_length("after"), LENGTH - F.col("low"))
    again = own.select(*KEY, "c", back.alias("back"), ahead.alias("ahead")).filter(F.col("back") + F.col("ahead") >= LENGTH)
    return again.join(classes.filter("times > 1").select(KEY), KEY, "left_semi").select("h", "c", "back", "ahead")


def covered(kinds: DataFrame) -> DataFrame:
    """kinds(h, c, before, after, times), one row for each different surroundings c of an anchor h,
    to (h, c, back, ahead): how far before and after the anchor it is covered."""
    n = max(1, int(kinds.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    state = stored(kinds.select("h", "c", "before", "after", "times", F.lit(0).alias("low"), F.lit(LENGTH - GRAM + 1).alias("high"), F.col("h").alias("g")), "kinds")
    found: list[DataFrame] = []
    while True:  # nine levels at most
        large = stored(state.groupBy("low", "g").agg(F.count("*").alias("k")).filter(F.col("k") > GROUP).select("low", "g"), "large")
        hot = not large.isEmpty()
        small = state.join(large, ["low", "g"], "left_anti") if hot else state
        solved = small.repartition(n, "low", "g").sortWithinPartitions("low", "g").select("h", "c", "before", "after", "times", "low", "high", "g").mapInArrow(released(_solve), "h long, c string, back int, ahead int")
        found.append(stored(solved, "solved"))
        if not hot:
            break
        # stored, so that each row of a level is looked up and halved once for both of its uses
        own = stored(halved(state.join(large, ["low", "g"], "left_semi")), "halves")
        classes = stored(classes_of(own), "kinds")
        found.append(stored(known(own, classes), "known"))
        discard(state, large, own)
        state = classes.filter("high - low > 1").select("h", "c", "before", "after", "times", "low", "high", "g")
        state.stored_path = classes.stored_path  # for discard
    discard(state, large)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy("h", "c").agg(F.max("back").alias("back"), F.max("ahead").alias("ahead")) if len(found) > 1 else out


def removed(size: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The union of spans, as spans that don't touch, within 0 and size."""
    if not len(a):
        return []
    order = np.argsort(a, kind="stable")
    a, end = np.maximum(a[order], 0), np.maximum.accumulate(np.minimum(b[order], size))
    first = np.flatnonzero(np.r_[True, a[1:] > end[:-1]])
    return list(zip(a[first].tolist(), end[np.append(first[1:], len(a)) - 1].tolist()))


def _named(docs: DataFrame) -> DataFrame:
    data = F.coalesce(F.encode(F.col("text").cast("string"), "UTF-8"), F.lit(b""))
    digest = F.sha2(data, 256)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), data.alias("data"), digest.alias("digest"))


def _field(lists: pa.ListArray, k: int, name: str) -> np.ndarray:
    """One field of all structs in the k-th list."""
    x, y = lists.offsets[k].as_py(), lists.offsets[k + 1].as_py()
    return lists.values.field(name).slice(x, y - x).to_numpy(zero_copy_only=False)


def repeated(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows of docs as (doc_id, digest, n_bytes); the texts with repeated strings as (digest,
    data, spans), one row for each distinct text; and (digest, n_shared_words) of those that share
    runs of words."""
    named = _named(docs)
    rows = stored(named.select("doc_id", "digest", F.octet_length("data").cast("long").alias("n_bytes")), "rows")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "data"):
            data, bounds = flat(b.column("data"))
            row, place, h = anchors(data, bounds)
            found = [(row, place, h)]
            for row, _, h in run_anchors(words(data, bounds)):
                new = np.ones(len(h), bool)
                new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
                found.append((row[new], np.full(int(new.sum()), -1), h[new]))
            row, place, h = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([b.column("digest").take(pa.array(row)), pa.array(place.astype(np.int32)), pa.array(h.view(np.int64))], ["digest", "place", "h"])

    # RUN words take twice as many bytes, but for the last blank
    long_ones = named.filter(F.octet_length("data") >= 2 * RUN - 1)
    own = rows.filter(F.col("n_bytes") >= 2 * RUN - 1).groupBy("digest").agg(F.min("doc_id").alias("doc_id"), (F.count("*") > 1).alias("copied"))
    found = long_ones.select("digest", "data").mapInArrow(released(find), "digest string, place int, h long").select(F.unhex("digest").alias("digest"), "place", "h").distinct()
    found = stored(found, "anchors")
    again = stored(found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "again")
    marks = found.join(again, "h").groupBy("digest").agg(F.collect_list(F.struct("place", "h")).alias("marks")).withColumn("digest", F.lower(F.hex("digest")))
    wanted = marks.join(own, "digest")
    texts = long_ones.join(wanted.withColumnRenamed("digest", "d").withColumnRenamed("doc_id", "r"), (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("r"))).select("digest", "data", "marks", "copied")
    texts = stored(texts, "texts")
    discard(found, again)
    # repeated rows share their doc_id, and rows without one share none: only their texts are dealt again
    texts = texts.filter("not copied").union(stored(texts.filter("copied").dropDuplicates(["digest"]), "texts")).drop("copied")

    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach_back, kinds = LENGTH - GRAM, (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        names = ["digest", "place", "h", "before", "after"]
        for b in slices(batches, "data", 1 << 20):
            out: list[list] = [[], [], [], [], []]
            marks = b.column("marks")
            for k, (digest, data) in enumerate(zip(b.column("digest"), b.column("data"))):
                digest, data = digest.as_py(), data.as_py()
                place, h = _field(marks, k, "place"), _field(marks, k, "h")
                for p, x in zip(place[place >= 0].tolist(), h[place >= 0].tolist()):
                    for c, v in zip(out, (digest, p, x, data[max(0, p - reach_back) : p][::-1], data[p : p + LENGTH])):
                        c.append(v)
                    if len(out[0]) >= 4000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)
                        out = [[], [], [], [], []]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    around = texts.mapInArrow(released(surround), "digest string, place int, h long, before binary, after binary")
    around = around.withColumn("c", F.md5(F.concat(F.col("before"), F.lit(b"|"), F.col("after"), F.octet_length("before").cast("string").cast("binary"))))
    kinds = around.groupBy("h", "c").agg(F.first("before").alias("before"), F.first("after").alias("after"), F.count("*").alias("times"))
    solved = stored(covered(kinds), "solved")
    spans = around.select("digest", "place", "h", "c").join(solved, ["h", "c"]).groupBy("digest").agg(F.collect_list(F.struct((F.col("place") - F.col("back")).alias("a"), (F.col("place") + F.col("ahead")).alias("b"))).alias("spans"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "data"):
            w = words(*flat(b.column("data")))
            marks = b.column("marks")
            wanted = [_field(marks, k, "h")[_field(marks, k, "place") < 0].view(np.uint64) for k in range(b.num_rows)]
            keys = np.array([int(d.as_py()[:16], 16) for d in b.column("digest")], np.uint64).view(np.int64)
            whole = _rolled(w.hash, RUN) if len(w.hash) >= RUN else None
            for row, at, h in run_anchors(w):
                first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else []
                hit = np.zeros(len(row), bool)
                for x, y in zip(first, np.append(first[1:], len(row)).astype(int)):
                    hit[x:y] = np.isin(h[x:y], wanted[row[x]])
                r, p = row[hit], at[hit]
                yield pa.RecordBatch.from_arrays([b.column("digest").take(pa.array(r)), pa.array(keys[r]), pa.array((p - w.first[r]).astype(np.int64)), pa.array(whole[p].view(np.int64))], ["digest", "key", "place", "run"])

    some = stored(texts.filter(F.exists("marks", lambda m: m.place < 0)).mapInArrow(released(runs), "digest string, key long, place long, run long"), "runs")
    shared = some.groupBy("run").agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("a != b").select("run")
    at = some.join(shared, "run", "left_semi").select("digest", "place").distinct()
    step = F.lead("place").over(Window.partitionBy("digest").orderBy("place")) - F.col("place")
    shared_words = at.withColumn("n", F.least(F.coalesce(step, F.lit(RUN)), F.lit(RUN))).groupBy("digest").agg(F.sum("n").alias("n_shared_words"))
    return rows, texts.select("digest", "data").join(spans, "digest"), shared_words


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared_words, shares_passage.

    Null and empty texts, and texts under LENGTH bytes, lose nothing. Equal texts of LENGTH bytes or
    more lose everything, all of them, repeated rows of one doc_id included. Strings are judged on
    the input; overlapping repeats within one text count. n_shared_words, which removes nothing,
    counts the words in runs of RUN words that another, different text has too, whatever their
    case and the blanks between them; shares_passage is true where something is removed or shared.
    """
    rows, texts, shared_words = repeated(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "data"):
            out: list[list] = [[], [], [], []]
            spans = b.column("spans")
            for k, (digest, data) in enumerate(zip(b.column("digest"), b.column("data"))):
                data = data.as_py()
                gone = removed(len(data), _field(spans, k, "a"), _field(spans, k, "b"))
                kept, at = hashlib.sha256(), 0
                for x, y in gone:
                    kept.update(data[at:x])
                    at = y
                kept.update(data[at:])
                for c, v in zip(out, (digest.as_py(), sum(y - x for x, y in gone), len(gone), kept.hexdigest())):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], ["digest", "n_removed", "n_spans", "kept_sha256"])

    changed = stored(texts.mapInArrow(released(cut), "digest string, n_removed long, n_spans long, kept_sha256 string"), "changed")
    copies = rows.filter(F.col("n_bytes") >= LENGTH).groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest", F.lit(True).alias("whole"))
    both = copies.join(changed, "digest", "full").join(shared_words, "digest", "full")
    out = rows.join(both, "digest", "left")
    lost = F.when(F.coalesce("whole", F.lit(False)), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long")
    whole = F.coalesce("whole", F.lit(False))
    return out.select(
        "doc_id",
        "n_bytes",
        lost.alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
        F.coalesce("n_shared_words", F.lit(0)).alias("n_shared_words"),
        ((lost > 0) | (F.coalesce("n_shared_words", F.lit(0)) > 0)).alias("shares_passage"),
    )
