"""MinHash near-duplicates: HyperMinHash registers, banding, estimation, confirmation, components.

A document's distinct word shingles are hashed once. The hash's top bits choose a register; the
register stores the leading-zero count and the mantissa bits after it of its smallest remainder,
in 16 bits. Empty registers borrow from others by a fixed rule, so that two sets still agree in a
register with a probability of about their Jaccard similarity. Bands of registers propose links,
registers estimate them with a correction for chance collisions, and full sets confirm them.

Bands are never expanded into all pairs. Equal sets are one class, named by a number of its own. In
each band bucket all classes are compared with the bucket's smallest; mostly the bucket is then one
linked component. Where it is not, classes outside the largest component are held against the
others, in cells of bounded size: by registers first, and by full sets
where registers don't rule a link out. Only links that join components are returned. Pairs within
one component are not compared: they cannot change it. Pairs that share no band are not candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .shared import discard, flat, released, slices, small_batches, stored
from .words import mix, shingle_sets, words

REGISTERS = 128
ROWS = 4
MANTISSA = 10
#: Below this many standard deviations under the threshold a pair isn't confirmed.
DEVIATIONS = 6
#: Members, and outsiders, of a bucket in one cell of comparisons.
CELL_ROWS = 2048
#: Shingles of each side of a cell, some 32 MB of hashes; a larger document is alone on its side.
CELL_SHINGLES = 4 << 20
#: Rows that are compared with one hub in one task.
STAR_ROWS = 256
#: Bits of the map of wanted ids, 8 MB; beyond some tens of millions of ids it lets most texts pass.
MAP_BITS = 1 << 26

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _donors(rounds: int = 24) -> np.ndarray:
    """For each register the registers it borrows from, in order; the same for every document."""
    rng = np.random.default_rng(7)
    return rng.integers(0, REGISTERS, (REGISTERS, rounds))


_DONORS = _donors()


def registers(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows x REGISTERS of 16-bit HyperMinHash registers from each row's sorted hashes."""
    n = len(bounds) - 1
    rest = np.full((n, REGISTERS), _EMPTY)
    bits = REGISTERS.bit_length() - 1
    row = np.repeat(np.arange(n), np.diff(bounds))
    cell = row * REGISTERS + (h >> np.uint64(64 - bits)).astype(np.int64)
    new = np.ones(len(h), bool)
    new[1:] = cell[1:] != cell[:-1]  # sorted: the first of a cell is its smallest
    rest.reshape(-1)[cell[new]] = h[new] << np.uint64(bits)
    filled = rest != _EMPTY
    full = filled.copy()
    for k in range(_DONORS.shape[1]):
        need = ~full & filled[:, _DONORS[:, k]]
        if not need.any():
            if full.all():
                break
            continue
        r, c = np.nonzero(need)
        rest[r, c] = rest[r, _DONORS[c, k]]
        full[r, c] = True
    some = np.diff(bounds) > 0
    r, c = np.nonzero(~full & some[:, None])
    if len(r):  # none of the listed donors is filled: the next filled register to the right
        step = (c[:, None] + np.arange(1, REGISTERS + 1)) % REGISTERS
        rest[r, c] = rest[r, step[np.arange(len(r)), np.argmax(filled[r[:, None], step], axis=1)]]
    # leading zeros, then the bits after the leading one
    exponent = np.frexp(np.maximum(rest, np.uint64(1)).astype(np.float64))[1]
    over = (exponent > 1) & (rest < (np.uint64(1) << np.minimum(exponent - 1, 63).astype(np.uint64)))
    exponent = exponent - over  # float rounding may have carried
    zeros = np.minimum(64 - exponent, 63)
    mantissa = (rest << (zeros.astype(np.uint64) + np.uint64(1)) % np.uint64(64)) >> np.uint64(64 - MANTISSA)
    return (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """Rows x bands of 64-bit keys, different for each band."""
    bands = regs.reshape(len(regs), -1, ROWS).astype(np.uint64)
    key = np.zeros(bands.shape[:2], np.uint64)
    for k in range(ROWS):
        key = (key << np.uint64(16)) | bands[:, :, k]
    return mix(key + np.arange(bands.shape[1], dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected share of registers in which disjoint sets of n and m shingles agree by chance.

    A register's smallest remainder of k shingles lies in the cell [a, b) with probability
    (1 - a)^k - (1 - b)^k, for k = size / REGISTERS; the cells of one leading-zero count are
    equally wide and taken together.
    """
    out = np.zeros(len(n))
    k1, k2 = np.maximum(n / REGISTERS, 1.0), np.maximum(m / REGISTERS, 1.0)
    for z in range(40):
        top, low = 2.0**-z, 2.0 ** -(z + 1)
        p1 = np.exp(k1 * np.log1p(-low)) - (np.exp(k1 * np.log1p(-top)) if z else 0)
        p2 = np.exp(k2 * np.log1p(-low)) - (np.exp(k2 * np.log1p(-top)) if z else 0)
        out += p1 * p2 / 2**MANTISSA
    return out


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers, chance collisions taken out."""
    chance = collisions(n, m)
    return ((a == b).mean(axis=1) - chance) / (1 - chance)


def least_estimate(percent: int, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The estimate below which sets of n and m shingles aren't linked. Small sets fill few
    registers, and borrowed ones say nothing of their own: the fewer are expected to be filled,
    the further an estimate may be off."""
    own = REGISTERS * -np.expm1(-np.maximum(n, m) / REGISTERS)
    return percent / 100 - DEVIATIONS * np.sqrt(percent / 100 * (1 - percent / 100) / np.maximum(own, 1.0))


SIGNATURE = "doc_id long, n_shingles long, set_a long, set_b long, registers binary"


def fingerprints(h: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums over each row's set."""
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(x)]) for x in (mix(h), mix(h ^ np.uint64(0x6A09E667F3BCC909)))]
    return [(s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums]


def signatures(docs: DataFrame, size: int = 2) -> DataFrame:
    """Per document: set size, a 128-bit fingerprint of the set, and registers (null if empty)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data, bounds = flat(b.column("text"))
            h, at = shingle_sets(words(data, bounds), b.num_rows, size)
            regs = registers(h, at)
            prints = fingerprints(h, at)
            n = np.diff(at)
            raw = [regs[i].tobytes() if n[i] else None for i in range(len(n))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), *map(pa.array, prints), pa.array(raw, pa.binary())], ["doc_id", "n_shingles", "set_a", "set_b", "registers"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(released(sign), SIGNATURE)


def bands(classes: DataFrame) -> DataFrame:
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                regs = np.frombuffer(b"".join(b.column("registers").to_pylist()), np.uint16).reshape(b.num_rows, REGISTERS)
                keys = band_keys(regs)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(b.column("rep").to_numpy(), keys.shape[1]))], ["band", "rep"])

    return classes.select("rep", "registers").mapInArrow(released(spread), "band long, rep long")


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that sizes and register estimates don't rule out."""
    own = classes.select("rep", "n_shingles", "registers")
    left = own.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n"), F.col("registers").alias("ra"))
    right = own.select(F.col("rep").alias("b"), F.col("n_shingles").alias("m"), F.col("registers").alias("rb"))
    both = pairs.join(left, "a").join(right, "b").filter((100 * F.least("n", "m") >= percent * F.greatest("n", "m")))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
            n, m = (batch.column(c).to_numpy().astype(float) for c in ("n", "m"))
            good = estimate(ra, rb, n, m) >= least_estimate(percent, n, m)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good))

    return both.mapInArrow(released(keep), "a long, b long")


def likely(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose key may be one of ids: all that are, and others that share a bit
    with one in a map of MAP_BITS bits. The map has a fixed size, so it can be broadcast."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = F.pmod(F.xxhash64(key), F.lit(MAP_BITS))
    bit = F.bitmap_bit_position(at)
    spots = ids.select(F.bitmap_bucket_number(at).alias("part"), bit.alias("bit")).repartition(n, "part")
    bits = spots.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    byte = F.conv(F.hex(F.substr("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(bits), (F.bitmap_bucket_number(at) == F.col("part")) & (F.getbit(byte, (bit % 8).cast("int")) == 1), "left_semi")


def full_sets(docs: DataFrame, cells: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """The rows of cells(rep, cells) with members, the sorted shingle hashes of rep as bytes. A class
    is found by its smallest doc_id and its fingerprint, as several texts may bear one doc_id. A map
    of the ids keeps most texts that are not wanted from being hashed; sets are shuffled once, and
    joined in one way, by a merge, at every size."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data, bounds = flat(b.column("text"))
            h, at = shingle_sets(words(data, bounds), b.num_rows, size)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, fingerprints(h, at)), pa.array([h[at[i] : at[i + 1]].tobytes() for i in range(b.num_rows)], pa.binary())], ["doc_id", "set_a", "set_b", "members"])

    key = ["doc_id", "set_a", "set_b"]
    asked = stored(cells.join(classes.select("rep", *key), "rep"), "asked")
    texts = likely(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), asked.select("doc_id"))
    found = texts.mapInArrow(released(collect), "doc_id long, set_a long, set_b long, members binary")
    return found.groupBy(*key).agg(F.first("members").alias("members")).join(asked.hint("merge"), key).select("rep", "members", "cells")


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union of their full sets. The pairs of one a
    are a star around it: the set of a goes to each STAR_ROWS of them, and that of b to its star."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR_ROWS).cast("int").alias("parts"))
    hubs = parts.select(F.col("a").alias("rep"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"))
    rest = pairs.join(parts, "a").select(F.col("b").alias("rep"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), F.lit(1).alias("side"))
    stars = hubs.union(rest).groupBy("rep").agg(F.collect_list(F.struct("hub", "part", "side")).alias("cells"))
    held = full_sets(docs, stars, classes, size).select("rep", "members", F.explode("cells").alias("cell")).select("cell.*", "rep", "members")
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, x = None, None
        for batch in batches:
            a, b = [], []
            for k, rep, members in zip(batch.column("hub").to_pylist(), batch.column("rep").to_pylist(), batch.column("members")):
                y = np.frombuffer(members.as_buffer(), np.uint64)
                if k == rep:
                    hub, x = k, y.copy()
                    continue
                if k != hub:
                    raise ValueError("the documents have changed while they were compared")
                both = np.sort(np.concatenate([x, y]))
                inter = int((both[1:] == both[:-1]).sum())
                if 100 * inter >= percent * (len(both) - inter):
                    a.append(k)
                    b.append(rep)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return held.repartition(n, "hub", "part").sortWithinPartitions("hub", "part", "side").select("hub", "rep", "members").mapInArrow(released(check), "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) with the smallest id of each connected component, by alternating large-star
    and small-star steps on tables in the shared folder; ids without edges are not listed."""
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    last = None
    for _ in range(rounds):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        top = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(top, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        now = stored(small, "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == last:
            break
        last = tuple(mark)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def intersections(q: list[np.ndarray], m: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of all intersections of sorted sets, queries x members. Shingles that many
    share are counted by a matrix product, the others one by one."""
    out = np.zeros((len(q), len(m)), np.float32)
    nq, nm = [np.array([len(x) for x in side]) for side in (q, m)]
    h = np.concatenate([*q, *m])
    owner = np.concatenate([np.repeat(np.arange(len(q)), nq), np.repeat(np.arange(len(m)), nm)])
    is_q = np.arange(len(h)) < nq.sum()
    _, column = np.unique(h, return_inverse=True)
    cq = np.bincount(column[is_q], minlength=column.max(initial=-1) + 1)
    cm = np.bincount(column[~is_q], minlength=len(cq))
    busy = cq * cm
    dense = np.flatnonzero(busy > max(64, len(q) * len(m) // 64))
    place = np.full(len(cq), -1)
    place[dense] = np.arange(len(dense))
    where = place[column]
    for at in range(0, len(dense), 2048):
        here = (where >= at) & (where < at + 2048)
        x, y = np.zeros((len(q), 2048), np.float32), np.zeros((len(m), 2048), np.float32)
        x[owner[here & is_q], where[here & is_q] - at] = 1
        y[owner[here & ~is_q], where[here & ~is_q] - at] = 1
        out += x @ y.T
    light = (busy > 0) & (place < 0)
    left, right = is_q & light[column], ~is_q & light[column]
    if left.any():
        order = np.argsort(column[right], kind="stable")
        col, own = column[right][order], owner[right][order]
        first = np.searchsorted(col, column[left])
        n = cm[column[left]]
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        flat_at = np.repeat(owner[left], n) * len(m) + own[at]
        out += np.bincount(flat_at, minlength=out.size).reshape(out.shape)
    return out


#: Rows that are compared: of one small family or of one band of a large one, in a cell.
CELL = ["large", "band", "chunk", "block"]


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell, from batches in the order of cells."""
    last, held = None, []
    for b in batches:
        keys = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in CELL], axis=1)
        cuts = (np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()
        for x, y in zip([0, *cuts], [*cuts, len(keys)]):
            if y > x:
                if held and tuple(keys[x]) != last:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held = []
                last = tuple(keys[x])
                held.append(b.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def compare_outsiders(buckets: DataFrame, family: DataFrame, own: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that join components: each class outside the largest component of its unit
    against all of the unit, in cells of about CELL_ROWS x CELL_ROWS, and of no more than some
    CELL_SHINGLES on a side. Buckets that share members make a family; a family that fits a cell is one unit, so that its members are compared once,
    and of a larger one each bucket is a unit, so that only pairs that share a band are compared,
    in the bucket of the first band they share. All buckets of two classes of different components
    are open, so that one is always there.
    Registers choose the rows of a cell that may have a link at all; only their full sets are
    shuffled."""
    named = own.select(F.col("id").alias("rep"), F.col("component").alias("c"))
    kin = family.select(F.col("id").alias("rep"), F.col("component").alias("family"))
    kin = kin.join(classes.select("rep", "n_shingles"), "rep").join(named, "rep", "left").select("rep", "family", "n_shingles", F.coalesce("c", "rep").alias("component"))
    kin = stored(kin.join(kin.groupBy("family").agg(F.count("*").alias("k")), "family").withColumn("large", F.col("k") > CELL_ROWS), "kin")
    # a bucket of a large family is open if a member is outside the family's largest component
    large = kin.filter("large")
    major = large.groupBy("family", "component").agg(F.count("*").alias("k")).groupBy("family").agg(F.max(F.struct("k", "component")).alias("top")).select("family", F.col("top.component").alias("major"))
    outside = large.join(major, "family").filter("component != major").select("rep")
    touched = buckets.join(outside, "rep", "left_semi").select("band").distinct()
    units = kin.filter("not large").select("large", F.col("family").alias("band"), "rep", "component", "n_shingles")
    # a class has a bucket in each band at most: its buckets are gathered before it is joined, once
    within = buckets.join(touched, "band", "left_semi").groupBy("rep").agg(F.collect_list("band").alias("bands"))
    members = units.union(within.join(large, "rep").select("large", F.explode("bands").alias("band"), "rep", "component", "n_shingles"))
    parts = members.groupBy("large", "band", "component").agg(F.count("*").alias("k"), F.sum("n_shingles").alias("n"))
    whole = parts.groupBy("large", "band").agg(F.max(F.struct("k", "component", "n")).alias("top"), F.sum("k").alias("k"), F.sum("n").alias("n"), F.count("*").alias("parts")).filter("parts > 1")
    cells = lambda k, n: F.ceil(F.greatest(k / CELL_ROWS, n / CELL_SHINGLES)).cast("int")
    whole = whole.select("large", "band", F.col("top.component").alias("major"), cells(F.col("k"), F.col("n")).alias("blocks"), cells(F.col("k") - F.col("top.k"), F.col("n") - F.col("top.n")).alias("chunks"))
    open_ = stored(members.drop("n_shingles").join(whole, ["large", "band"]), "open")
    place = F.xxhash64("rep")
    asked = F.when(F.col("component") != F.col("major"), F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.pmod(place, "chunks").cast("int").alias("chunk"), k.alias("block"), F.lit(True).alias("asks")))).otherwise(F.array())
    there = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(k.alias("chunk"), F.pmod(place, "blocks").cast("int").alias("block"), F.lit(False).alias("asks")))
    n = max(1, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = lambda rows: rows.repartition(n, *CELL).sortWithinPartitions(*CELL)

    def sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        asks = np.asarray(t.column("asks")).astype(bool)
        return np.unique(t.column("component").to_numpy(), return_inverse=True)[1], np.flatnonzero(asks), np.flatnonzero(~asks)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_cell(batches):
            label, q, m = sides(t)
            size = t.column("n_shingles").to_numpy().astype(float)
            regs = np.frombuffer(b"".join(t.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            hit = np.zeros(len(size), bool)
            # of the buckets of a large family that two classes share, that of the first band compares them
            band = int(np.argmax(band_keys(regs[:1])[0].view(np.int64) == t.column("band")[0].as_py())) if t.column("large")[0].as_py() else 0
            for at in range(0, len(q), 64):
                x, y = np.repeat(q[at : at + 64], len(m)), np.tile(m, len(q[at : at + 64]))
                likely = (label[x] != label[y]) & (100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y]))
                x, y = x[likely], y[likely]
                if band and len(x):
                    fresh = ~(regs[x, : band * ROWS] == regs[y, : band * ROWS]).reshape(len(x), band, ROWS).all(axis=2).any(axis=1)
                    x, y = x[fresh], y[fresh]
                if len(x):
                    likely = estimate(regs[x], regs[y], size[x], size[y]) >= least_estimate(percent, size[x], size[y])
                    hit[x[likely]] = hit[y[likely]] = True
            yield from t.select([*CELL, "rep", "component", "asks"]).filter(pa.array(hit)).to_batches()

    def solve(t: pa.Table) -> list[tuple[int, int]]:
        label, q, m = sides(t)
        ids, held = t.column("rep").to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("members")]
        size = np.array([len(x) for x in held], np.float64)
        root = list(range(int(label.max()) + 1))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for at in range(0, len(q), 64):
            some = q[at : at + 64]
            inter = intersections([held[i] for i in some], [held[i] for i in m]).astype(np.float64)
            good = (100 * inter >= percent * (size[some][:, None] + size[m][None, :] - inter)) & (label[some][:, None] != label[m][None, :])
            r, c = np.nonzero(good)
            _, one = np.unique(label[some[r]] * len(root) + label[m[c]], return_index=True)
            for k in one:
                x, y = find(int(label[some[r[k]]])), find(int(label[m[c[k]]]))
                if x != y:
                    root[x] = y
                    out.append((int(ids[some[r[k]]]), int(ids[m[c[k]]])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_cell(batches):
            found = solve(t)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    own_cells = open_.groupBy("rep").agg(F.collect_list(F.struct("large", "band", "component", "major", "blocks", "chunks")).alias("units")).join(classes.select("rep", "n_shingles", "registers"), "rep")
    seen = own_cells.select("rep", "n_shingles", "registers", F.explode("units").alias("u")).select("rep", "n_shingles", "registers", "u.*")
    seen = seen.withColumn("cell", F.explode(F.concat(asked, there))).select("large", "band", "cell.chunk", "cell.block", "rep", "component", "cell.asks", "n_shingles", "registers")
    chosen = stored(dealt(seen).mapInArrow(released(choose), "large boolean, band long, chunk int, block int, rep long, component long, asks boolean"), "chosen")
    listed = chosen.groupBy("rep").agg(F.collect_list(F.struct(*CELL, "component", "asks")).alias("cells"))
    held = full_sets(docs, listed, classes, size).select("rep", "members", F.explode("cells").alias("cell"))
    return dealt(held.select("cell.*", "rep", "members")).select(*CELL, "rep", "component", "asks", "members").mapInArrow(released(run), "a long, b long").distinct()



def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 2) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked where 100 * |A and B| >= percent * |A or B| of their sets of size-word shingles,
    and component_id is the smallest doc_id reachable. Null and empty texts have no shingles and are
    linked with nothing; equal texts are one class, repeated rows too, and several texts under one
    doc_id are each linked as their own. A row without doc_id is alone, and kept.

    Two sets at the threshold share no band with a probability of (1 - 0.8^4)^32, 5 in 10^8.
    Components settle in some ten rounds at most for the usual shapes; sixty without an end is an
    error, not a result.
    """
    small_batches(docs.sparkSession)
    signed = stored(signatures(docs, size), "signatures")
    filled = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("doc_id"), F.first("registers").alias("registers"))
    # numbers given while the table is written, and read from it alone
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    # by a window, which shuffles the bands once at every size
    within = Window.partitionBy("band")
    keyed = bands(classes).select("band", "rep", F.min("rep").over(within).alias("hub"), F.count("*").over(within).alias("n"))
    buckets = stored(keyed.filter("n > 1").drop("n"), "buckets")
    pairs = stored(buckets.filter("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    wanted = stored(likely(classes, ends, "rep").join(ends.hint("merge"), "rep"), "wanted")
    links = stored(confirm(stored(plausible(pairs, wanted, percent), "plausible"), wanted, docs, size, percent), "links")
    own = stored(components(links), "linked")
    family = stored(components(pairs), "families")
    more = stored(compare_outsiders(buckets, family, own, wanted, docs, size, percent), "links")
    discard(pairs, wanted, buckets)
    linked = components(links.union(more)).select(F.col("id").alias("rep"), "component")
    labels = classes.join(linked, "rep", "left").select("set_a", "set_b", F.col("n_shingles").alias("n"), "doc_id", F.coalesce("component", "rep").alias("component"))
    least = labels.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    labels = stored(labels.join(least, "component").select("set_a", "set_b", "n", "component_id"), "labels")
    out = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(labels, (signed.set_a == labels.set_a) & (signed.set_b == labels.set_b) & (signed.n_shingles == labels.n) & signed.doc_id.isNotNull(), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_copies(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """docs with one document of each near-duplicate group, that with the smallest doc_id. Rows
    that repeat a doc_id stand or fall together; rows without doc_id stay."""
    gone = near_duplicates(docs, percent, size).filter("not kept").select("doc_id").distinct()
    return docs.join(stored(gone, "copies"), "doc_id", "left_anti").select(*docs.columns)
