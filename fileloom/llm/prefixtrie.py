"""Conversation prefix tries: which beginnings of conversations are shared, by how many, and what
storing them once would save.

A turn is known by 128 bits of its role and text, so texts are read once and never shuffled. A node,
that is a distinct sequence of first turns, is known by the sum of 128 bits of each turn at its
place, kept as four lanes modulo 2^32: sums over a conversation are prefix sums, which `running`
takes in ranges of rows, so that one conversation may hold a third of them.

Equal conversations become one sequence with a count before anything else. Nodes with more than
SHARD_TURNS turns below them are heavy; all others belong to the shard of their highest light
ancestor. Each task builds level-order tries of its shards in numpy: a LOUDS bit vector (for each
node in breadth-first order a 1 for each child, then a 0), an array of turn labels, and parents by
rank and select. Sums and least members go up in reverse breadth-first order. Heavy nodes get what
their shards' roots hand up, through one conversation that passes them, by one more running sum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import discard, released, stored

#: Conversations of one hundred share the beginning of the first of them.
FAMILY = 100
#: The most turns that are taken from it.
HEAD = 6
#: Turns below a node from which it is heavy: a task holds one shard of so many turns, some 100
#: bytes each, or several that are smaller together.
SHARD_TURNS = 200_000
#: Bytes of decimal ids that travel in one row.
CHUNK = 1 << 16
LANES = ["k0", "k1", "k2", "k3"]
KEY = ["depth", "hi", "lo"]


def running(df: DataFrame, by: list[str], order: list[str], number: str | None = None, sums: dict[str, str] | None = None) -> DataFrame:
    """df with the place of each row within by, from 1 in the given order (number), and running sums
    of columns up to and with it. Rows are ranged by by and order together, so a value of by with a
    third of all rows is spread too; what meets in one place is a row for each value and partition."""
    spark, sums = df.sparkSession, sums or {}
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order)
    ranged = stored(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    totals = ranged.groupBy(*by, "_part").agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_s{i}") for i, c in enumerate(sums)))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*(F.col(c).alias(f"_b{i}") for i, c in enumerate(by)), F.col("_part").alias("_p"), *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_c{c[1:]}") for c in ["_n", *(f"_s{i}" for i in range(len(sums)))]))
    local = Window.partitionBy(*by, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = ranged.select("*", F.count("*").over(local).alias("_n"), *(F.sum(c).over(local).alias(f"_s{i}") for i, c in enumerate(sums)))
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    both = own.join(carried, same)
    added = ([(F.col("_n") + F.col("_cn")).alias(number)] if number else []) + [(F.col(f"_s{i}") + F.col(f"_cs{i}")).alias(name) for i, name in enumerate(sums.values())]
    out = stored(both.select(*(c for c in df.columns if c not in sums.values()), *added), "running")
    discard(ranged)
    return out


def _lanes(text: Column) -> list[Column]:
    hexed = F.md5(text.cast("binary"))
    return [F.conv(F.substring(hexed, 1 + 8 * i, 8), 16, 10).cast("long").alias(c) for i, c in enumerate(LANES)]


def _packed(high: str, low: str) -> Column:
    """Two lanes modulo 2^32 as one long."""
    return F.shiftleft(F.col(high) % (1 << 32), 32).bitwiseOR(F.col(low) % (1 << 32))


def _longs(hexed: str) -> list[Column]:
    """The 128 bits of a hex text as two longs."""
    half = lambda at: F.conv(F.substring(hexed, at, 16), 16, -10).cast("long")
    return [half(1).alias("l_hi"), half(17).alias("l_lo")]


def head_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return (F.crc32(conv.cast("string").cast("binary")) % HEAD).cast("int")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """turns(c, depth, label, chars) of every rebuilt conversation, convs(c, turns) with the number
    of its turns, also 0, and the stored tables that both read."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    label = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    own = conversations.filter("conv_id is not null").select(F.col("conv_id").alias("c"), F.col("turn").alias("at"), label.alias("label"), F.length(text).cast("long").alias("chars"))
    own = running(own, ["c"], ["at", "label"], number="pos")
    base = F.col("c") - F.col("c") % FAMILY
    heads = own.filter((F.col("c") % FAMILY == 0) & (F.col("pos") < HEAD)).select(F.col("c").alias("base"), "pos", "label", "chars")
    convs = own.groupBy("c").agg(F.count("*").alias("n")).select("c", "n", base.alias("base"), head_turns(F.col("c")).alias("h"))
    taken = heads.groupBy("base").agg(F.count("*").alias("there"))
    convs = convs.join(taken, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    convs = stored(convs.select("c", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("turns")), "convs")
    first = convs.join(heads, "base").filter(F.col("pos") <= F.col("h")).select("c", F.col("pos").alias("depth"), "label", "chars")
    rest = own.join(convs.select("c", "h", "taken"), "c").filter(F.col("pos") > F.col("h")).select("c", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "label", "chars")
    return first.unionByName(rest), convs.select("c", F.col("turns").cast("long").alias("turns")), [own, convs]


class Louds:
    """A forest in level order. Node 0 stands above the roots; bits has for each node a 1 for each of
    its children and then a 0; labels are numbered turns."""

    def __init__(self, place: np.ndarray, label: np.ndarray):
        """Turns of sequences, one after the other; place runs from 0 in each."""
        n = len(place)
        self.of_row = np.zeros(n, dtype=np.int64)  # the node of every row
        order = np.argsort(place, kind="stable")
        bounds = np.searchsorted(place[order], np.arange(int(place.max(initial=-1)) + 2))
        counts, labels, self.levels, made = [np.zeros(0, np.int64)], [np.array([-1])], [(0, 1)], 1
        for d in range(len(bounds) - 1):
            rows = order[bounds[d] : bounds[d + 1]]
            above = self.of_row[rows - 1] if d else np.zeros(len(rows), dtype=np.int64)
            by = np.lexsort((label[rows], above))
            a, x = above[by], label[rows][by]
            new = np.ones(len(rows), dtype=bool)
            new[1:] = (a[1:] != a[:-1]) | (x[1:] != x[:-1])
            self.of_row[rows[by]] = made - 1 + np.cumsum(new)
            low, high = self.levels[-1]
            counts.append(np.bincount(a[new] - low, minlength=high - low))
            labels.append(x[new])
            self.levels.append((made, made + int(new.sum())))
            made += int(new.sum())
        self.labels = np.concatenate(labels)
        low, high = self.levels[-1]
        self.children = np.concatenate([*counts, np.zeros(high - low, dtype=np.int64)])
        # each node's ones, then its zero
        self.bits = np.ones(int(self.children.sum()) + made, dtype=bool)
        self.bits[np.cumsum(self.children + 1) - 1] = False
        # the i-th 1 is child i; the zeros before it are the nodes that have ended: rank0(select1(i))
        self.parent = np.concatenate([[-1], (np.cumsum(~self.bits))[np.flatnonzero(self.bits)]])

    def rolled(self, values: np.ndarray, into=np.add) -> np.ndarray:
        """Values of nodes with those of all below, level by level from the deepest."""
        out = values.copy()
        for low, high in reversed(self.levels[1:]):
            into.at(out, self.parent[low:high], out[low:high])
        return out


NODE = pa.schema([("depth", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("up_hi", pa.int64()), ("up_lo", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64())])
NODES = "depth long, hi long, lo long, up_hi long, up_lo long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def shard_nodes(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    """The nodes of whole shards. rows(s_hi, s_lo, c, depth, hi, lo, up_hi, up_lo, l_hi, l_lo, chars, ends)
    sorted by shard, c and depth; ends is the number of conversations that end at the row."""
    c, depth = rows["c"], rows["depth"]
    starts = np.ones(len(c), dtype=bool)
    starts[1:] = c[1:] != c[:-1]
    place = depth - depth[np.maximum.accumulate(np.where(starts, np.arange(len(c)), 0))]
    # a shard's root is labelled by the shard, as two shards may begin with the same turn
    shard = (np.diff(rows["s_hi"], prepend=rows["s_hi"][0]) != 0) | (np.diff(rows["s_lo"], prepend=rows["s_lo"][0]) != 0)
    _, label = np.unique(np.stack([rows["l_hi"], rows["l_lo"]], axis=1), axis=0, return_inverse=True)
    trie = Louds(place, np.where(place == 0, np.cumsum(shard), label.reshape(-1)))
    made = len(trie.labels)
    first = np.zeros(made, dtype=np.int64)
    first[trie.of_row[::-1]] = np.arange(len(c))[::-1]
    ended = np.zeros(made, dtype=np.int64)
    np.add.at(ended, trie.of_row, rows["ends"])
    least = np.full(made, np.iinfo(np.int64).max)
    np.minimum.at(least, trie.of_row[rows["ends"] > 0], c[rows["ends"] > 0])
    n, least = trie.rolled(ended), trie.rolled(least, np.minimum)
    leaves = trie.rolled((trie.children == 0).astype(np.int64))
    own = (n - 1) * rows["chars"][first]
    own[0] = 0
    saved = trie.rolled(own)
    up = least[trie.parent]
    root = trie.parent == 0
    columns = [rows[k][first][1:] for k in ("depth", "hi", "lo", "up_hi", "up_lo")] + [least[1:], pa.array(up[1:], mask=root[1:]), n[1:], trie.children[1:], leaves[1:], saved[1:]]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=NODE)


def _shards(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append({k: batch.column(k).to_numpy(zero_copy_only=False) for k in batch.schema.names})
            if sum(len(h["c"]) for h in held) < limit:
                continue
            rows = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            last = (rows["s_hi"] == rows["s_hi"][-1]) & (rows["s_lo"] == rows["s_lo"][-1])
            cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0  # the last shard may go on
            if cut:
                yield shard_nodes({k: v[:cut] for k, v in rows.items()})
            held = [{k: v[cut:] for k, v in rows.items()}]
        if held and (rows := {k: np.concatenate([h[k] for h in held]) for k in held[0]})["c"].size:
            yield shard_nodes(rows)

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted (depth, hi, lo, c) as texts of ids, CHUNK bytes and some at most."""
    for batch in batches:
        depth, hi, lo, c = (batch.column(k).to_numpy() for k in ("depth", "hi", "lo", "c"))
        if not len(c):
            continue
        new = np.ones(len(c), dtype=bool)
        new[1:] = (depth[1:] != depth[:-1]) | (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        new |= np.arange(len(c)) % (CHUNK // 20) == 0
        at = np.flatnonzero(new)
        texts = [",".join(map(str, c[a:b].tolist())) for a, b in zip(at, [*at[1:], len(c)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (depth, hi, lo, c)] + [pa.array(texts, pa.string())], names=["depth", "hi", "lo", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's texts in order, from a stream: only the digest's state is held."""
    key, state = None, None
    for batch in batches:
        out = []
        for d, h, lo, ids in zip(*(batch.column(k).to_pylist() for k in ("depth", "hi", "lo", "ids")), strict=True):
            if (d, h, lo) == key:
                state.update(b"," + ids.encode())
                continue
            if key:
                out.append((*key, state.hexdigest()))
            key, state = (d, h, lo), hashlib.sha256(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["depth", "hi", "lo", "ends_sha256"])
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], names=["depth", "hi", "lo", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """ends_sha256 of ends(depth, hi, lo, c). Ids are written as texts in ranges first; SHA-256 has
    no parts that could be joined, so a node's texts then pass one task, as a stream."""
    n = max(1, int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = ends.repartitionByRange(n, *KEY, "c").sortWithinPartitions(*KEY, "c")
    texts = ranged.mapInArrow(_texts, "depth long, hi long, lo long, first long, ids string")
    return texts.repartition(n, *KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_digests, "depth long, hi long, lo long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, and the node's key (hi, lo); its last turn is turn depth of the rebuilt conv_id.

    Rows without conv_id belong to no conversation and go. Null roles and texts are empty; turns of
    one number (nulls come first) stand in the order of a hash of role and text, and repeated rows are
    turns as often as they come. Negative ids have the family of their quotient towards zero. Very
    long texts are read once, for their hash and length. An empty table gives no node, not even the
    root. Other columns are not read, whatever their names.
    """
    spark = conversations.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows, convs, parts = rebuilt(conversations)
    lanes = rows.select("c", "depth", "label", "chars", *_lanes(F.concat_ws(":", F.col("depth").cast("string"), "label")))
    summed = running(lanes, ["c"], ["depth"], sums={k: f"t{k}" for k in LANES})
    before = [(F.col(f"t{k}") - F.col(k)).alias(f"u{k}") for k in LANES]
    keyed = summed.select("c", "depth", *_longs("label"), "chars", *(f"t{k}" for k in LANES), *before)
    keyed = stored(keyed.select("c", "depth", "l_hi", "l_lo", "chars", _packed("tk0", "tk1").alias("hi"), _packed("tk2", "tk3").alias("lo"), _packed("uk0", "uk1").alias("up_hi"), _packed("uk2", "uk3").alias("up_lo")), "keyed")
    # where each conversation ends, and one of each kind
    last = keyed.select("c", F.col("depth").alias("turns"), "hi", "lo").join(convs, ["c", "turns"], "right")
    ends = stored(last.select("c", F.col("turns").alias("depth"), F.coalesce("hi", F.lit(0)).alias("hi"), F.coalesce("lo", F.lit(0)).alias("lo")), "ends")
    kinds = ends.groupBy(*KEY).agg(F.min("c").alias("c"), F.count("*").alias("ends"))
    kinds = stored(kinds.select("c", F.col("depth").alias("turns"), F.col("ends").alias("members")), "kinds")
    some = stored(keyed.join(kinds, "c").withColumn("ends", F.when(F.col("depth") == F.col("turns"), F.col("members")).otherwise(0)), "sequences")
    discard(*parts, summed, keyed, kinds)
    # heavy nodes, and of each sequence how deep they go and which shard the rest is in
    heavy = some.groupBy(*KEY).agg(F.sum(F.col("turns") - F.col("depth") + 1).alias("below")).filter(F.col("below") > shard_turns).select(*KEY, F.lit(True).alias("heavy"))
    marked = stored(some.join(heavy, KEY, "left").withColumn("heavy", F.coalesce("heavy", F.lit(False))), "marked")
    top = marked.filter("not heavy").groupBy("c").agg(F.min(F.struct("depth", "hi", "lo")).alias("top")).select("c", F.col("top.hi").alias("s_hi"), F.col("top.lo").alias("s_lo"))
    light = marked.filter("not heavy").join(top, "c").select("s_hi", "s_lo", "c", "depth", "hi", "lo", "up_hi", "up_lo", "l_hi", "l_lo", "chars", "ends")
    dealt = light.repartition(n, "s_hi", "s_lo").sortWithinPartitions("s_hi", "s_lo", "c", "depth")
    nodes = stored(dealt.mapInArrow(released(_shards(shard_turns)), NODES), "nodes")
    above = _heavy_nodes(marked.filter("heavy"), nodes)
    discard(some, marked)
    return _finished(nodes, above, ends)


def _heavy_nodes(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The heavy nodes. rows are the heavy rows of the sequences. A shard's root hands its sums to the
    last heavy row of the sequence of its least member, a heavy node its own saving to its row in the
    sequence of its least member; sums run up these sequences, and a node's rows add up to its own."""
    key = [*KEY, "up_hi", "up_lo"]
    mine = stored(rows.groupBy(*key).agg(F.min("c").alias("conv_id"), F.sum("members").alias("n_convs"), F.max("chars").alias("chars")), "above")
    roots = nodes.filter("parent_conv_id is null")
    child = roots.select(*key).unionByName(mine.select(*key)).groupBy((F.col("depth") - 1).alias("depth"), F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).agg(F.count("*").alias("n_children"))
    whole = stored(mine.join(child, KEY, "left").fillna(0, ["n_children"]), "above")
    handed = roots.select(F.col("conv_id").alias("c"), (F.col("depth") - 1).alias("depth"), "n_leaves", "saved_tokens")
    own = whole.select(F.col("conv_id").alias("c"), "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("saving"), F.when(F.col("n_children") == 0, 1).otherwise(0).alias("leaf"))
    entered = rows.select("c", *KEY).join(handed, ["c", "depth"], "left").join(own, ["c", "depth"], "left").fillna(0)
    entered = entered.select("c", *KEY, (F.col("n_leaves") + F.col("leaf")).alias("leaves"), (F.col("saved_tokens") + F.col("saving")).alias("saved"), (-F.col("depth")).alias("from"))
    up = running(entered, ["c"], ["from"], sums={"leaves": "n_leaves", "saved": "saved_tokens"})
    sums = up.groupBy(*KEY).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    none = F.lit(None).cast("long").alias("parent_conv_id")
    out = stored(whole.join(sums, KEY).select(*key, "conv_id", none, "n_convs", "n_children", "n_leaves", "saved_tokens"), "heavy")
    discard(mine, whole, up)
    return out


def _finished(nodes: DataFrame, above: DataFrame, ends: DataFrame) -> DataFrame:
    """Shards, heavy nodes and the root together, with parents and digests."""
    both = nodes.unionByName(above)
    first = both.filter("depth = 1").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    whole = ends.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")).first()
    zero = F.lit(0).cast("long")
    root = first.filter(F.lit(whole.n_convs > 0)).select(zero.alias("depth"), zero.alias("hi"), zero.alias("lo"), F.lit(None).cast("long").alias("up_hi"), F.lit(None).cast("long").alias("up_lo"), F.lit(whole.conv_id).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(whole.n_convs).cast("long").alias("n_convs"), "n_children", F.coalesce(F.when(F.col("n_children") > 0, F.col("n_leaves")), F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"))
    parents = above.select((F.col("depth") + 1).alias("depth"), F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv_id").alias("p"))
    known = both.join(parents, ["depth", "up_hi", "up_lo"], "left")
    parent = F.coalesce("parent_conv_id", F.when(F.col("depth") == 1, F.lit(whole.conv_id).cast("long")), "p")
    known = known.withColumn("parent_conv_id", parent).drop("p").unionByName(root)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    done = known.join(end_digests(ends), KEY, "left")
    return done.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"), "hi", "lo")
