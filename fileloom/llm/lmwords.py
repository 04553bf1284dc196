"""The model of `lm` with a context restaurant for every word, none of them shared.

A word's context is the word before it; a text's start is the context of the end token. The pairs of
word and context of a block are cut by ranges of word hashes into pieces and shuffled once. A piece
merges its pairs, keeps their customers, and for each block only the places of its pairs and words
among its own. Pairs with one customer have one table and never move; sweeps work on the others.

Totals of restaurants don't meet on the driver. A context's tables are summed in the hall of its own
word, which stands for a range of pieces: pieces send what they have of each context, halls answer
those that have pairs to reseat, and so once a sweep. A context's customers are its word's training
tokens. The driver holds sums of the whole model alone.

Pieces answer blocks with the discounted customers of pairs, and for words with the parent's
probabilities and, as contexts, their tables; the block puts them together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import lm
from .shared import discard, released, run_dir, small_batches

#: Rows for a piece or hall. other: block, or the piece or hall that a row comes from.
ROW = "piece int, other long, a binary, b binary, words long, guests long, tables long, top long, kind string"
NAMES = [x.split()[0] for x in ROW.split(", ")]
KINDS = pa.schema([("piece", pa.int32()), ("other", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("words", pa.int64()), ("guests", pa.int64()), ("tables", pa.int64()), ("top", pa.int64()), ("kind", pa.string())])
#: What a piece or hall has of its own comes before replies and messages.
FIRST = -1
#: Tokens to a hall: messages are as many as pieces times halls.
HALL_TOKENS = 1 << 24
#: Bytes of rows handed on at once.
HANDED = 1 << 20


def row(kind: str, piece: int, other: int, a: bytes | None, b: bytes | None = None, sums: tuple = (None,) * 4) -> tuple:
    return (piece, other, a, b, *sums, kind)


def handed(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about HANDED bytes."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 100 + len(r[2] or b"") + len(r[3] or b"")
        if size >= HANDED:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), KINDS.types)], schema=KINDS)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), KINDS.types)], schema=KINDS)


def piece_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def deltas(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=sorted_values.dtype.type(0))


def runs(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    if not len(sorted_values):
        return []
    cut = np.append(np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]), len(sorted_values)).tolist()
    return list(zip(cut, cut[1:]))


def pairs(known: np.ndarray, at: np.ndarray, number: np.ndarray) -> np.ndarray:
    """word number * words + context's number, of every token of a block."""
    end = np.searchsorted(known, lm.END)
    context = np.concatenate([[end], number[:-1]])
    context[at[:-1]] = end
    return number * len(known) + context


class Kept:
    """Rows in the shared folder, by kind."""

    def __init__(self, df: DataFrame, name: str):
        self.sparkSession, self.stored_path = df.sparkSession, run_dir(df.sparkSession, name)
        df.write.option("compression", "zstd").partitionBy("kind").parquet(self.stored_path)

    def rows(self, kind: str) -> DataFrame:
        return self.sparkSession.read.schema(ROW).parquet(self.stored_path).filter(F.col("kind") == kind).select(*NAMES)

    def sums(self) -> dict:
        """The whole model's words, customers, tables, and tables of the parent."""
        s = self.rows("active").agg(*(F.sum(c).alias(c) for c in ("words", "guests", "tables", "top"))).first()
        return {"words": int(s.words or 0), "guests": int(s.guests or 0), "tables": np.array([float(s.tables or 0)]), "top": float(s.top or 0)}


def met(n: int, *tables: DataFrame) -> DataFrame:
    """All rows of a piece one after another, by other."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.union(t)
    return rows.repartition(n, "piece").sortWithinPartitions("piece", "other")


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes, bytes]]]]:
    """(piece, its rows as other, a, b)."""
    last, held = None, []
    for b in batches:
        for piece, other, x, y in zip(b.column("piece").to_pylist(), b.column("other").to_pylist(), b.column("a"), b.column("b")):
            if held and piece != last:
                yield last, held
                held = []
            last = piece
            held.append((other, x.as_py(), y.as_py()))
    if held:
        yield last, held


def sent(tokenised: DataFrame, n: int) -> DataFrame:
    """All pairs of every block, by piece, with their training tokens, which may be none."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for block, vocabulary, texts in zip(b.column("block").to_pylist(), b.column("vocabulary"), b.column("texts")):
                known, _, at, out, number = lm.opened(vocabulary.as_py(), texts.as_py())
                pair, place = np.unique(pairs(known, at, number), return_inverse=True)
                count = np.bincount(place, ~np.repeat(out, np.diff(at)), len(pair)).astype(np.uint32)
                word, context = pair // len(known), pair % len(known)
                piece = piece_of(known, n)[word]
                for x, y in runs(piece):
                    w, each = np.unique(word[x:y], return_counts=True)
                    c, which = np.unique(context[x:y], return_inverse=True)
                    yield row("pairs", int(piece[x]), block, lm._packed(deltas(known[w]), each.astype(np.uint32), deltas(known[c]), which.astype(np.uint32), count[x:y]))

    return tokenised.select("block", "vocabulary", "texts").mapInArrow(released(lambda batches: handed(of(batches))), ROW)


def merged(counts: DataFrame, n: int, halls: int) -> DataFrame:
    """Of each piece: its active pairs at one table each, customers of all pairs and words, the places
    of each block's pairs and words among them; its words to their hall, and to the halls of its contexts
    its tables of each."""

    def of(piece: int, held: list[tuple[int, bytes, bytes]]) -> Iterator[tuple]:
        blocks, h, c, m, sizes = [], [], [], [], []
        for block, a, _ in held:
            w, each, s, which, count = lm._unpacked(a, np.uint64, np.uint32, np.uint64, np.uint32, np.uint32)
            blocks.append((block, np.cumsum(w)))
            h.append(np.repeat(blocks[-1][1], each))
            c.append(np.cumsum(s)[which])
            m.append(count)
            sizes.append(len(count))
        held.clear()
        words, word = np.unique(np.concatenate(h), return_inverse=True)
        contexts, context = np.unique(np.concatenate(c), return_inverse=True)
        pair, place = np.unique(word * len(contexts) + context, return_inverse=True)
        m = np.bincount(place, np.concatenate(m), len(pair)).astype(np.int64)
        word, context = pair // len(contexts), pair % len(contexts)
        total = np.bincount(word, m, len(words)).astype(np.int64)
        known = total > 0
        number, k = np.cumsum(known) - 1, int(known.sum())
        many, one = m > 1, m == 1
        asked, which = np.unique(context[many], return_inverse=True)
        fixed = [np.bincount(number[word[x]], minlength=k) for x in (many, one)]
        cuts = np.bincount(piece_of(contexts[asked], n) * halls // n, minlength=halls)
        yield row("active", piece, FIRST, lm._packed(*fixed, which.astype(np.uint32), m[many], cuts), lm._packed(np.ones(len(which), np.int64), np.ones(k, np.int64)), (k, int(total.sum()), int((m > 0).sum()), k))
        yield row("own", piece * halls // n, piece - n, lm._packed(deltas(words[known])))
        yield row("index", piece, FIRST, lm._packed(m, total))
        ends = np.cumsum(sizes)
        for (block, w), x, y in zip(blocks, ends - sizes, ends):
            yield row("index", piece, block, lm._packed(deltas(np.searchsorted(words, w)), deltas(place[x:y])))
        have, tables = np.unique(context[m > 0], return_counts=True)
        wants, hall = np.isin(have, asked), piece_of(contexts[have], n) * halls // n
        for x, y in runs(hall):
            yield row("sent", int(hall[x]), piece, lm._packed(deltas(contexts[have[x:y]]), tables[x:y], wants[x:y]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from handed(r for piece, held in grouped(batches) for r in of(piece, held))

    return met(n, counts).mapInArrow(released(run), ROW)


def opened_halls(own: DataFrame, messages: DataFrame, n: int) -> DataFrame:
    """Of each hall, tables of its contexts at one table a pair, where the contexts that a piece asks for
    stand among them, and how many are words of which piece; to the pieces, tables of what they ask for."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for hall, held in grouped(batches):
            mine = [(x + n, np.cumsum(lm._unpacked(a, np.uint64)[0])) for x, a, _ in held if x < 0]
            words = np.concatenate([w for _, w in mine])
            base, asked = np.zeros(len(words), np.int64), []
            for sender, message, _ in held[len(mine) :]:
                c, tables, wants = lm._unpacked(message, np.uint64, np.int64, bool)
                place = np.searchsorted(words, np.cumsum(c))
                base[place] += tables
                if wants.any():
                    asked.append((sender, place[wants]))
            sizes = np.array([len(x) for _, x in asked], np.int64)
            places = np.concatenate([deltas(x) for _, x in asked]) if asked else np.zeros(0, np.int64)
            pieces = np.array([(x, len(w)) for x, w in mine], np.int64)
            yield row("own", hall, FIRST, lm._packed(base, np.array([s for s, _ in asked], np.int64), sizes, places, pieces[:, 0], pieces[:, 1]), lm._packed())
            for sender, place in asked:
                yield row("reply", sender, hall, lm._packed(base[place]))

    return met(n, own, messages).mapInArrow(released(lambda batches: handed(of(batches))), ROW)


def summed_halls(own: DataFrame, messages: DataFrame, n: int, kept: int, keep: bool, last: bool) -> DataFrame:
    """The same after a sweep, from the tables beyond one a pair that pieces send; kept: sweeps that
    own rows hold already. After the last sweep, pieces have their words' tables of all kept ones."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for hall, ((_, a, b), *held) in grouped(batches):
            base, senders, sizes, places, pieces, lengths = lm._unpacked(a, *[np.int64] * 6)
            ends, more = np.cumsum(sizes).tolist(), {sender: message for sender, message, _ in held}
            place = [np.cumsum(places[y - k : y]) for y, k in zip(ends, sizes.tolist())]
            tables = base.copy()
            for sender, x in zip(senders.tolist(), place):
                tables[x] += lm._unpacked(more[sender], np.int64)[0]
            every = [*lm._unpacked(b, *[np.int64] * kept), *([tables] if keep else [])]
            if last:
                for piece, k, end in zip(pieces.tolist(), lengths.tolist(), np.cumsum(lengths).tolist()):
                    yield row("tables", piece, FIRST - 1, None, lm._packed(*(t[end - k : end] for t in every)))
                continue
            yield row("own", hall, FIRST, a, lm._packed(*every))
            for sender, x in zip(senders.tolist(), place):
                yield row("reply", sender, hall, lm._packed(tables[x]))

    return met(n, own, messages).mapInArrow(released(lambda batches: handed(of(batches))), ROW)


def swept(active: DataFrame, replies: DataFrame, n: int, state: dict, number: int, kept: int, keep: bool) -> DataFrame:
    """Active pairs after one more sweep under the totals of the last one, and to the halls of their
    contexts the tables beyond one a pair."""
    (d0, d1), (s0, s1) = lm.DISCOUNT, lm.STRENGTH

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for piece, ((_, a, b), *held) in grouped(batches):
            rng = np.random.default_rng([piece, number])
            many, ones, context, m, cuts = lm._unpacked(a, np.int64, np.int64, np.uint32, np.int64, np.int64)
            t, top, *rest = lm._unpacked(b, *[np.int64] * (2 + (1 + 2 * kept if kept else 0)))
            here = np.concatenate([lm._unpacked(x, np.int64)[0] for _, x, _ in held]) if held else np.zeros(0, np.int64)
            word, k = np.repeat(np.arange(len(many)), many), len(many)
            p = lm.parent_probability(np.bincount(word, t, k) + ones, top, state)
            t = lm.reseat(m, t, (s0 + d0 * here[context]) * p[word], 0, rng)
            up = np.bincount(word, t, k).astype(np.int64) + ones
            top = lm.reseat(up, top, np.full(k, (s1 + d1 * state["top"]) / (state["words"] + 1)), 1, rng)
            if keep:
                rest = [t + rest[0], *rest[1:], up, top] if rest else [t, up, top]
            yield row("active", piece, FIRST, a, lm._packed(t, top, *rest), (k, None, int(up.sum()), int(top.sum())))
            more, ends = np.bincount(context, t - 1, int(cuts.sum())).astype(np.int64), np.cumsum(cuts)
            for hall in np.flatnonzero(cuts).tolist():
                yield row("sent", hall, piece, lm._packed(more[ends[hall] - cuts[hall] : ends[hall]]))

    return met(n, active, replies).mapInArrow(released(lambda batches: handed(of(batches))), ROW)


def learn(tokenised: DataFrame, n: int, burn_in: int, sweeps: int) -> tuple[Kept, Kept, Kept, list[dict]]:
    """Pieces with their index, their active pairs, and halls after the last sweep, with the sums of the
    first state and of each kept sweep."""
    tokens = tokenised.agg(F.sum("n_tokens").alias("n")).first().n or 0
    pieces = Kept(merged(sent(tokenised, n), n, min(n, max(1, tokens // HALL_TOKENS))), "pieces")
    active, states = pieces, [pieces.sums()]
    halls = Kept(opened_halls(pieces.rows("own"), pieces.rows("sent"), n), "halls")
    state = states[0]
    for k in range(burn_in + sweeps):
        kept, keep = max(0, k - burn_in), k >= burn_in
        following = Kept(swept(active.rows("active"), halls.rows("reply"), n, state, k, kept, keep), "active")
        summed = Kept(summed_halls(halls.rows("own"), following.rows("sent"), n, kept, keep, k == burn_in + sweeps - 1), "halls")
        discard(halls, *([active] if active is not pieces else []))
        active, halls, state = following, summed, following.sums()
        if keep:
            states.append(state)
    return pieces, active, halls, states


def answers(pieces: Kept, active: Kept, halls: Kept, states: list[dict], n: int) -> DataFrame:
    """Rows block, piece, said: discounted customers of the block's pairs in the piece, and of its words
    training tokens, the parent's probabilities and, as contexts, tables, of each kept sweep."""
    s, d0 = len(states), lm.DISCOUNT[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seats = tables = total = None
        for b in batches:
            for piece, other, x, y in zip(b.column("piece").to_pylist(), b.column("other").to_pylist(), b.column("a"), b.column("b")):
                if other == FIRST - 2:
                    seats = lm._unpacked(y.as_py(), *[np.int64] * (3 + 2 * s))[2:]
                elif other == FIRST - 1:
                    tables = lm._unpacked(y.as_py(), *[np.int64] * s)
                elif other == FIRST:
                    m, total = lm._unpacked(x.as_py(), np.int64, np.int64)
                    known = total > 0
                    own = m.astype(np.float64)
                    own[m == 1] -= d0
                    own[m > 1] -= d0 * seats[0] / s
                    spread = []
                    for k, state in enumerate(states):
                        p = np.full(len(total), lm.parent_probability(np.zeros(1), np.zeros(1), state)[0])
                        p[known] = lm.parent_probability(seats[1 + 2 * k], seats[2 + 2 * k], state)
                        t = np.zeros(len(total), np.int64)
                        t[known] = tables[k]
                        spread += [p.astype(np.float32), t]
                else:
                    w, pair = (np.cumsum(v) for v in lm._unpacked(x.as_py(), np.int64, np.int64))
                    said = lm._packed(own[pair].astype(np.float32), total[w], *(v[w] for v in spread))
                    yield pa.RecordBatch.from_arrays([pa.array([other], pa.int64()), pa.array([piece], pa.int32()), pa.array([said], pa.binary())], ["block", "piece", "said"])

    seated = active.rows("active").withColumn("other", F.lit(FIRST - 2).cast("long"))
    return met(n, seated, halls.rows("tables"), pieces.rows("index")).mapInArrow(released(run), "block long, piece int, said binary")


def probabilities(held: list[bytes], s: int, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10 probability of each of a block's pairs, training tokens of its words), from what pieces
    said of s kept sweeps, in their order."""
    own, total, *spread = (np.concatenate(x) for x in zip(*(lm._unpacked(x, np.float32, np.int64, *[np.float32, np.int64] * s) for x in held)))
    word, context = pair // len(total), pair % len(total)
    back = sum((lm.STRENGTH[0] + lm.DISCOUNT[0] * t[context]) * p.astype(np.float64)[word] for p, t in zip(spread[::2], spread[1::2])) / s
    return np.log10((own + back) / (lm.STRENGTH[0] + total[context])), total


def modelled(tokenised: DataFrame, n: int, burn_in: int, sweeps: int) -> tuple[DataFrame, dict]:
    """What pieces say to blocks, and the sums of the model."""
    small_batches(tokenised.sparkSession)
    pieces, active, halls, (first, *states) = learn(tokenised, n, burn_in, sweeps)
    return answers(pieces, active, halls, states, n), first
