"""LM scoring by a hierarchical Pitman-Yor model of words.

A word's context is the word before it. Every one of the CONTEXTS most frequent words has a context
restaurant of its own, the start of a text has one, and all rarer words share one; `lmwords` has the
form in which every word has its own, and none is shared. Their common
parent is a restaurant over all words, whose base is even over the known words and one place for
unknown ones; the mass of that place is spread over spellings, so that the model is normalised.

Customers are seated by Gibbs sampling: a customer of a dish leaves and comes back, by the ratios
of generalised Stirling numbers that its dish's customers and tables give; dishes of more than
EXACT customers in one restaurant are seated anew, one by one and then in steps, which is an
approximation. Restaurants' totals are those of the sweep before. Seatings are kept between sweeps,
the first of which count for nothing; predictive probabilities are averaged over the others.

Texts are tokenised once into stored blocks of local word numbers. A block's pairs of word and
context are cut by ranges of word hashes into pieces, packed, and shuffled as one row a piece. A
piece has all of the model's entries for its words, so that it is sampled in place: what meets on
the driver is one number for each restaurant. Answers go back to the blocks piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .shared import discard, flat, released, slices, stored
from .words import words

#: Words with a restaurant of their own: a parameter of the model, like an order of n-grams.
CONTEXTS = 510
START, OTHER = 0, 1  #: restaurants of text starts and of all other words
DISCOUNT = (0.75, 0.6)  #: of contexts and of their parent
STRENGTH = (8.0, 50.0)
BURN_IN, SWEEPS = 2, 3
#: Customers of a dish up to which single customers are reseated, and how often in a sweep.
EXACT, MOVES = 64, 8
#: Bytes of text in a block.
BLOCK_BYTES = 12 << 20
#: The end token's hash; no word hashes to it but by chance.
END = np.uint64(0x0123456789ABCDEF)


def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, bytes, n + 1 bounds) of every row's words, each row closed by END."""
    n = len(bounds) - 1
    w = words(data, bounds)
    out = w.first + np.arange(n + 1)
    place = np.arange(len(w.row)) + w.row
    h, size = np.full(len(w.row) + n, END), np.ones(len(w.row) + n, np.int64)
    h[place], size[place] = w.hash, w.end - w.start
    return h, size, out


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; bytes of one weight lie together, as most high ones are 0."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays]
    head = np.array([len(arrays), *map(len, planes)], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(planes))


def _unpacked(raw: bytes, *kinds) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    ends = np.cumsum(np.frombuffer(data, np.int64, n, 8)) + 8 * (n + 1)
    out = []
    for a, b, k in zip([8 * (n + 1), *ends[:-1].tolist()], ends.tolist(), kinds):
        planes = np.frombuffer(data, np.uint8, b - a, a).reshape(np.dtype(k).itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(k))
    return out


BLOCK = "block long, n_tokens long, vocabulary binary, texts binary, doc_ids binary"


def held_out(fold: int = 1, folds: int = 5):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def blocks(docs: DataFrame) -> DataFrame:
    """Tokenised texts, about BLOCK_BYTES of text a row. vocabulary packs the hashes of the block's
    words, the most frequent first, their training counts and bytes; texts packs bounds, folds and
    tokens as places in the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number_of = TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        size = 0

        def done() -> pa.RecordBatch:
            nonlocal number_of
            number_of += 1
            if number_of & 0xFFFFFF == 0:
                raise OverflowError("a partition has more blocks than numbers; read it in more partitions")
            ids, has, out, h, length, count = (np.concatenate(x) for x in zip(*held))
            known, first, number = np.unique(h, return_index=True, return_inverse=True)
            learn = np.bincount(number, ~np.repeat(out, count), len(known)).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(count)])
            by = np.argsort(-np.bincount(number, minlength=len(known)), kind="stable")
            rank = np.empty(len(by), np.uint32)
            rank[by] = np.arange(len(by))
            return pa.RecordBatch.from_arrays(
                [pa.array([number_of]), pa.array([len(h)]), *(pa.array([x], pa.binary()) for x in (_packed(known[by], learn[by], length[first][by]), _packed(at, out, rank[number]), _packed(ids, has)))],
                [x.split()[0] for x in BLOCK.split(", ")],
            )

        for b in slices(batches):
            h, length, at = tokens(*flat(b.column("text")))
            ids = b.column("doc_id")
            held.append((ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(ids.is_valid()).astype(bool), np.asarray(b.column("out")).astype(bool), h, length, np.diff(at)))
            size += int(length.sum())
            if size >= BLOCK_BYTES:
                yield done()
                held, size = [], 0
        if held:
            yield done()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("out")).mapInArrow(released(run), BLOCK)


def opened(vocabulary: bytes, texts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: hashes of its words in their order, bytes of each, bounds, folds, and tokens as
    numbers of words in that order."""
    h, _, length = _unpacked(vocabulary, np.uint64, np.int64, np.int64)
    at, out, rank = _unpacked(texts, np.int64, bool, np.uint32)
    order = np.argsort(h)
    number = np.empty(len(h), np.int64)
    number[order] = np.arange(len(h))
    return h[order], length[order], at, out, number[rank]


def frequent(tokenised: DataFrame, most: int = CONTEXTS) -> np.ndarray:
    """Hashes of the words with a restaurant of their own, by their training counts in all blocks; of
    equal counts the lesser hash. At most `most` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column("vocabulary"):
                h, count, _ = _unpacked(raw.as_py(), np.uint64, np.int64, np.int64)
                keep = (count > 0) & (h != END)
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(count[keep])], ["word", "n"])

    rows = tokenised.select("vocabulary").mapInArrow(released(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return np.sort(np.array([r.word for r in rows.orderBy(F.desc("n"), "word").limit(most).collect()], np.int64).view(np.uint64))


def pairs(known: np.ndarray, at: np.ndarray, number: np.ndarray, own: np.ndarray) -> np.ndarray:
    """word number * restaurants + restaurant, of every token of a block."""
    place = np.minimum(np.searchsorted(own, known), max(0, len(own) - 1))
    restaurant = np.where(own[place] == known, place + 2, OTHER) if len(own) else np.full(len(known), OTHER)
    context = np.concatenate([[START], restaurant[number[:-1]]]) if len(number) else np.zeros(0, np.int64)
    context[at[:-1]] = START
    return number.astype(np.int64) * (len(own) + 2) + context


def pieces(tokenised: DataFrame, own: np.ndarray, n: int, counted: bool) -> DataFrame:
    """Rows piece, block, packed: the block's pairs of the piece's words, as steps from word to word,
    pairs of each, restaurants and, if counted, training tokens; pairs and words without any are then left out."""
    k = len(own) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, vocabulary, texts in zip(b.column("block").to_pylist(), b.column("vocabulary"), b.column("texts")):
                known, _, at, out, number = opened(vocabulary.as_py(), texts.as_py())
                every = pairs(known, at, number, own)
                if counted:
                    every = every[~np.repeat(out, np.diff(at))]
                pair, count = np.unique(every, return_counts=True)
                word, context = pair // k, (pair % k).astype(np.uint16)
                piece = ((known >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)[word]
                cut = np.append(np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]]), len(piece)) if len(piece) else []
                rows: list[list] = [[], [], []]
                for x, y in zip(cut[:-1], cut[1:]):
                    w, each = np.unique(word[x:y], return_counts=True)
                    parts = [np.diff(known[w], prepend=np.uint64(0)), each.astype(np.uint16), context[x:y], *([count[x:y].astype(np.uint32)] if counted else [])]
                    for c, v in zip(rows, (int(piece[x]), block, _packed(*parts))):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary())], ["piece", "block", "packed"])

    return tokenised.select("block", "vocabulary", "texts").mapInArrow(released(run), "piece int, block long, packed binary")


def log_stirling(discount: float, most: int = EXACT + 1) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers of n customers at t tables."""
    out = np.full((most + 1, most + 2), -np.inf)
    out[1, 1] = 0
    for n in range(1, most):
        t = np.arange(1, most + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where(t <= n, np.log(np.maximum(n - discount * t, 1e-300)) + out[n, 1:-1], -np.inf)
        out[n + 1, 1:-1] = np.logaddexp(out[n, :-2], stay)
    return out


_STIRLING = [log_stirling(d) for d in DISCOUNT]


def seat(n: np.ndarray, mass: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after n customers of one dish each sit down: customer i + 1 of t tables' guests opens
    one with probability mass / (mass + i - discount * t). One by one to EXACT customers, then in
    steps of a sixteenth with a binomial draw each, as the probability hardly moves in a step."""
    t = (n > 0).astype(np.int64)
    live = np.flatnonzero(n > 1)
    i = 1
    while len(live):
        step = np.minimum(1 if i < EXACT else i // 16, n[live] - i)
        p = mass[live] / (mass[live] + np.maximum(i - discount * t[live], 1e-9))
        t[live] += rng.binomial(step, np.clip(p, 0, 1))
        i += 1 if i < EXACT else i // 16
        live = live[n[live] > i]
    return t


def reseat(n: np.ndarray, t: np.ndarray, mass: np.ndarray, level: int, rng: np.random.Generator, moves: int = MOVES) -> np.ndarray:
    """Tables after single customers have left and come back; mass is (strength + discount * tables)
    * parent's probability of the dish."""
    s, discount = _STIRLING[level], DISCOUNT[level]
    t = np.clip(t, np.minimum(n, 1), n)
    large = n > EXACT
    if large.any():
        t[large] = seat(n[large], mass[large], discount, rng)
    for k in range(moves):
        live = np.flatnonzero((n > max(1, k)) & ~large)
        if not len(live):
            break
        m, u = n[live], t[live]
        head = rng.random(len(live)) * m < u
        move = ~(head & (u == 1))  # the first table's head stays while others sit there
        live, m, u = live[move], m[move], u[move] - head[move]
        join = (m - u) / m * np.exp(s[m, u] - s[m - 1, u])
        fresh = mass[live] * (u + 1) / m * np.exp(s[m, u + 1] - s[m - 1, u])
        t[live] = u + (rng.random(len(live)) * (join + fresh) < fresh)
    return t


MODEL = "piece int, words binary, seats binary, totals binary, n_words long, top long"


def merged(counts: DataFrame, n: int) -> DataFrame:
    """All entries of each piece: words packs hashes, entries of each and totals; seats packs
    restaurants, customers and, for each kept sweep, tables and the parent's probabilities; totals
    packs restaurants and their customers, here at one table a dish."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def done() -> pa.RecordBatch:
            h, c, m = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((c, h))
            h, c, m = h[order], c[order], m[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]
            m = np.add.reduceat(m, np.flatnonzero(new))
            h, c = h[new], c[new]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            r = np.unique(c)
            guests = np.bincount(c, m)[r].astype(np.int64)
            values = [_packed(h[first], np.diff(np.append(first, len(h))), np.add.reduceat(m, first)), _packed(c, m, np.ones(len(m), np.uint32), np.ones(len(first), np.uint32)), _packed(r.astype(np.int64), guests, np.bincount(c)[r].astype(np.int64))]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), *(pa.array([v], pa.binary()) for v in values), pa.array([len(first)]), pa.array([len(first)])], [x.split()[0] for x in MODEL.split(", ")])

        for b in batches:
            for piece, raw in zip(b.column("piece").to_pylist(), b.column("packed")):
                if held and piece != last:
                    yield done()
                last = piece
                w, each, c, m = _unpacked(raw.as_py(), np.uint64, np.uint16, np.uint16, np.uint32)
                held.append((np.repeat(np.cumsum(w), each), c.astype(np.int64), m.astype(np.int64)))
        if held:
            yield done()

    return counts.select("piece", "packed").repartition(n, "piece").sortWithinPartitions("piece").mapInArrow(released(run), MODEL)


def totals(model: DataFrame, k: int) -> dict:
    """Customers and tables of every restaurant, words, and tables of the parent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, k), np.int64)  # of all pieces of the task
        for b in batches:
            for raw in b.column("totals"):
                r, guests, tables = _unpacked(raw.as_py(), np.int64, np.int64, np.int64)
                sums[:, r] += guests, tables
        r = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(sums[0, r]), pa.array(sums[1, r])], ["r", "guests", "tables"])

    guests, tables = np.zeros(k), np.zeros(k)
    for row in model.select("totals").mapInArrow(released(run), "r long, guests long, tables long").groupBy("r").agg(F.sum("guests").alias("guests"), F.sum("tables").alias("tables")).collect():
        guests[row.r], tables[row.r] = row.guests, row.tables
    sums = model.agg(F.sum("n_words").alias("v"), F.sum("top").alias("top")).first()
    return {"guests": guests, "tables": tables, "words": int(sums.v or 0), "top": float(sums.top or 0)}


def parent_probability(c: np.ndarray, top: np.ndarray, state: dict) -> np.ndarray:
    all_tables = state["tables"].sum()
    back = (STRENGTH[1] + DISCOUNT[1] * state["top"]) / (STRENGTH[1] + all_tables)
    return np.maximum(c - DISCOUNT[1] * top, 0) / (STRENGTH[1] + all_tables) + back / (state["words"] + 1)


def swept(model: DataFrame, state: dict, number: int, keep: bool) -> DataFrame:
    """The model after one more sweep under the totals of the last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                rng = np.random.default_rng([row["piece"], number])
                _, each, _ = _unpacked(row["words"], np.uint64, np.int64, np.int64)
                c, m, t, top, *kept = _unpacked(row["seats"], np.int64, np.int64, np.uint32, np.uint32, *[np.float32] * (2 * SWEEPS))
                word, first = np.repeat(np.arange(len(each)), each), np.cumsum(each) - each
                p = parent_probability(np.add.reduceat(t.astype(np.int64), first), top, state)
                t = reseat(m, t.astype(np.int64), (STRENGTH[0] + DISCOUNT[0] * state["tables"][c]) * p[word], 0, rng)
                up = np.add.reduceat(t, first)
                top = reseat(up, top.astype(np.int64), np.full(len(up), (STRENGTH[1] + DISCOUNT[1] * state["top"]) / (state["words"] + 1)), 1, rng)
                r, guests, _ = _unpacked(row["totals"], np.int64, np.int64, np.int64)
                kept = [*kept, t.astype(np.float32), top.astype(np.float32)] if keep else kept
                values = [row["words"], _packed(c, m, t.astype(np.uint32), top.astype(np.uint32), *kept), _packed(r, guests, np.bincount(c, t)[r].astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array([row["piece"]], pa.int32()), *(pa.array([v], pa.binary()) for v in values), pa.array([row["n_words"]]), pa.array([int(top.sum())])], [x.split()[0] for x in MODEL.split(", ")])

    return model.mapInArrow(released(run), MODEL)


def learn(tokenised: DataFrame, own: np.ndarray, n: int, burn_in: int = BURN_IN, sweeps: int = SWEEPS) -> tuple[DataFrame, list[dict]]:
    """The model with its kept seatings, and the totals of each kept sweep."""
    model = stored(merged(pieces(tokenised, own, n, True), n), "model")
    state, states = totals(model, len(own) + 2), []
    for k in range(burn_in + sweeps):
        following = stored(swept(model, state, k, k >= burn_in), "model")
        discard(model)
        model, state = following, totals(following, len(own) + 2)
        if k >= burn_in:
            states.append(state)
    return model, states


class Piece:
    """What one piece of the model says of pairs."""

    def __init__(self, words_: bytes, seats: bytes, states: list[dict], k: int):
        self.words, each, self.total = _unpacked(words_, np.uint64, np.int64, np.int64)
        c, self.n, _, _, *kept = _unpacked(seats, np.int64, np.int64, np.uint32, np.uint32, *[np.float32] * (2 * len(states)))
        word, first = np.repeat(np.arange(len(each)), each), np.cumsum(each) - each
        self.keys, self.k, self.states = word * k + c, k, states
        self.tables = kept[::2]
        self.parents = [parent_probability(np.add.reduceat(t.astype(np.float64), first), top, s) for t, top, s in zip(kept[::2], kept[1::2], states)]

    def answer(self, h: np.ndarray, each: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability of each pair, training tokens of each word); of an unknown word the
        probability is that of all unknown words together."""
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        known = self.words[at] == h
        word, seen = np.repeat(at, each), np.repeat(known, each)
        key = word * self.k + c
        e = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[e] == key) & seen
        p = np.zeros(len(c))
        for t, parent, s in zip(self.tables, self.parents, self.states):
            guests = STRENGTH[0] + s["guests"][c]
            none = parent_probability(np.zeros(1), np.zeros(1), s)[0]
            p += (STRENGTH[0] + DISCOUNT[0] * s["tables"][c]) / guests * np.where(seen, parent[word], none)
            p += np.where(hit, np.maximum(self.n[e] - DISCOUNT[0] * t[e], 0) / guests, 0)
        return np.log10(p / len(self.states)), np.where(known, self.total[at], 0)


def answers(tokenised: DataFrame, model: DataFrame, states: list[dict], own: np.ndarray, n: int) -> DataFrame:
    """Rows block, piece, said: log10 probabilities of the block's pairs in the piece, and training
    tokens of its words."""
    k = len(own) + 2
    asked = pieces(tokenised, own, n, False).select("piece", "block", "packed", F.lit(None).cast("binary").alias("seats"))
    have = model.select("piece", F.lit(-1).cast("long").alias("block"), F.col("words").alias("packed"), "seats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, piece = None, None
        none = _packed(np.zeros(1, np.uint64), np.ones(1, np.int64), np.zeros(1, np.int64)), _packed(np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.uint32), np.zeros(1, np.uint32), *[np.zeros(1, np.float32)] * (2 * len(states)))
        for b in batches:
            out: list[list] = [[], [], []]
            for number, block, packed, seats in zip(b.column("piece").to_pylist(), b.column("block").to_pylist(), b.column("packed"), b.column("seats")):
                if number != last:
                    last, piece = number, Piece(*((packed.as_py(), seats.as_py()) if block < 0 else none), states, k)
                if block >= 0:
                    h, each, c = _unpacked(packed.as_py(), np.uint64, np.uint16, np.uint16)
                    logp, total = piece.answer(np.cumsum(h), each, c)
                    for x, v in zip(out, (block, number, _packed(logp.astype(np.float32), total))):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], ["block", "piece", "said"])

    both = have.union(asked.select("piece", "block", "packed", "seats"))
    return both.repartition(n, "piece").sortWithinPartitions("piece", "block").mapInArrow(released(run), "block long, piece int, said binary")


def spelling(size: np.ndarray) -> np.ndarray:
    """log10 probability of an unknown word among all: its length, geometric with a mean of eight
    bytes, and each of its bytes, even over the 250 that are not white space."""
    return np.log10(1 / 8) + (size - 1) * np.log10(7 / 8) - size * np.log10(250)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, score_per_token double, gain_per_token double"


def score_texts(docs: DataFrame, burn_in: int = BURN_IN, sweeps: int = SWEEPS, every: bool = False) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens (end included), n_known, train_tokens, base_score and
    score (log10 probabilities), score_per_token, and gain_per_token: what a token's score is above
    its base. Null and empty texts are one end token. Repeated rows each count and each have their
    row; a row without doc_id trains. Without training texts every token is unknown. every: all words
    have a restaurant of their own, as `lmwords` has it, not the most frequent alone."""
    from . import lmwords

    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tokenised = stored(blocks(docs), "blocks")
    if every:
        said, sums = lmwords.modelled(tokenised, n, burn_in, sweeps)
        total, vocabulary = sums["guests"], sums["words"]
    else:
        own = frequent(tokenised)
        model, states = learn(tokenised, own, n, burn_in, sweeps)
        total, vocabulary = int(states[-1]["guests"].sum()), states[-1]["words"]
        said = answers(tokenised, model, states, own, n)
    unit = np.log10(total + 0.5 * (vocabulary + 1))
    texts = F.struct("vocabulary", "texts", "doc_ids").alias("texts")
    mine = tokenised.select("block", F.lit(n).alias("piece"), F.lit(None).cast("binary").alias("said"), texts)
    rows = said.withColumn("texts", F.lit(None).cast(mine.schema["texts"].dataType)).union(mine).repartition(n, "block").sortWithinPartitions("block", "piece")

    def scores(row: dict, held: list[bytes]) -> pa.RecordBatch:
        known, length, at, out, number = opened(row["vocabulary"], row["texts"])
        ids, has = _unpacked(row["doc_ids"], np.int64, bool)
        if every:
            all_pairs, pair = np.unique(lmwords.pairs(known, at, number), return_inverse=True)
            logp, seen = lmwords.probabilities(held, sweeps, all_pairs)
        else:
            logp, seen = (np.concatenate(x) for x in zip(*(_unpacked(x, np.float32, np.int64) for x in held)))
            _, pair = np.unique(pairs(known, at, number, own), return_inverse=True)
        spelt = np.where(seen > 0, 0.0, spelling(length))
        base = np.log10(seen + 0.5) - unit
        sums = [np.add.reduceat(v, at[:-1]) for v in ((seen > 0).astype(np.int64)[number], base[number], logp.astype(np.float64)[pair] + spelt[number])]
        m, size = len(has), np.diff(at)
        columns = [pa.array(ids, mask=~has), pa.array(out), pa.array(size), pa.array(sums[0]), pa.array(np.full(m, total)), pa.array(sums[1]), pa.array(sums[2]), pa.array(sums[2] / size), pa.array((sums[2] - sums[1]) / size)]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCORED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for b in batches:
            for x, row in zip(b.column("said"), b.column("texts")):
                if row.is_valid:
                    yield scores(row.as_py(), held)
                    held = []
                else:
                    held.append(x.as_py())

    return rows.mapInArrow(released(run), SCORED)


def perplexity(scored: DataFrame) -> DataFrame:
    """Per held_out: documents, tokens, and perplexity of the base and of the model."""
    power = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), power("base_score").alias("base_perplexity"), power("score").alias("perplexity"))
