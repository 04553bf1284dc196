"""Language ID by a byte convolutional network in numpy.

Bytes become 128 classes (letters without case, one class each for space, digits and other ASCII,
the bytes of multi-byte characters apart). A text is cut into windows of WINDOW bytes; filters of
widths 2, 4 and 6 slide over a window, each filter's largest response is kept, and a softmax layer
weighs them. A text's probabilities are the mean over all its windows.

The first layer works on one-hot bytes, so a filter's response is a sum of table entries; for
prediction the tables of neighbouring bytes are added beforehand and looked up by byte pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import flat, released, slices, small_batches

WINDOW = 256
WIDTHS = (2, 4, 6)
FILTERS = 8
CLASSES = 128
#: Documents in the sample that the network learns from, over all languages.
SAMPLE = 60_000
#: Languages beyond which learning is refused rather than cut.
MOST_LANGUAGES = 5_000


def _classes() -> np.ndarray:
    """0 is padding, 1 white space, 2 digits, 3 other ASCII, 4-29 letters, 30-93 continuation
    bytes, then the lead bytes."""
    out = np.full(256, 3, np.uint8)
    out[[9, 10, 11, 12, 13, 32]] = 1
    out[48:58] = 2
    for k in range(26):
        out[65 + k] = out[97 + k] = 4 + k
    out[128:192] = 30 + np.arange(64)
    out[192:224] = 94 + np.arange(32) % 24
    out[224:240], out[240:256] = 118 + np.arange(16) % 8, 126
    return out


_CLASS = _classes()


def has_letter(text: str | None) -> bool:
    """Whether a character of category L occurs: neither digits nor number signs such as ½ or Ⅷ."""
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    filters: list[np.ndarray]  #: per width: width x CLASSES x FILTERS
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def pairs(self) -> list[list[np.ndarray]]:
        """Per width its tables by pair of classes."""
        return [[(f[k][:, None, :] + f[k + 1][None, :, :]).reshape(CLASSES * CLASSES, FILTERS).astype(np.float32) for k in range(0, len(f), 2)] for f in self.filters]

    def probabilities(self, x: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """Windows x languages, from windows x WINDOW of byte classes."""
        pair = x[:, :-1].astype(np.int32) * CLASSES + x[:, 1:]
        pooled = []
        for f in tables:
            span = WINDOW - 2 * len(f) + 1
            y = f[0][pair[:, :span]]
            for k in range(1, len(f)):
                y += f[k][pair[:, 2 * k : 2 * k + span]]
            pooled.append(y.max(axis=1))
        z = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0) @ self.weights + self.offset
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def windows(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all rows (padded with class 0), and each window's row; empty rows have none."""
    sizes = np.diff(bounds)
    count = -(-sizes // WINDOW)
    first = np.cumsum(count) - count
    x = np.zeros(int(count.sum()) * WINDOW, np.uint8)
    x[np.arange(len(data)) + np.repeat(first * WINDOW - bounds[:-1], sizes)] = _CLASS[data]
    return x.reshape(-1, WINDOW), np.repeat(np.arange(len(sizes)), count)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 6, batch: int = 64, seed: int = 5) -> Model:
    """Adam on softmax loss. Through max pooling only the winning positions learn."""
    rng = np.random.default_rng(seed)
    n, width = len(languages), FILTERS * len(WIDTHS)
    filters = [rng.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, :] = 0
    params = [*filters, np.zeros(width, np.float32), rng.normal(0, 0.3, (width, n)).astype(np.float32), np.zeros(n, np.float32)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            some = order[at : at + batch]
            xb, yb = x[some].astype(np.int64), y[some]
            pooled, where = [], []
            for f in params[: len(WIDTHS)]:
                span = WINDOW - len(f) + 1
                r = f[0][xb[:, :span]]
                for k in range(1, len(f)):
                    r = r + f[k][xb[:, k : k + span]]
                where.append(r.argmax(axis=1))
                pooled.append(r.max(axis=1))
            bias, weights, offset = params[len(WIDTHS) :]
            raw = np.concatenate(pooled, axis=1) + bias
            hidden = np.maximum(raw, 0)
            z = hidden @ weights + offset
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), yb] -= 1
            p /= len(some)
            dh = (p @ weights.T) * (raw > 0)
            grads = []
            rows = np.arange(len(some))[:, None]
            for k, f in enumerate(params[: len(WIDTHS)]):
                g, d = np.zeros_like(f), dh[:, k * FILTERS : (k + 1) * FILTERS]
                for t in range(len(f)):
                    np.add.at(g[t], (xb[rows, where[k] + t], np.arange(FILTERS)[None, :]), d)
                g[:, 0, :] = 0
                grads.append(g)
            grads += [dh.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
            step += 1
            for q, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                q -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return Model(languages, params[: len(WIDTHS)], *params[len(WIDTHS) :])


def training_windows(labelled: DataFrame, per_language: int, per_document: int, sample: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """A bounded sample: about per_language documents of each language, or as many fewer as keeps
    all of them at sample, by a hash of doc_id, so the same on every run; per_document evenly
    spaced windows of each. Rows that repeat a doc_id and language are one document, with the text
    that is first in order."""
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    each = max(1, min(per_language, sample // len(counts)))
    share = F.create_map(*(F.lit(x) for r in counts for x in (r.lang, int(min(1.0, each / r["count"]) * 1_000_003) + 1)))
    chosen = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share[F.col("lang")]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            b = b.filter(pa.array(list(map(has_letter, b.column("text").to_pylist())), pa.bool_()))
            x, row = windows(*flat(b.column("text")))
            n = np.bincount(row, minlength=b.num_rows)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            step = np.maximum(1, -(-n[row] // per_document))
            take = nth % step == 0
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row[take])), b.column("lang").take(pa.array(row[take])), pa.array([w.tobytes() for w in x[take]], pa.binary())], ["doc_id", "lang", "x"])

    rows = chosen.select("doc_id", "lang", "text").mapInArrow(released(cut), "doc_id long, lang string, x binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.lang, bytes(r.x)))
    names = sorted({r.lang for r in rows})
    number = {n: k for k, n in enumerate(names)}
    return np.frombuffer(b"".join(bytes(r.x) for r in rows), np.uint8).reshape(-1, WINDOW), np.array([number[r.lang] for r in rows], np.int64), names


def held_out() -> Column:
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))


def fit(docs: DataFrame, per_language: int = 1200, per_document: int = 4, sample: int = SAMPLE) -> Model:
    """Learns from text and non-null lang of documents that aren't held out and have a letter.
    per_language and sample bound the documents that are learned from; every language is learned.
    Without any such document the model has no language and predicts und."""
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    labelled = labelled.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    x, y, names = training_windows(labelled, per_language, per_document, sample)
    return train(x, y, names) if len(x) else Model([], [], np.zeros(0), np.zeros((0, 0)), np.zeros(0))


def _predicted(docs: DataFrame, model: Model) -> DataFrame:
    """Each row of docs as a struct _row, beside lang_pred and score."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").cast("string").alias("_text"))
    schema = rows.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).drop("_text").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.pairs()
        for b in slices(batches, "_text", 1 << 20):
            texts = b.column("_text")
            prob = np.zeros((b.num_rows, max(1, len(model.languages))))
            if model.languages:
                x, row = windows(*flat(texts))
                got = np.concatenate([model.probabilities(x[i : i + 512], tables) for i in range(0, len(x), 512)] or [np.zeros((0, prob.shape[1]))])
                for k in range(prob.shape[1]):
                    prob[:, k] = np.bincount(row, got[:, k], b.num_rows)
                prob /= np.maximum(1, np.bincount(row, minlength=b.num_rows))[:, None]
            best = prob.argmax(axis=1)
            known = [bool(model.languages) and has_letter(t) for t in texts.to_pylist()]
            pred = [model.languages[k] if ok else "und" for k, ok in zip(best, known)]
            score = np.where(known, np.clip(prob.max(axis=1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(pred, pa.string()), pa.array(score)], ["_row", "lang_pred", "score"])

    small_batches(docs.sparkSession)
    return rows.mapInArrow(released(run), schema)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score, in place of columns of these names. All windows of the whole
    text count. und, with score 0, where text is null or has no letter; ties go to the language
    first by name. Repeated rows each have their row."""
    own = [F.col("_row")[c].alias(c) for c in docs.columns if c not in ("lang_pred", "score")]
    return _predicted(docs, model).select(*own, "lang_pred", "score")


def in_language(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs, with all their columns, whose language is predicted with that score."""
    return _predicted(docs, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("_row.*")


def identify(docs: DataFrame, **sample: int) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return predict(narrow, fit(docs, **sample)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
