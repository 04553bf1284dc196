"""Vector code compression: each vector becomes sixteen one-byte codes, one for each part, after
codebooks of whole numbers.

Components are floor(256 * x). The nearest entry of a part is found in two steps. A float32 matrix
product gives |c|^2 - 2 x.c of all entries with an interval that holds the true value whatever the
order of summation: the product of d terms is off by at most gamma(d + 2) |x| |c|, where two more
roundings stand for the conversion of x and c. Entries whose interval overlaps the best one's are
compared again by exact squared distances in int64, ties to the lower index. Parts or entries too
large for int64 distances are compared as Python integers, and sums travel as limbs, so that no
magnitude of a float gives a wrong code.

Rows are never shuffled: a task sends one row for each entry and limb, and the driver gets the sums
of at most 16 x 64 entries. label_error adds one grouped sum over the labels.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .shared import released, stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Sums travel as limbs of so many bits: 2^31 tasks' limbs fit a long.
LIMB = 31
#: Components that a task holds at once.
BLOCK = 1 << 20
#: Up to so many distinct labels, their totals are broadcast; beyond, the join is salted.
BROADCAST_LABELS = 100_000
SALTS = 32
_U = 2.0**-24


def cuts(width: int) -> list[int]:
    """Bounds of the parts: equal ones where 16 divides the width, else as equal as can be."""
    return [p * width // PARTS for p in range(PARTS + 1)]


def whole(values: np.ndarray) -> np.ndarray:
    """floor(256 * x) exactly: int64, or Python integers where one of them needs it."""
    scaled = values.astype(np.float64)
    if len(scaled) and np.abs(scaled).max(initial=0) >= 2.0**44:  # 256 x stays a whole double below 2^52
        out = np.empty(scaled.shape, dtype=object)
        for at, x in np.ndenumerate(scaled):
            top, bottom = float(x).as_integer_ratio()
            out[at] = 256 * top // bottom
        return out
    return np.floor(scaled * 256).astype(np.int64)


def _small(values: np.ndarray) -> np.ndarray:
    """Which rows are small enough for squared distances below 2^61."""
    limit = math.isqrt((1 << 60) // max(1, values.shape[1])) // 2
    return np.array((abs(values) < limit).all(axis=1), dtype=bool)


def screened(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of |c|^2 - 2 x.c, rows by entries, from one float32 product."""
    d = x.shape[1] + 2
    gamma = d * _U / (1 - d * _U)
    product = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    squares = (c * c).sum(axis=1).astype(np.float64)
    norms = np.sqrt((x * x).sum(axis=1).astype(np.float64))[:, None] * np.sqrt(squares)[None, :]
    middle = squares[None, :] - 2 * product
    # the sums of squares, roots and differences in float64 are off by some 2^-52 of their terms
    off = 2 * gamma * norms * (1 + 2.0**-40) + (squares[None, :] + 2 * np.abs(product)) * 2.0**-48
    return middle - off, middle + off


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every row of x the nearest entry of c, ties to the lower index, and the exact squared
    distance. x and c are int64 and small, or Python integers."""
    n = len(x)
    if x.dtype == object or c.dtype == object:
        index, far = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=object)
        for i in range(n):
            found = [sum((int(a) - int(b)) ** 2 for a, b in zip(x[i], e, strict=True)) for e in c]
            far[i] = min(found)
            index[i] = found.index(far[i])
        return index, far
    lower, upper = screened(x, c)
    row, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])
    exact = ((x[row] - c[entry]) ** 2).sum(axis=1)
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    best = np.minimum.reduceat(exact, starts) if n else exact
    first = np.flatnonzero(exact == best[row])  # entries of a row stand in order: its first is the lowest
    _, at = np.unique(row[first], return_index=True)
    return entry[first[at]], best


def assign(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, list]:
    """Codes (rows by parts, uint8) and summed exact distances of whole vectors."""
    bounds = cuts(x.shape[1])
    codes, errors = np.zeros((len(x), PARTS), dtype=np.uint8), [0] * len(x)
    for p in range(PARTS):
        part, book = x[:, bounds[p] : bounds[p + 1]], books[p]
        easy = _small(part) if _small(book).all() else np.zeros(len(part), dtype=bool)
        for rows, exact in ((np.flatnonzero(easy), True), (np.flatnonzero(~easy), False)):
            if len(rows):
                kind = np.int64 if exact else object
                index, far = nearest(part[rows].astype(kind), book.astype(kind))
                codes[rows, p] = index
                for i, e in zip(rows.tolist(), far.tolist(), strict=True):
                    errors[i] += e
    return codes, errors


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of the batch, whole numbers) of vectors of one width, in bounded blocks. Rows whose
    vector is null, or has a null or non-finite component, aren't among them."""
    column = batch.column("vector")
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    for width in np.unique(sizes[sizes >= 0]).tolist():
        rows = np.flatnonzero(sizes == width)
        step = max(1, BLOCK // max(1, width))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            values = column.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(some), width)
            yield some, whole(values)


def _limbs(total: int) -> list[int]:
    """total as limbs of LIMB bits, lowest first; the last carries the sign."""
    out = []
    while not -(1 << LIMB) <= total < 1 << LIMB:
        out.append(total & ((1 << LIMB) - 1))
        total >>= LIMB
    return [*out, total]


def _sums(kept: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The codebooks after one round over all rows."""
    bounds = cuts(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((PARTS, ENTRIES), dtype=np.int64)
        totals = [np.zeros((ENTRIES, bounds[p + 1] - bounds[p]), dtype=object) for p in range(PARTS)]
        for batch in batches:
            for _, x in _vectors(batch):
                if x.shape[1] != width:
                    continue
                codes, _ = assign(x, books)
                for p in range(PARTS):
                    count[p] += np.bincount(codes[:, p], minlength=ENTRIES)
                    part = x[:, bounds[p] : bounds[p + 1]]
                    added = np.zeros(totals[p].shape, dtype=x.dtype)  # a block's sums stay below 2^20 * 2^52
                    if x.dtype != object and len(x) and abs(part).max(initial=0) >= 1 << 42:
                        added = added.astype(object)
                    np.add.at(added, codes[:, p], part)
                    totals[p] += added.astype(object)
        rows = []
        for p, e in zip(*np.nonzero(count), strict=True):
            split = [_limbs(int(v)) for v in totals[p][e]]
            for k in range(max(map(len, split), default=1)):
                rows.append((int(p), int(e), k, int(count[p, e]) if k == 0 else 0, [s[k] if k < len(s) else 0 for s in split]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SUMS.types, strict=True)], schema=SUMS)

    SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("limb", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
    widest = max(bounds[p + 1] - bounds[p] for p in range(PARTS))
    partial = kept.select("vector").mapInArrow(released(run), "part int, entry int, limb int, n long, sums array<long>")
    added = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(widest)]
    new = [b.copy() for b in books]
    found: dict[tuple[int, int], list] = {}
    for r in partial.groupBy("part", "entry", "limb").agg(F.sum("n"), *added).collect():
        size = bounds[r[0] + 1] - bounds[r[0]]
        n, sums = found.setdefault((r[0], r[1]), [0, [0] * size])
        found[r[0], r[1]] = [n + r[3], [s + (v << (LIMB * r[2])) for s, v in zip(sums, r[4 : 4 + size], strict=True)]]
    for (p, e), (n, sums) in found.items():
        means = [s // n for s in sums]
        if any(abs(m) >= 1 << 62 for m in means):
            new[p] = new[p].astype(object)
        new[p][e] = means
    return new


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for e in b for v in e).encode()).hexdigest()


def fitted(kept: DataFrame, rounds: int = ROUNDS) -> tuple[list[np.ndarray], int]:
    """The codebooks of kept(vec_id, vector) and the width that they hold for: that of the smallest
    vec_id. The 64 smallest distinct vec_ids are the first entries; where an id has several rows, the
    smallest vector counts."""
    ids = [r[0] for r in kept.filter("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(ENTRIES).collect()]
    first = kept.filter(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy("vec_id").collect() if ids else []
    width = len(first[0].vector) if first else 0
    start = [whole(np.array(r.vector, dtype=np.float64)[None, :])[0] for r in first if len(r.vector) == width]
    kind = object if any(v.dtype == object for v in start) else np.int64
    seeds = np.array(start, dtype=kind).reshape(len(start), width)
    bounds = cuts(width)
    books = [seeds[:, bounds[p] : bounds[p + 1]].copy() for p in range(PARTS)]
    for _ in range(rounds if first else 0):
        books = _sums(kept, books, width)
    return books, width


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """One row per vector: vec_id, label, code (two hex digits a part), error, label_error (error
    summed over equal labels, nulls together) and codebooks_sha256.

    Rows whose vector is null or holds a null, NaN or infinite component go; all others stay, equal
    rows as often as they come. Vectors of another width than that of the smallest vec_id keep their
    row with null code and error, and count nowhere. Rows without vec_id are coded and count in the
    means, but are no first entries. error and label_error are null where the number passes a long.
    With no vector of a vec_id there are no codebooks, and codes are null. A very long vector is held
    alone, in blocks of BLOCK components. Other columns are not read, whatever their names.
    """
    source = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | v.isin(float("inf"), float("-inf")))
    kept = source.filter(F.col("vector").isNotNull() & ~bad)
    books, width = fitted(kept, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.full(batch.num_rows, None, dtype=object), np.full(batch.num_rows, None, dtype=object)
            for rows, x in _vectors(batch):
                if x.shape[1] == width and len(books[0]):
                    codes, far = assign(x, books)
                    code[rows] = [c.tobytes().hex() for c in codes]
                    error[rows] = [e if e < 1 << 63 else None for e in far]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    kinds = dict(source.dtypes)
    coded = stored(kept.mapInArrow(released(run), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    lost = F.count_if(F.col("code").isNotNull() & F.col("error").isNull())
    sums = stored(coded.groupBy(F.col("label").alias("of")).agg(F.when(lost == 0, total).try_cast("long").alias("label_error")), "labels")
    if sums.count() <= BROADCAST_LABELS:
        joined = coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of")), "left")
    else:
        spread = sums.withColumn("s2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = coded.withColumn("s1", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
        joined = salted.join(spread, F.col("label").eqNullSafe(F.col("of")) & (F.col("s1") == F.col("s2")), "left")
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
