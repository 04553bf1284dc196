"""CSV files with quoted line ends, read in ranges by many tasks.

A range begins after a line end, which may lie within quotes. So each range is read for both ways in
which it can begin, outside and inside a quoted field, and says how it ends for either; how each one
does begin follows from those before it, by running counts over the ranges of a file. A record belongs
to the range that it begins in.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.storage import stored

#: Bytes of a range.
RANGE_BYTES = 16 << 20
_PIECE = 1 << 16
_DELIMITER = re.compile(rb"[,\n]")


def _steps(data: bytes, inside: bool) -> Iterator[tuple[int, bool]]:
    """Walks over fields: (place, True) where a field begins, (place, False) where the data ends
    inside quotes. Quotes count only at the beginning of a field; text after a closing quote is
    taken as it is."""
    at, n = 0, len(data)
    while at < n:
        if not inside and data[at] == 34:
            inside, at = True, at + 1
            continue
        if inside:
            at = data.find(b'"', at)
            if at < 0:
                yield n, False
                return
            if data[at + 1 : at + 2] == b'"':
                at += 2
                continue
            inside, at = False, at + 1
        found = _DELIMITER.search(data, at)
        if not found:
            return
        at = found.end()
        yield at, True
    if inside:
        yield n, False


def _regular(a: np.ndarray, quotes: np.ndarray, inside: bool) -> bool:
    """Whether quotes open only where fields begin and close only where they end, so that their
    number alone tells how the data ends."""
    opening = (np.arange(len(quotes)) + inside) % 2 == 0
    o, c = quotes[opening], quotes[~opening]
    before = a[np.maximum(o - 1, 0)]
    after = a[np.minimum(c + 1, len(a) - 1)]
    return bool(((o == 0) | np.isin(before, (44, 10)) | (before == 34)).all() and ((c == len(a) - 1) | np.isin(after, (44, 10, 13, 34))).all())


def how_it_ends(data: bytes) -> tuple[bool, bool]:
    """Whether data ends inside quotes, if it begins outside and if it begins inside."""
    a = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(a == 34)
    if not len(quotes):
        return False, True
    plain = _regular(a, quotes, False)
    outside = len(quotes) % 2 == 1 if plain else any(not f for _, f in _steps(data, False))
    if _regular(a, quotes, True):
        return outside, (len(quotes) + 1) % 2 == 1
    for at, field in _steps(data, True):
        if not field:
            return outside, True
        if plain and np.searchsorted(quotes, at) % 2 == 0:  # both ways are at the same place of a field from here on
            return outside, outside
    return outside, False


def first_record(data: bytes) -> int | None:
    """Where the first record begins in data that begins inside quotes."""
    return next((at for at, field in _steps(data, True) if field and data[at - 1] == 10), None)


def _open(path: str) -> BinaryIO:
    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


def _line_end(f: BinaryIO, at: int, size: int) -> int:
    """The place after the first line end from at on."""
    while at < size:
        f.seek(at)
        piece = f.read(min(_PIECE, size - at))
        found = piece.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(piece)
    return size


def _bounds(f: BinaryIO, number: int, size: int, step: int) -> tuple[int, int]:
    start = 0 if number == 0 else _line_end(f, number * step - 1, size)
    return start, max(start, _line_end(f, min(size, (number + 1) * step) - 1, size))


def _rows(data: bytes) -> Iterator[list]:
    csv.field_size_limit(1 << 30)
    return (r for r in csv.reader(io.StringIO(data.decode("utf-8", "replace"), newline=""), quoting=csv.QUOTE_NOTNULL) if r)


def _to_record_end(f: BinaryIO, data: bytes, at: int, size: int) -> bytes:
    """data, which ends inside quotes at a place of the file, with the rest of its last record."""
    more = b""
    while at < size:
        f.seek(at)
        piece = f.read(min(_PIECE, size - at))
        at, more = at + len(piece), more + piece
        if (end := first_record(more)) is not None:
            return data + more[:end]
    return data + more


def _header(f: BinaryIO, size: int) -> list[str]:
    """Names of a file's columns, from its first record."""
    data, at = b"", 0
    while at < size and not any(field and data[k - 1] == 10 for k, field in _steps(data, False)):
        f.seek(at)
        data += f.read(_PIECE)
        at = len(data)
    first = next(_rows(data.removeprefix(b"\xef\xbb\xbf")), [])
    return [c or "" for c in first]


def read_ranges(spark: SparkSession, path: str, columns: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The named columns as text of all CSV files at the path (a file, folder or pattern), each of
    which has a header of its own; a column that a file lacks is null. An empty field is null, two
    quotes are an empty text; short records end in nulls, and what is beyond the header is left out.
    A field can be as long as memory allows; a file is read twice, by ranges."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    parts = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / range_bytes))).alias("number"))
    parts = stored(parts, "ranges")
    found = parts.agg(F.count("*").alias("ranges"), F.coalesce(F.sum(F.when(F.col("number") == 0, F.col("length"))), F.lit(0)).alias("bytes")).first()
    # where ranges are small, tasks take many of them: a few tasks for each core, or one for RANGE_BYTES
    tasks = max(1, min(found.ranges, max(4 * spark.sparkContext.defaultParallelism, -(-found.bytes // RANGE_BYTES))))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, ranges in b.groupby("path", sort=False):
                with _open(path) as f:
                    for r in ranges.itertuples(index=False):
                        start, stop = _bounds(f, r.number, r.length, range_bytes)
                        f.seek(start)
                        out.append((path, r.length, r.number, start, stop, *how_it_ends(f.read(stop - start))))
            yield pd.DataFrame(out, columns=["path", "length", "number", "start", "stop", "outside", "inside"])

    spread = parts.repartition(tasks, "path", "number") if tasks > 1 else parts
    ends = stored(spread.mapInPandas(judge, "path string, length long, number long, start long, stop long, outside boolean, inside boolean").filter("stop > start"), "ends")
    # a range fixes how it ends, keeps or turns how it began; turns are counted since the last that fixes
    order = Window.partitionBy("path").orderBy("number")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("turns", F.sum(F.when(F.col("outside") & ~F.col("inside"), 1).otherwise(0)).over(order))
    fixed = F.when(F.col("outside") == F.col("inside"), F.struct(F.col("outside").cast("int").alias("how"), "turns"))
    last = F.last(fixed, ignorenulls=True).over(earlier)
    begins = F.coalesce(last["how"], F.lit(0)) + F.coalesce(F.lag("turns").over(order), F.lit(0)) - F.coalesce(last["turns"], F.lit(0))
    known = stored(ends.withColumn("began", begins % 2 == 1), "began")

    def records(f: BinaryIO, r) -> Iterator[list]:
        """The records that begin in a range, with the header in that of number 0."""
        f.seek(r.start)
        data = f.read(r.stop - r.start)
        if r.began:
            first = first_record(data)
            if first is None or first == len(data):
                return  # nothing begins here
            data = data[first:]
        if how_it_ends(data)[0]:
            data = _to_record_end(f, data, r.stop, r.length)
        yield from _rows(data.removeprefix(b"\xef\xbb\xbf") if r.number == 0 else data)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[list] = []
        size = 0
        for b in batches:
            for path, ranges in b.groupby("path", sort=False):
                with _open(path) as f:
                    names = _header(f, ranges.length.iloc[0])
                    at = [names.index(c) if c in names else None for c in columns]
                    for r in ranges.itertuples(index=False):
                        rows = records(f, r)
                        if r.number == 0:
                            next(rows, None)
                        for row in rows:
                            held.append([row[k] if k is not None and k < len(row) else None for k in at])
                            size += sum(len(c) for c in held[-1] if c)
                            if len(held) == 8192 or size >= RANGE_BYTES:
                                yield pd.DataFrame(held, columns=range(len(columns)), dtype=object)
                                held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=range(len(columns)), dtype=object)

    schema = ", ".join(f"c{i} string" for i in range(len(columns)))
    dealt = known.select("path", "length", "number", "start", "stop", "began")
    found = (dealt.repartition(tasks, "path", "number") if tasks > 1 else dealt).mapInPandas(lambda it: (b.set_axis([f"c{i}" for i in range(len(columns))], axis=1) for b in read(it)), schema)
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)))
