"""An inverted index of texts as tables: lists of the texts of each word and of each three
characters, so that a search reads the lists of its words and no text, and a LIKE search only texts
that have all its parts.

A list is cut into blocks of at most BLOCK texts in order of id, each a row: the first id and the gaps to the
next ones, how often the word stands in each text and how long that is, and the block's largest count
and shortest text, which bound the score of all its texts. Blocks lie sorted by word in small row
groups, so that a filter on words skips the others. A word of any frequency is spread over tasks by
ranges of word and id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .media import like, terms
from .storage import stored

BLOCK = 256
#: Texts, or characters of them, whose runs of three characters are listed together.
PARTS_TEXTS, PARTS_CHARACTERS = 10_000, 8 << 20
#: Bytes of a row group of the lists.
GROUP_BYTES = 1 << 20
LISTS = "word string, first long, last long, n int, most int, shortest int, gaps array<long>, counts array<int>, sizes array<int>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted (word, id, count, size) as blocks."""
    for b in batches:
        if not b.num_rows:
            continue
        word = b.column("word").dictionary_encode()
        code, ids, count, size = word.indices.to_numpy(), *(b.column(c).to_numpy() for c in ("id", "count", "size"))
        new = np.r_[True, code[1:] != code[:-1]]
        run = np.arange(len(code)) - np.maximum.accumulate(np.where(new, np.arange(len(code)), 0))
        at = np.flatnonzero(run % BLOCK == 0)
        ends = np.append(at[1:], len(code))
        gaps = np.diff(ids, prepend=ids[:1])
        gaps[at] = 0
        offsets = pa.array(np.append(at, len(code)).astype(np.int32))
        arrays = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (gaps, count, size)]
        yield pa.RecordBatch.from_arrays([word.dictionary.take(pa.array(code[at])), pa.array(ids[at]), pa.array(ids[ends - 1]), pa.array((ends - at).astype(np.int32)), pa.array(np.maximum.reduceat(count, at)), pa.array(np.minimum.reduceat(size, at)), *arrays], names=[c.split()[0] for c in LISTS.split(", ")])


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks as rows (word, id, count, size)."""
    for b in batches:
        n = b.column("n").to_numpy()
        if not len(n):
            continue
        gaps = b.column("gaps").flatten().to_numpy()
        sums = np.cumsum(gaps)
        at = np.cumsum(n) - n
        ids = sums - np.repeat(sums[at], n) + np.repeat(b.column("first").to_numpy(), n)
        rows = pa.array(np.repeat(np.arange(len(n)), n))
        yield pa.RecordBatch.from_arrays([b.column("word").take(rows), pa.array(ids), b.column("counts").flatten(), b.column("sizes").flatten()], names=["word", "id", "count", "size"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of each distinct run of three characters, made of PARTS_TEXTS texts and PARTS_CHARACTERS
    characters at a time: a list of ids leaves a task, not a row for each id."""
    ids: list[int] = []
    texts: list[str] = []
    size = 0

    def blocks() -> Iterator[pa.RecordBatch]:
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        own = [texts[i] for i in order.tolist()]
        lengths = np.fromiter(map(len, own), np.int64, len(own))
        points = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).astype(np.int64)
        row = np.repeat(np.arange(len(own)), lengths)
        at = np.flatnonzero(row[2:] == row[:-2])  # runs that lie in one text
        number, parts = pd.factorize(points[at] << 42 | points[at + 1] << 21 | points[at + 2])
        both = np.unique(number * len(own) + row[at])
        three = np.stack([parts >> 42, parts >> 21 & 0x1FFFFF, parts & 0x1FFFFF], 1).astype(np.uint32).tobytes().decode("utf-32-le")
        names = pa.array([three[k : k + 3] for k in range(0, len(three), 3)], pa.string())
        one = pa.array(np.ones(len(both), np.int32))
        held = pa.array(np.array(ids, np.int64)[order][both % len(own)])
        return _blocks(iter([pa.RecordBatch.from_arrays([names.take(pa.array(both // len(own))), held, one, one], names=["word", "id", "count", "size"])]))

    for b in batches:
        for i, t in zip(b.column("id").to_pylist(), b.column("low").to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            size += len(t)
            if len(ids) == PARTS_TEXTS or size >= PARTS_CHARACTERS:
                yield from blocks()
                ids, texts, size = [], [], 0
    if ids:
        yield from blocks()


class TextIndex:
    """The index of texts(id, text), id a long, each once; a null text has no words but counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def built(cls, texts: DataFrame, folder: str, of: tuple[str, ...] = ("words", "parts")) -> TextIndex:
        """of: which lists to make; full_text searches those of words, like those of parts."""
        self = cls(texts.sparkSession, f"{folder.rstrip('/')}/{uuid.uuid4().hex}")
        own = texts.select(F.col("id").cast("long").alias("id"), "text")
        if "words" in of:
            sized = own.select("id", terms("text").alias("t")).withColumn("size", F.size("t"))
            words = sized.select("id", "size", F.explode("t").alias("word")).groupBy("word", "id", "size").agg(F.count("*").cast("int").alias("count"))
            ranged = self._ranged(words.select("word", "id", "count", "size"), "id")
            self._write(ranged.mapInArrow(_blocks, LISTS), "words")
            sized.agg(F.count("*").alias("docs"), F.avg("size").alias("mean")).write.parquet(f"{self.folder}/stats")
        if "parts" in of:
            parts = own.filter("text is not null").select("id", F.lower("text").alias("low")).mapInArrow(_parts, LISTS)
            self._write(self._ranged(stored(parts, "parts"), "first"), "parts")  # ranges are made of a sample, which would be a run of its own
        return self

    def _ranged(self, rows: DataFrame, at: str) -> DataFrame:
        n = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return rows.repartitionByRange(n, "word", at).sortWithinPartitions("word", at)

    def _write(self, lists: DataFrame, name: str) -> None:
        lists.write.option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).parquet(f"{self.folder}/{name}")

    def lists(self, words: list[str], of: str = "words") -> DataFrame:
        """The blocks of some words' lists; the scan skips what lies between other words."""
        return self.spark.read.schema(LISTS).parquet(f"{self.folder}/{of}").filter(F.col("word").isin(words))

    def full_text(self, query: str, limit: int | None = 50, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """BM25 for texts that have all words of the query: id, score, best first; equal to a scan by
        `media.full_text`. With a limit, blocks of the rarest word whose bound is below the score that
        the most promising blocks give already aren't unpacked."""
        words, none = list(dict.fromkeys(query.lower().split())), self.spark.createDataFrame([], "id long, score double")
        lists = self.lists(words)
        seen = {r.word: r for r in lists.groupBy("word").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.min("shortest").alias("shortest")).collect()}
        if not words or len(seen) < len(words):
            return none
        stats = self.spark.read.parquet(f"{self.folder}/stats").first()

        def part(word: str, count: Column, size: Column) -> Column:
            idf = F.greatest(F.log((F.lit(stats.docs) - seen[word].n + 0.5) / (F.lit(seen[word].n) + 0.5)), F.lit(1e-6))
            return idf * count * (k1 + 1) / (count + k1 * (1 - b + b * size / F.lit(stats.mean)))

        def scored(blocks: DataFrame) -> DataFrame:
            rows = blocks.select("word", "first", "n", "gaps", "counts", "sizes").mapInArrow(_posted, "word string, id long, count int, size int")
            per = rows.groupBy("id").agg(F.count("*").alias("n"), *(F.max(F.when(F.col("word") == w, part(w, F.col("count"), F.col("size")))).alias(f"p{k}") for k, w in enumerate(words)))
            total = F.lit(0.0)
            for k in range(len(words)):
                total = total + F.col(f"p{k}")
            return per.filter(F.col("n") == len(words)).select("id", F.round(total, 9).alias("score"))

        best = [F.desc("score"), "id"]
        if limit is None:
            return scored(lists)
        rarest = min(words, key=lambda w: seen[w].n)
        own, others = lists.filter(F.col("word") == rarest), lists.filter(F.col("word") != rarest)
        bound = part(rarest, F.col("most"), F.col("shortest"))
        for w in words:
            if w != rarest:
                bound = bound + part(w, F.lit(seen[w].most), F.lit(seen[w].shortest))
        own = own.withColumn("bound", F.round(bound, 9))
        first = [r[0] for r in own.select("first", "bound").orderBy(F.desc("bound"), "first").limit(max(1, -(-2 * limit // BLOCK))).collect()]
        some = own.filter(F.col("first").isin(first))
        kth = scored(some.drop("bound").unionByName(others)).orderBy(*best).limit(limit).select("score").collect()
        left = own if len(kth) < limit else own.filter(F.col("bound") >= kth[-1].score)
        return scored(left.drop("bound").unionByName(others)).orderBy(*best).limit(limit)

    def holding(self, query: str) -> DataFrame | None:
        """The ids of texts that have every three characters of the query, case aside; null where it
        is too short to say."""
        low = self.spark.range(1).select(F.lower(F.lit(query))).first()[0]
        wanted = sorted({low[k : k + 3] for k in range(len(low) - 2)})
        if not wanted:
            return None
        rows = self.lists(wanted, "parts").select("word", "first", "n", "gaps", "counts", "sizes").mapInArrow(_posted, "word string, id long, count int, size int")
        return rows.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted)).select("id")

    def like(self, texts: DataFrame, query: str) -> DataFrame:
        """texts(id, text, ...) that have the query in them, case aside: candidates by three
        characters, of which the texts are then looked at."""
        ids = self.holding(query)
        return (texts if ids is None else texts.join(ids, "id", "left_semi")).filter(like("text", query))
