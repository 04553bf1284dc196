"""Token-ID output: documents as token ids in binary files of independent zstandard frames.

File format, one file per partition, little endian throughout:

* frames: each an independent zstandard frame over whole documents' ids (unsigned 16 bit where
  the vocabulary allows it, else 32 bit), about FRAME_IDS ids a frame;
* document table: one zstandard frame with per document doc_id i64, doc_null u8, ids u32,
  frame u32, place in the frame u32;
* seek table: per frame offset u64, compressed u64, ids u32, documents u32, CRC-32 u32 of the
  decompressed bytes;
* footer: frames u32, table offset u64, table bytes u64, table CRC-32 u32, id bytes u8, magic.

A reader takes the footer, the seek table and the document table, then only the frames of the
documents that are asked for, each checked against its CRC.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .chunks import PartTable, cut, gather, per_worker, special_rows
from .shared import discard, flat, read_bytes, released, run_dir, slices, small_batches, store, stored, write_whole

MAGIC = b"FLTOK001"
FOOTER = struct.Struct("<IQQIB8s")
SEEK = np.dtype([("offset", "<u8"), ("size", "<u8"), ("ids", "<u4"), ("docs", "<u4"), ("crc", "<u4")])
DOCS = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("ids", "<u4"), ("frame", "<u4"), ("place", "<u4")])
#: Ids in a frame before it is closed; a longer document has a frame of its own.
FRAME_IDS = 1 << 18


class Encoder:
    """Ids of whole texts by the tokenizers library, as the library gives them without added
    tokens. Parts of texts that a worker has seen before are not encoded again."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer)
        self.kind = np.dtype("<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.table = PartTable(self._learn, self.kind)

    def _learn(self, fresh: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids: list[int] = []
        sizes = np.zeros(len(fresh), np.int64)
        for at in range(0, len(fresh), 20_000):
            for k, e in enumerate(self.library.encode_batch_fast([p.decode() for p in fresh[at : at + 20_000]], add_special_tokens=False), at):
                some = e.ids
                sizes[k] = len(some)
                ids.extend(some)
        return np.array(ids, self.kind), sizes

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the n + 1 bounds of the texts among them. Texts with a
        special string inside go to the library whole."""
        data, bounds = flat(texts)
        odd = special_rows(texts, self.special)
        start, parts = cut(data, bounds)
        if len(odd):  # their own ids stand in for those of their first part
            keep = np.ones(len(start), bool)
            for r in odd:
                keep[parts[r] + 1 : parts[r + 1]] = False
        first, size = self.table(data, start)
        if not len(odd):
            return gather(self.table.values, first, size), np.concatenate([[0], np.cumsum(size)])[parts]
        whole = [np.array(self.library.encode(texts[int(r)].as_py(), add_special_tokens=False).ids, self.kind) for r in odd]
        values = np.concatenate([self.table.values, *whole])
        size[~keep] = 0
        lengths = np.array([len(w) for w in whole], np.int64)
        size[parts[odd]] = lengths
        first[parts[odd]] = len(self.table.values) + np.cumsum(lengths) - lengths
        return gather(values, first, size), np.concatenate([[0], np.cumsum(size)])[parts]


def write_file(uri: str, documents: Iterator[tuple[int | None, bytes]], id_bytes: int) -> tuple[int, int]:
    """Writes (doc_id, ids) in the order given; documents and ids written."""
    seek, table, total = [], [], 0
    squeeze = zstandard.ZstdCompressor(level=1)

    def body(out) -> None:
        nonlocal total
        at, held, ids, docs = 0, [], 0, 0

        def close() -> None:
            nonlocal at, ids, docs
            raw = b"".join(held)
            frame = squeeze.compress(raw)
            out.write(frame)
            seek.append((at, len(frame), ids, docs, zlib.crc32(raw)))
            at, ids, docs = at + len(frame), 0, 0
            held.clear()

        for doc_id, some in documents:
            n = len(some) // id_bytes
            if ids and ids + n > FRAME_IDS:
                close()
            table.append((0 if doc_id is None else doc_id, doc_id is None, n, len(seek), ids))
            held.append(some)
            ids, docs, total = ids + n, docs + 1, total + n
        if docs:
            close()
        listed = squeeze.compress(np.array(table, DOCS).tobytes())
        out.write(listed)
        out.write(np.array(seek, SEEK).tobytes())
        out.write(FOOTER.pack(len(seek), at, len(listed), zlib.crc32(listed), id_bytes, MAGIC))

    write_whole(uri, body)
    return len(table), total


class Reader:
    """One file. Only the tables are read at first; documents() reads the frames asked for."""

    def __init__(self, uri: str):
        self.uri = uri
        system, path = store(uri)
        size = system.get_file_info(path).size
        n, at, listed, crc, self.id_bytes, magic = FOOTER.unpack(read_bytes(uri, size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri}: not a token file")
        tail = read_bytes(uri, at, size - FOOTER.size - at)
        if zlib.crc32(tail[:listed]) != crc:
            raise ValueError(f"{uri}: the document table is damaged")
        self.docs = np.frombuffer(zstandard.ZstdDecompressor().decompress(tail[:listed]), DOCS) if listed else np.zeros(0, DOCS)
        self.seek = np.frombuffer(tail[listed:], SEEK, count=n)

    def frame(self, k: int) -> bytes:
        f = self.seek[k]
        raw = zstandard.ZstdDecompressor().decompress(read_bytes(self.uri, int(f["offset"]), int(f["size"])), max_output_size=max(1, int(f["ids"]) * self.id_bytes))
        if zlib.crc32(raw) != int(f["crc"]):
            raise ValueError(f"{self.uri}: frame {k} is damaged")
        return raw

    def documents(self, rows: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of the rows asked for, or of all, frame by frame."""
        rows = np.arange(len(self.docs)) if rows is None else np.sort(rows)
        last, raw = -1, b""
        for r in rows:
            d = self.docs[r]
            if int(d["frame"]) != last:
                last = int(d["frame"])
                raw = self.frame(last)
            start = int(d["place"]) * self.id_bytes
            yield int(r), np.frombuffer(raw, f"<u{self.id_bytes}", count=int(d["ids"]), offset=start)


def encoded(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Per row: doc_id and the ids of its whole text, end_id last, as little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = per_worker("ids", tokenizer, Encoder)
        end = np.array([end_id], encode.kind).tobytes()
        for b in slices(batches):
            ids, at = encode(b.column("text"))
            raw, at = ids.tobytes(), (at * encode.kind.itemsize).tolist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([raw[x:y] + end for x, y in zip(at, at[1:])], pa.binary()), pa.array([encode.kind.itemsize] * b.num_rows, pa.int32())], ["doc_id", "ids", "id_bytes"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(run), "doc_id long, ids binary, id_bytes int")


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Encodes every text where it lies, and writes files in ascending doc_id order (null first;
    rows of one doc_id by their ids); one row per file: part, uri, docs, ids. A null or empty text
    has the end id alone, a very long one a frame of its own, and repeated rows are each written.
    Ids are shuffled, not texts. The table of files is stored, so that they are written once."""
    spark = docs.sparkSession
    folder = folder or run_dir(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        batches = (b for b in batches if b.num_rows)
        head = next(batches, None)
        if head is None:
            return

        def all_documents():
            for b in chain([head], batches):
                yield from zip(b.column("doc_id").to_pylist(), (x.as_py() for x in b.column("ids")))

        uri = f"{folder}/part-{part:06d}.tok"
        n, ids = write_file(uri, all_documents(), head.column("id_bytes")[0].as_py())
        yield pa.RecordBatch.from_pydict({"part": [part], "uri": [uri], "docs": [n], "ids": [ids]}, schema=pa.schema([("part", pa.int32()), ("uri", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = stored(encoded(docs, tokenizer, end_id), "ids")
    placed = ids.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "ids")
    files = stored(placed.mapInArrow(released(write), "part int, uri string, docs long, ids long"), "token-files")
    discard(ids)
    return files


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, and its uri, in file order. Files are
    read in tasks; what the driver holds is one row per file, for the running total."""
    spark = files.sparkSession
    rows = sorted(files.collect(), key=lambda r: r.part)
    start, plan = 0, []
    for r in rows:
        if r.docs:
            plan.append((r.uri, start))
        start += r.ids

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for uri, at in zip(b.uri, b.start):
                file = Reader(uri)
                crc = np.zeros(len(file.docs), np.int64)
                for r, ids in file.documents():
                    crc[r] = zlib.crc32(ids.astype("<u4").tobytes())
                n = file.docs["ids"].astype(np.int64)
                yield pd.DataFrame({"doc_id": pd.array(file.docs["doc_id"], "Int64").copy(), "start": at + np.cumsum(n) - n, "n_tokens": n, "ids_crc32": crc, "uri": uri}).assign(doc_id=lambda x: x.doc_id.mask(file.docs["null"].astype(bool)))

    listed = spark.createDataFrame(plan, "uri string, start long").repartition(max(1, len(plan)))
    return listed.mapInPandas(released(read), "doc_id long, start long, n_tokens long, ids_crc32 long, uri string")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Writes the token files, then reads them back: doc_id, start, n_tokens, ids_crc32 and uri of
    every row, repeated rows and rows without doc_id included; null and empty texts are the end id
    alone, and an empty table gives no rows."""
    return read_token_files(write_token_files(docs, tokenizer, end_id, folder))
