"""What the operators of this folder share: the cluster's shared folder, tables that cut
lineage, files written from tasks, and bounded Arrow slices."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a task holds as numpy arrays at once.
SLICE_BYTES = 1 << 20
#: Bytes of rows that Spark hands to a Python worker at once.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the session names
    one. Only a local session without it (tests) gets a temporary folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='fileloom-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    if "://" not in named:
        named = f"file://{os.path.abspath(named)}"
    return named.rstrip("/")


def run_dir(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str = "table") -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends there, and a lost
    executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = run_dir(spark, kind)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path  # for discard
    return out


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches are bounded by bytes; by default 10,000 rows of any
    length are one, and stand in the executor's direct memory and in the worker several times over.
    A bound that the session has is kept. Rows and their order don't depend on it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables from stored() that nothing reads any more."""
    for df in tables:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """Filesystem and path of a URI, usable in tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_whole(uri: str, write) -> None:
    """write(stream) into a file that appears under its name only when it is complete, so that
    repeated and speculative task attempts replace each other's file whole."""
    system, path = store(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft, compression=None) as out:
        write(out)
    system.move(draft, path)


def read_bytes(uri: str, start: int, size: int) -> bytes:
    system, path = store(uri)
    with system.open_input_file(path) as f:
        return f.read_at(size, start)


def read_whole(uri: str) -> bytes:
    system, path = store(uri)
    with system.open_input_stream(path, compression=None) as f:
        return f.read()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, cut so that each part holds about limit bytes of the column,
    and one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which the Python worker hands what it has freed back to the system. Spark keeps
    its workers, and memory that one merely holds would count beside the next stage's."""

    def tidy(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(ctypes.CDLL(None), "malloc_trim"):
            ctypes.CDLL(None).malloc_trim(0)

    return tidy


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as one byte array and the n + 1 bounds of its rows in it.
    Null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]
