"""Incremental work as Structured Streaming: duplicate counts while files arrive, hashing of new files
only, and the telemetry log."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.logstore import Store


def arriving(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """Rows of the Parquet files that appear at the path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def running_groups(files: DataFrame, target: str, checkpoint: str, key: str = "hash") -> StreamingQuery:
    """Writes, batch by batch, the counts that changed; the state has one row per key and size."""
    counts = files.groupBy(key, "size").agg(F.count("*").alias("copies"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def groups_so_far(spark: SparkSession, target: str, key: str = "hash") -> DataFrame:
    """Groups of two or more, and what their copies take. Counts only grow: the largest is the last."""
    rows = spark.read.parquet(target).groupBy(key, "size").agg(F.max("copies").alias("copies"))
    return rows.filter("copies > 1").withColumn("reclaim", (F.col("copies") - 1) * F.col("size"))


def enqueue(files: DataFrame, folder: str, batch: int = 300) -> None:
    """Adds files to the queue of a hashing stream, as parts of at most batch rows."""
    files.write.option("maxRecordsPerFile", batch).mode("append").parquet(folder)


class _Unhashed(StatefulProcessor):
    """Per path the size and mtime that were last hashed; lets through what differs."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "size long, mtime double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802  Spark's name
        newest = None
        for b in rows:
            for r in b.itertuples(index=False):
                if newest is None or (r.mtime, r.size) > (newest.mtime, newest.size):
                    newest = r
        known = self.last.get() if self.last.exists() else None
        if newest is not None and (known is None or tuple(known) != (newest.size, newest.mtime)):
            self.last.update((int(newest.size), float(newest.mtime)))
            yield pd.DataFrame({"path": [key[0]], "size": [newest.size], "mtime": [newest.mtime]})

    def close(self) -> None:
        pass


def index_new(files: DataFrame, index: Store, checkpoint: str, hashes: Callable[[DataFrame], DataFrame], compact_after: int = 50) -> StreamingQuery:
    """Hashes the paths of a stream(path, size, mtime) that are new, or of another size or mtime than
    when they were last hashed. What was hashed is state, by path: no batch reads the index, to which
    each adds its own rows; the index is compacted every so many batches. A batch that runs again
    gives the same rows for the same paths. hashes(rows) returns rows with hashes, a path once."""
    conf, provider = files.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    fresh = files.select("path", "size", "mtime").groupBy("path").transformWithStateInPandas(_Unhashed(), "path string, size long, mtime double", "Update", "None")

    def add(batch: DataFrame, number: int) -> None:
        index.upsert(hashes(batch).withColumn("seq", F.lit(number)), "path")
        if number % compact_after == compact_after - 1:
            index.compact()

    before = conf.get(provider, None)
    conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # a stream keeps what is set at its start
    try:
        return fresh.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(add).start()
    finally:
        conf.unset(provider) if before is None else conf.set(provider, before)


def append_log(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    return events.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ring(log: DataFrame, order: list[str], size: int = 2000) -> DataFrame:
    """The newest rows of the log."""
    return log.orderBy(*(F.desc(c) for c in order)).limit(size)
