"""What is asked of hash indexes, ledgers and caches, which `logstore.Store` holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def lookup(index: DataFrame, md5: str) -> DataFrame:
    """Rows of an index with a content's md5, whatever its case: a filter that the scan takes over."""
    return index.filter(F.col("md5") == md5.strip().lower())


def path_list(wanted: DataFrame, present: DataFrame, index: DataFrame, least: int = 0, force: bool = False, tolerance: float = 1.0) -> DataFrame:
    """What becomes of each of the paths asked for: missing, too_small, skipped_current (the index
    has it in this state; not with force) or to_hash. Rows are told apart by path, and by file_id
    where all three have it, as several files can have one path."""
    file = ["path", *(["file_id"] if all("file_id" in t.columns for t in (wanted, present, index)) else [])]
    have = index.select(*file, F.col("size").alias("s"), F.col("mtime").alias("m"))
    rows = wanted.select(*file).distinct().join(present.select(*file, "size", "mtime"), file, "left").join(have, file, "left")
    current = (F.col("s") == F.col("size")) & (F.abs(F.col("m") - F.col("mtime")) < tolerance)
    state = F.when(F.col("size").isNull(), "missing").when(F.col("size") < least, "too_small")
    if not force:
        state = state.when(current, "skipped_current")
    return rows.select(*file, state.otherwise("to_hash").alias("state"))


def superseded(ledger: DataFrame, renames: DataFrame) -> DataFrame:
    """The ledger with the new paths of renamed files(src, dst, and file_id where both have it)."""
    file = ["path", *(["file_id"] if "file_id" in ledger.columns and "file_id" in renames.columns else [])]
    return ledger.join(renames.withColumnRenamed("src", "path").select(*file, "dst"), file, "left").withColumn("path", F.coalesce("dst", "path")).drop("dst")


def newest(rows: DataFrame, by: str, then: str, limit: int) -> DataFrame:
    return rows.orderBy(F.desc(by), then).limit(limit)


def latest_done(runs: DataFrame) -> DataFrame:
    """The run that last ended, of each kind, and whether a later one is only partial."""
    order = Window.partitionBy("kind")
    done = F.max(F.when(F.col("status") == "completed", F.struct("finished_at", "run_id"))).over(order)
    rows = runs.withColumn("last", done).withColumn("top", F.max(F.struct("finished_at", "run_id")).over(order))
    return rows.select("kind", F.col("last.run_id").alias("run_id"), (F.col("top.run_id") != F.col("last.run_id")).alias("partial_since")).distinct()


def cache_stats(entries: DataFrame) -> DataFrame:
    """Per source of a hash cache: entries, those with a hash, and their bytes."""
    has = F.col("md5").isNotNull() & (F.col("md5") != "")
    return entries.groupBy("source").agg(F.count("*").alias("entries"), F.count_if(has).alias("hashed"), F.coalesce(F.sum(F.when(has, F.col("size"))), F.lit(0)).alias("bytes"))


def replace_by_file(old: DataFrame, new: DataFrame, status: Column | None = None) -> DataFrame:
    """Segments of the files that new has are replaced whole; the others stay."""
    return old.join(new.select("file_id").distinct(), "file_id", "left_anti").unionByName(new if status is None else new.filter(status))
