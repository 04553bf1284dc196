"""Listings that a cloud drive's command line writes as CSV, and tables that runs leave behind."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.drives import climbed
from ..operators.storage import stored
from .csvranges import RANGE_BYTES, read_ranges


def csv_listing(spark: SparkSession, path: str, columns: list[str], expect_rows: bool = False, retries: int = 1, again: Callable[[], None] | None = None, wait: float = 2.0, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The named columns as text, whichever of them the files have; a column that a file lacks is
    null, so that listings of several versions can be read together. Large files are read by many
    tasks, whatever their quotes hold.

    Where rows are expected, a listing without any counts as a failure that may pass: it is asked for
    again (by the caller's function) and read anew after a pause, so many times; then it is empty."""
    for left in range(retries, -1, -1):
        try:
            found = read_ranges(spark, path, columns, range_bytes)
        except AnalysisException:  # there is no file
            if not left or not expect_rows:
                return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
        else:
            if not left or not expect_rows or not found.isEmpty():
                return found
        time.sleep(wait)
        if again:
            again()
    raise AssertionError("the last try returns")


def names(listing: DataFrame, column: str) -> DataFrame:
    """Trimmed values that aren't empty, each once."""
    return listing.select(F.trim(F.col(f"`{column}`")).alias("name")).filter("name != ''").distinct()


def replace_drive(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of old, but for drives that new has rows of, and new's; a missing size is 0."""
    kept = old.join(new.select("drive_id").distinct(), "drive_id", "left_anti")
    return kept.unionByName(new.withColumn("size", F.coalesce("size", F.lit(0).cast("long"))))


def latest(runs: DataFrame, key: str, at: str = "updated_at") -> DataFrame:
    """The newest row of each key."""
    order = Window.partitionBy(key).orderBy(F.desc(at))
    return runs.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def tree_below(folders: DataFrame, parent: str, depth: int | None = None) -> DataFrame:
    """folders(id, name, parent_id) below parent, with rel_dir. To a depth that the caller asks for,
    one stored join per level; without one, by ways that double in length. A folder that lies below
    itself comes from a cycle, and is an error."""
    if depth is None:
        ids = folders.select(F.col("id").alias("known")).distinct()
        top = F.col("parent_id") == parent
        rows = folders.join(ids, F.col("parent_id") == F.col("known"), "left").filter(F.coalesce(top, F.lit(False)) | F.col("known").isNotNull())
        found = stored(climbed(rows.select("id", F.when(~top, F.col("known")).alias("up"), "name")).select("id", F.col("rel_path").alias("rel_dir")), "below")
        if not found.filter(F.col("id") == parent).isEmpty():
            raise ValueError("folders make a cycle")
        return found
    own = stored(folders.select("id", "name", "parent_id"), "folders")
    level = stored(own.filter(F.col("parent_id") == parent).select("id", F.col("name").alias("rel_dir")), "level")
    out, k = level, 1
    while k < depth and not level.isEmpty():
        above = level.select(F.col("id").alias("parent_id"), F.col("rel_dir").alias("above"))
        level = stored(own.join(above, "parent_id").select("id", F.concat_ws("/", "above", "name").alias("rel_dir")), "level")
        out, k = out.union(level), k + 1
    return out
