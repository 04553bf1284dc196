"""Tables in the cluster's shared folder, which end a plan that would otherwise be computed again
by each of its readers."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only for a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='fileloom-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return (named if "://" in named else f"file://{os.path.abspath(named)}").rstrip("/")


def stored(df: DataFrame, kind: str = "table") -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/{kind}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def running(df: DataFrame, keys: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """df with the sum of a column over all rows before within the keys, in the given order. Spread
    like `numbered`."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    ranged = stored(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    sums = ranged.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_part").alias("_p")).agg(F.sum(column).alias("_sum"))
    groups = [f"_k{i}" for i in range(len(keys))]
    earlier = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    inside = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(g)) for k, g in zip(keys, groups, strict=True)), F.col("_part") == F.col("_p"))
    own = ranged.withColumn("_own", F.coalesce(F.sum(column).over(inside), F.lit(0)))
    return own.join(sums, same).withColumn(name, F.col("_own") + F.col("_before")).select(*df.columns, name)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "n") -> DataFrame:
    """df with the number of each row within its keys, in the given order, from 1; null keys are a
    key. Rows are ranged over all partitions by keys and order together, so that a key with a third of
    all rows is spread too; what meets in one place is a count for each key and partition."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    ranged = stored(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    groups = [f"_k{i}" for i in range(len(keys))]
    starts = ranged.groupBy(*(F.col(k).alias(g) for k, g in zip(keys, groups, strict=True)), F.col("_part").alias("_p")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    within = Window.partitionBy(*(groups or [F.lit(0)]))
    before = F.sum("_rows").over(within.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_rows")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(g)) for k, g in zip(keys, groups, strict=True)), F.col("_part") == F.col("_p"))
    return ranged.join(starts, same).withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1).select(*df.columns, name)
