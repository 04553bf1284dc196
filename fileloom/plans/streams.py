"""Queries that run a stream to its end over what is there, and return what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.storage import shared_folder
from ..streaming import live
from .tables import table

#: A stream takes a table that is one file, too, where its path is a pattern.
ONE = "{}/{}.parque[t]"


def q_running_groups(spark: SparkSession, sf: str) -> DataFrame:
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    docs = live.arriving(spark, ONE.format(sf, "documents"), table(spark, sf, "documents").schema)
    files = docs.select(F.md5("text").alias("hash"), F.col("n_chars").alias("size"))
    live.running_groups(files, f"{at}/out", f"{at}/state").awaitTermination()
    return live.groups_so_far(spark, f"{at}/out").select("hash", "size", "copies", "reclaim")


def q_ring(spark: SparkSession, sf: str) -> DataFrame:
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events = live.arriving(spark, ONE.format(sf, "events"), table(spark, sf, "events").schema)
    live.append_log(events.select("event_id", "ts", "user_id", "event_type"), f"{at}/out", f"{at}/state").awaitTermination()
    return live.ring(spark.read.parquet(f"{at}/out"), ["ts", "event_id"]).select("event_id", "user_id", "event_type")


QUERIES = {"st01_running_groups": q_running_groups, "snk14_log_ring": q_ring}
SQL = {
    "st01_running_groups": "SELECT md5(text) AS hash, n_chars AS size, count(*) AS copies, CAST((count(*) - 1) * n_chars AS BIGINT) AS reclaim FROM documents GROUP BY md5(text), n_chars HAVING count(*) > 1",
    "snk14_log_ring": "SELECT event_id, user_id, event_type FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 2000)",
}
