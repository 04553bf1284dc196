"""Choices by key: what was saved counts, else what the environment says, else the default."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from .logstore import Store


class Choices:
    """keys(key, env_var, default) are what can be chosen; the store holds what was, by key."""

    def __init__(self, store: Store, keys: DataFrame):
        self.store, self.keys = store, keys

    def put(self, chosen: DataFrame) -> None:
        """chosen(key, value, seq): the last of each key is saved; an empty or null value takes what
        was saved back. A key that can't be chosen is an error, and nothing is saved."""
        unknown = [r.key for r in chosen.join(self.keys, "key", "left_anti").select("key").limit(5).collect()]
        if unknown:
            raise KeyError(f"unknown: {unknown}")
        self.store.upsert(chosen.select("key", F.coalesce("value", F.lit("")).alias("value"), "seq"), "key")

    def effective(self, environment: Mapping[str, str]) -> DataFrame:
        """key, value, default, env_var and is_custom of every key. An empty variable says nothing."""
        names = self.keys.sparkSession.createDataFrame([(k, v) for k, v in environment.items() if v], "env_var string, said string")
        saved = self.store.read().filter("value != ''").select("key", F.col("value").alias("saved")) if self.store.exists() else self.keys.limit(0).select("key", F.lit("").alias("saved"))
        rows = self.keys.join(saved, "key", "left").join(names, "env_var", "left")
        return rows.select("key", F.coalesce("saved", "said", "default").alias("value"), "default", "env_var", F.col("saved").isNotNull().alias("is_custom"))
