"""Routing rules: verdict, value bucket and route of every file, without touching any."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed
from ..functions.paths import basename, extension, slashes
from ..functions.predicates import clean_score, file_type, is_transferred, route


@dataclass(frozen=True)
class RoutingRules:
    prefer_folder: str = "organized"
    transferred_people: tuple[str, ...] = ()
    china_path_signals: tuple[str, ...] = ()
    china_use_cjk: bool = True
    obsolete_years: float = fixed.OBSOLETE_YEARS
    low_value_exts: tuple[str, ...] = tuple(fixed.LOW_VALUE_EXTENSIONS)

    def patched(self, patch: dict) -> RoutingRules:
        known = {k: tuple(v) if isinstance(v, list) else v for k, v in patch.items() if k in self.__dataclass_fields__ and v is not None}
        return replace(self, **known)


def classify(files: DataFrame, now: float, rules: RoutingRules = RoutingRules()) -> DataFrame:
    """Every file with an md5, with ftype, transferred, route, verdict and rot."""
    rows = files.filter(F.col("md5").isNotNull() & (F.col("md5") != ""))
    rows = rows.withColumns({"size": F.coalesce("size", F.lit(0)), "mtime": F.coalesce("mtime", F.lit(0.0)), "ftype": file_type("path"), "transferred": is_transferred("path", list(rules.transferred_people))})
    rows = rows.withColumn("route", route("path", F.col("ftype"), list(rules.china_path_signals), rules.china_use_cjk))
    name = basename("path")
    order = F.struct(F.col("transferred").cast("int").alias("a"), F.when(F.col("folder") == rules.prefer_folder, 0).otherwise(1).alias("b"), F.length(slashes("path")).alias("c"), clean_score(name).alias("d"), (-F.length(name)).alias("e"), F.col("path").alias("f"))
    keepers = rows.groupBy("md5").agg(F.min(order).alias("o"), F.count("*").alias("copies")).select("md5", F.col("o.f").alias("keeper"), "copies")
    rows = rows.join(keepers, "md5")
    rows = rows.withColumn("verdict", F.when((F.col("path") == F.col("keeper")) | (F.col("copies") == 1), "keep").otherwise("redundant"))
    old = (F.col("mtime") != 0) & (F.col("mtime") < now - rules.obsolete_years * 365.25 * 86400) & F.lower(extension(name)).isin(list(rules.low_value_exts)) & (F.col("copies") > 1)
    return rows.withColumn("rot", F.when(F.col("ftype") == "trivial", "trivial").when(F.col("verdict") == "redundant", "redundant").when(old, "obsolete").otherwise("keep"))


def label_counts(rows: DataFrame) -> DataFrame:
    """Counts, bytes and share of every verdict, rot and route, from one pass over grouping sets."""
    sets = rows.groupingSets([["verdict"], ["rot"], ["route"]], "verdict", "rot", "route").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "verdict").when(F.col("g") == 5, "rot").otherwise("route")
    out = sets.select(kind.alias("kind"), F.coalesce("verdict", "rot", "route").alias("label"), "files", "bytes")
    total = rows.agg(F.count("*").alias("all_files"))
    return out.crossJoin(F.broadcast(total)).select("kind", "label", "files", "bytes", F.bround(100 * F.col("files") / F.col("all_files"), 2).alias("percent"))


def summary(rows: DataFrame) -> DataFrame:
    gone, moved = F.col("rot") == "redundant", (F.col("rot") == "redundant") & F.col("transferred")
    per = rows.groupBy("md5").agg(F.count("*").alias("n"), F.sum(F.when(gone, F.col("size")).otherwise(0)).alias("b"), F.count_if(moved).alias("t"), F.sum(F.when(moved, F.col("size")).otherwise(0)).alias("tb"))
    return per.agg(F.sum("n").alias("total_files"), F.count("*").alias("unique_md5"), F.sum("b").alias("reclaimable_bytes"), F.sum("t").alias("transferred_redundant_files"), F.sum("tb").alias("transferred_redundant_bytes"))
