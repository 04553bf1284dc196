"""Cloud drives: listings, trees, and which drive a folder came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.paths import sanitised
from .storage import stored


def index(listing: DataFrame) -> DataFrame:
    """A listing of text columns as id, name, parent, mime, md5, size, is_folder. The parent is the
    first non-empty of its three spellings; a size that isn't all digits is unknown."""
    have = [c for c in ("parents.0.id", "parents.0", "parents") if c in listing.columns]
    parent = F.coalesce(*[F.nullif(F.col(f"`{c}`"), F.lit("")) for c in have], F.lit("")) if have else F.lit("")
    mime = F.btrim(F.coalesce("mimeType", F.lit("")))
    return listing.select(
        F.btrim("id").alias("id"), F.coalesce("name", F.lit("")).alias("name"), F.btrim(parent).alias("parent"), mime.alias("mime"), F.lower(F.btrim(F.coalesce("md5Checksum", F.lit("")))).alias("md5"),
        F.when(F.col("size").rlike(r"^\d+$"), F.col("size").cast("long")).alias("size"), (mime == fixed.FOLDER_TYPE).alias("is_folder"),
    ).filter("id is not null and id != ''")


def climbed(nodes: DataFrame) -> DataFrame:
    """id, rel_path and depth of every node(id, up, name) whose way up ends, at a node without up. Ways
    double in length from step to step, so that a chain of n nodes takes log2(n) stored joins. A way
    that hasn't ended when it is longer than there are nodes goes round a cycle: its node has no path,
    and if it has another way that ends, which takes a repeated id, that is an error."""
    own = stored(nodes.select("id", "up", F.col("name").alias("rel_path"), F.lit(1).cast("long").alias("depth")), "nodes")
    most, length = own.count(), 1
    while not own.filter("up is not null").isEmpty() and length <= most:
        above = own.select(F.col("id").alias("at"), F.col("up").alias("next"), F.col("rel_path").alias("above"), F.col("depth").alias("more"))
        further = own.filter("up is not null").join(above, F.col("up") == F.col("at")).select("id", F.col("next").alias("up"), F.concat("above", F.lit("/"), "rel_path").alias("rel_path"), (F.col("depth") + F.col("more")).alias("depth"))
        own, length = stored(own.filter("up is null").unionByName(further), "ways"), 2 * length
    ended, round_ = own.filter("up is null").drop("up"), own.filter("up is not null").select("id")
    if not ended.join(round_, "id", "left_semi").isEmpty():
        raise ValueError("a repeated id makes a cycle that a root reaches")
    return ended.withColumn("depth", F.col("depth").cast("int"))


def paths(nodes: DataFrame) -> DataFrame:
    """id, rel_path and depth of every node(id, parent, name). A parent that isn't listed makes a node
    a root; nodes of a cycle, which no root reaches, have no path."""
    ids = nodes.select(F.col("id").alias("known")).distinct()
    return climbed(nodes.join(ids, F.col("parent") == F.col("known"), "left").select("id", F.col("known").alias("up"), "name"))


def office_path(rel: Column, mime: Column) -> Column:
    """A native document's path with the extension it is exported with."""
    out = rel
    for kind, ext in fixed.OFFICE_TYPES.items():
        native = mime == f"application/vnd.google-apps.{kind}"
        out = F.when(native & ~F.lower(rel).endswith("." + ext), F.concat(rel, F.lit("." + ext))).otherwise(out)
    return out


def target_dir(path: Column, own_name: str | None = None) -> Column:
    """A drive path without its wrapper ('My Drive' or the drive's own name), each part made safe."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    wrapper = F.lower(F.get(parts, F.lit(0))).isin(["my drive", *([own_name.lower()] if own_name else [])])
    kept = F.when(wrapper, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.array_join(F.transform(kept, sanitised), "/")


def label(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.btrim(F.col(c) if isinstance(c, str) else c)), r"\s+", " ")


def match_folders(disk: DataFrame, drives: DataFrame, least: float = 0.5, margin: float = 0.15, close: float = 0.3) -> DataFrame:
    """disk(resource, folder) and drives(drive, folder), both sets of top folder names: per resource
    its best drive by Jaccard similarity if at least so similar, the runner-up's score, and
    whether that is close. Only pairs that share a name are compared; best ties go to the first
    name."""
    d = disk.select("resource", label("folder").alias("folder")).distinct()
    r = drives.select("drive", label("folder").alias("folder")).distinct()
    sizes_d, sizes_r = d.groupBy("resource").agg(F.count("*").alias("n")), r.groupBy("drive").agg(F.count("*").alias("m"))
    shared = d.join(r, "folder").groupBy("resource", "drive").agg(F.count("*").alias("k"))
    scored = shared.join(sizes_d, "resource").join(sizes_r, "drive").withColumn("score", F.col("k") / (F.col("n") + F.col("m") - F.col("k")))
    w = Window.partitionBy("resource").orderBy(F.desc("score"), "drive")
    best = scored.withColumn("rank", F.row_number().over(w)).withColumn("second", F.coalesce(F.lead("score").over(w), F.lit(0.0))).filter("rank = 1")
    out = disk.select("resource").distinct().join(best, "resource", "left")
    hit = F.coalesce(F.col("score"), F.lit(0.0)) >= least
    return out.select("resource", F.when(hit, F.col("drive")).alias("drive"), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"), F.round(F.coalesce("second", F.lit(0.0)), 6).alias("runner_up"), F.coalesce(hit & (F.col("score") - F.col("second") < margin) & (F.col("second") > close), F.lit(False)).alias("ambiguous"))


def display_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """The second and later uses of a name get ' (2)', ' (3)' ... in the given order."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return rows.withColumn("k", k).withColumn("display_name", F.when(F.col("k") > 1, F.concat(F.col(name), F.lit(" ("), F.col("k").cast("string"), F.lit(")"))).otherwise(F.col(name))).drop("k")


def overlay(automatic: DataFrame, manual: DataFrame, key: str, value: str) -> DataFrame:
    """Manual entries go before automatic ones; an empty manual entry takes the override away."""
    m = manual.filter(F.col(value) != "").select(key, F.col(value).alias("m"))
    return automatic.select(key, F.col(value).alias("a")).join(m, key, "full").select(key, F.coalesce("m", "a").alias(value), F.col("m").isNotNull().alias("manual"))
