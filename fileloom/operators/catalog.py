"""Catalog search: names by keyword, whole folders, and what lies in none of them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.paths import ancestors, dirname, slashes
from .logstore import Store
from .storage import stored


def rows_with_folders(files: DataFrame) -> DataFrame:
    """A catalog of files and all their folders: path, name, parent, is_dir, size."""
    own = files.select(slashes("path").alias("path"), F.lit(0).alias("is_dir"), F.coalesce("size", F.lit(0)).alias("size"))
    above = files.select(F.explode(ancestors("path")).alias("path")).distinct().select("path", F.lit(1).alias("is_dir"), F.lit(0).cast("long").alias("size"))
    return own.unionByName(above).withColumn("name", F.substring_index("path", "/", -1)).withColumn("parent", dirname("path"))


def next_generation(catalog: DataFrame, root: str) -> int:
    """The number of a root's next crawl."""
    return (catalog.filter(F.col("root") == root).agg(F.max("scan_gen")).first()[0] or 0) + 1


def recrawled(store: Store, crawled: DataFrame) -> DataFrame:
    """Takes a crawl(root, path, is_dir, size, mtime, ..., scan_gen) up into a catalog by path. Rows of
    its roots that it lacks are deleted, those it has anew or otherwise are written, and the others
    keep the generation in which they last changed; so a crawl that finds little writes little.
    Returns the changes: path and change (added, changed, deleted)."""
    if not store.exists():
        store.upsert(crawled.withColumn("seq", F.col("scan_gen")), "path")
        return crawled.select("path", F.lit("added").alias("change"))
    version = store.versions().first()["version"]
    old = store.read(version).join(crawled.select("root").distinct(), "root", "left_semi").select("path", F.struct("is_dir", "size", "mtime").alias("was"))
    both = old.join(crawled.select("path", F.struct("is_dir", "size", "mtime").alias("now")), "path", "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "changed")
    changes = stored(both.select("path", change.alias("change")).filter("change is not null"), "changes")
    fresh = crawled.join(changes.filter("change != 'deleted'").select("path"), "path", "left_semi").select(crawled.columns)
    store.upsert(fresh.withColumn("seq", F.col("scan_gen")), "path").delete(changes.filter("change = 'deleted'").select("path"))
    return changes


def matcher(keywords: list[str], whole_word: bool = False) -> Column:
    hit = F.lit(False)
    for k in (k.strip() for k in keywords):
        if k:
            hit = hit | (F.col("name").rlike(rf"(?iU)\b{re.escape(k)}\b") if whole_word else F.lower("name").contains(k.lower()))
    return hit


def search(catalog: DataFrame, keywords: list[str], whole_word: bool = False) -> DataFrame:
    """Matching folders (with all beneath them: files, bytes) and files: path, is_dir, files, bytes.
    What lies in a matching folder is part of it and not listed. Containment is an equal join on
    exploded ancestors, of the depths alone in which folders match; no prefixes are compared."""
    found = catalog.filter(matcher(keywords, whole_word)).select("path", "is_dir", "size")
    folders = found.filter("is_dir = 1").select("path")
    depth = lambda c: F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit("")))
    depths = [r[0] for r in folders.select(depth(F.col("path"))).distinct().collect()]  # as many as a path has parts
    within = F.filter(ancestors("path"), lambda a: depth(a).isin(depths)) if depths else F.array().cast("array<string>")
    above = found.select("path", F.explode(within).alias("a"))
    covered = above.join(folders.select(F.col("path").alias("a")), "a", "left_semi").select("path").distinct()
    top = found.join(covered, "path", "left_anti")
    inside = catalog.filter("is_dir = 0").select(F.explode(within).alias("path"), "size")
    sums = inside.join(top.filter("is_dir = 1").select("path"), "path", "left_semi").groupBy("path").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return top.join(sums, "path", "left").select("path", "is_dir", F.when(F.col("is_dir") == 1, F.coalesce("files", F.lit(0))).otherwise(1).alias("files"), F.when(F.col("is_dir") == 1, F.coalesce("bytes", F.lit(0))).otherwise(F.col("size")).alias("bytes"))


def search_totals(found: DataFrame) -> DataFrame:
    return found.agg(F.count_if(F.col("is_dir") == 1).alias("folders"), F.count_if(F.col("is_dir") == 0).alias("files"), F.count("*").alias("total_items"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"), F.coalesce(F.sum("files"), F.lit(0)).alias("total_file_count"))


def root_stats(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("root").agg(F.count_if(F.col("is_dir") == 0).alias("file_count"), F.count_if(F.col("is_dir") == 1).alias("dir_count"), F.sum(F.when(F.col("is_dir") == 0, F.col("size")).otherwise(0)).alias("bytes"))


def covering_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Each path's deepest root that holds it, null without one."""
    above = paths.select("path", F.explode(F.concat(ancestors("path"), F.array(slashes("path")))).alias("root"))
    found = above.join(roots.select("root"), "root").groupBy("path").agg(F.max(F.struct(F.length("root").alias("n"), "root")).alias("r"))
    return paths.select("path").join(found.select("path", F.col("r.root").alias("root")), "path", "left")


def children(catalog: DataFrame, parent: str, limit: int = 5000) -> DataFrame:
    """One level: folders first, then names."""
    return catalog.filter(F.col("parent") == parent).orderBy(F.desc("is_dir"), "name").limit(limit)
