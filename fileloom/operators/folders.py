"""Folders: recursive statistics, sibling groups, identity by content."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.names import anchor
from ..functions.paths import ancestors, basename, dirname, slashes


def stats(files: DataFrame) -> DataFrame:
    """Per folder, all files beneath it: folder, files, bytes. A file counts in each of its
    ancestors; sums are partial before the shuffle."""
    return files.select(F.explode(ancestors("path")).alias("folder"), F.coalesce("size", F.lit(0)).alias("size")).groupBy("folder").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def has_children(folders: DataFrame) -> DataFrame:
    """folders(path) with parent, name and whether a folder lies in it."""
    rows = folders.select("path", dirname("path").alias("parent"), basename("path").alias("name"))
    inner = rows.select(F.col("parent").alias("path")).distinct().withColumn("has_children", F.lit(True))
    return rows.join(inner, "path", "left").withColumn("has_children", F.coalesce("has_children", F.lit(False)))


def siblings(folders: DataFrame, authoritative: DataFrame | None = None) -> DataFrame:
    """folders(parent, name, files, bytes) with anchor, kind (merge, backfill or ok), canonical.

    Siblings with one anchor are merged where one of them has content. The canonical name is the
    authoritative one of the anchor, else that of the member with most files, then bytes.
    """
    rows = folders.withColumn("anchor", anchor("name"))
    per = rows.groupBy("parent", "anchor").agg(
        F.count("*").alias("members"),
        F.count_if(F.col("files") > 0).alias("filled"),
        F.max(F.when(F.col("files") > 0, F.struct("files", "bytes", "name"))).alias("richest"),
        F.sum("files").alias("total_files"),
    )
    if authoritative is None:
        per = per.withColumn("official", F.lit(None).cast("string"))
    else:
        names = authoritative.select("parent", anchor("name").alias("anchor"), F.col("name").alias("official")).groupBy("parent", "anchor").agg(F.min("official").alias("official"))
        per = per.join(names, ["parent", "anchor"], "left")
    rows = rows.join(per, ["parent", "anchor"])
    merge = (F.col("members") > 1) & (F.col("filled") > 0)
    kind = F.when(merge, "merge").when(F.col("files") > 0, "ok").otherwise("backfill")
    return rows.select("parent", "name", "files", "bytes", "anchor", kind.alias("kind"), F.when(merge, F.coalesce("official", "richest.name")).alias("canonical"), F.when(merge, F.col("total_files")).alias("total_files"))


def sibling_counts(rows: DataFrame) -> DataFrame:
    """Whole-tree totals."""
    per = rows.groupBy("parent", "anchor").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "merge").alias("m"), F.count_if((F.col("kind") == "merge") & (F.col("files") == 0)).alias("shells"), F.count_if(F.col("kind") == "backfill").alias("b"), F.count_if(F.col("kind") == "ok").alias("o"), F.sum(F.when((F.col("kind") == "merge") & (F.col("name") != F.col("canonical")), F.col("files")).otherwise(0)).alias("moving"))
    return per.agg(F.sum("n").alias("subfolders"), F.count_if(F.col("m") > 0).alias("merge_groups"), F.sum("shells").alias("shells_to_merge"), F.sum("b").alias("backfill_candidates"), F.sum("o").alias("ok"), F.sum("moving").alias("files_to_move"))


def destination_votes(matched: DataFrame) -> DataFrame:
    """matched(path, target) to the folder most of a folder's files belong to; ties go to the first
    by name. Votes are counted before they are ranked."""
    votes = matched.select(dirname("path").alias("folder"), dirname("target").alias("destination")).groupBy("folder", "destination").agg(F.count("*").alias("votes"))
    return votes.groupBy("folder").agg(F.sum("votes").alias("matched"), F.min(F.struct((-F.col("votes")).alias("v"), "destination")).alias("b")).select("folder", "matched", F.col("b.destination").alias("destination"), (-F.col("b.v")).alias("votes"))


def analysis(files: DataFrame, matched: DataFrame) -> DataFrame:
    """Per folder, by its own files: real (some are matched to a target), redundant (none, but all
    lie elsewhere too, not under this folder) or unknown. Files are told apart by path, and by file_id
    where both tables have it."""
    file = ["path", *(["file_id"] if "file_id" in files.columns and "file_id" in matched.columns else [])]
    rows = files.select(*file, "md5", dirname("path").alias("folder"))
    home = rows.join(matched.select(*file, F.lit(True).alias("hit")).distinct(), file, "left")
    loose = home.filter("hit is null and md5 != ''").groupBy("folder", "md5").agg(F.count("*").alias("files"))
    held = rows.filter("md5 != ''").groupBy("md5").agg(F.count("*").alias("copies"))
    under = loose.select("folder", "md5").join(files.select("md5", F.explode(ancestors("path")).alias("folder")), ["folder", "md5"]).groupBy("folder", "md5").agg(F.count("*").alias("inside"))
    away = loose.join(held, "md5").join(under, ["folder", "md5"], "left").filter(F.col("copies") > F.coalesce("inside", F.lit(1)))
    away = away.groupBy("folder").agg(F.sum("files").alias("elsewhere"))
    per = home.groupBy("folder").agg(F.count("*").alias("files"), F.count("hit").alias("matched")).join(away, "folder", "left").withColumn("elsewhere", F.coalesce("elsewhere", F.lit(0)))
    kind = F.when(F.col("matched") > 0, "real").when((F.col("elsewhere") > 0) & (F.col("elsewhere") == F.col("files")), "redundant").otherwise("unknown")
    return per.withColumn("kind", kind)


def merge_pairs(folders: DataFrame, renames: DataFrame) -> DataFrame:
    """Renames(path, canonical) whose canonical name is a sibling that exists: source, target."""
    target = F.concat_ws("/", dirname("path"), F.col("canonical"))
    return renames.select(F.col("path").alias("source"), target.alias("target")).join(folders.select(F.col("path").alias("target")), "target", "left_semi").filter("source != target").select("source", "target")


def copies_to_merge(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """Files of each pair's source whose content the target lacks; of equal contents the first path."""
    own = files.filter("md5 != ''").select("path", "md5", F.explode(ancestors("path")).alias("f"))
    inside = own.join(pairs.select(F.col("source").alias("f"), "target"), "f").select("path", "md5", F.col("f").alias("source"), "target")
    there = own.select(F.col("f").alias("target"), "md5").distinct()
    fresh = inside.join(there, ["target", "md5"], "left_anti")
    return fresh.groupBy("source", "target", "md5").agg(F.min("path").alias("path"))


def deepest_first(folders: DataFrame) -> DataFrame:
    return folders.withColumn("depth", F.size(F.split(slashes("path"), "/"))).orderBy(F.desc("depth"), "path")


def relocated(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files of the ledger that are there and whose matched target lies elsewhere: src, dst."""
    target = ledger.filter("status = 'matched' and path != correct_rel_path").select("path", "correct_rel_path")
    return target.join(files.select("path"), "path", "left_semi").select(F.col("path").alias("src"), F.col("correct_rel_path").alias("dst"))


def first_titles(files: DataFrame, generic, extensions: list[str], n: int = 8) -> DataFrame:
    """The n longest descriptive names in each folder."""
    from ..functions.paths import extension, stem

    name = basename("path")
    rows = files.select(dirname("path").alias("folder"), name.alias("name")).filter(F.lower(extension("name")).isin(extensions) & ~generic(F.btrim(stem("name"))))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("folder").orderBy(F.desc(F.length(stem("name"))), F.desc("name"))))
    return ranked.filter(F.col("rank") <= n)
