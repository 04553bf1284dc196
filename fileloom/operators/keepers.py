"""Keeper rules across two trees: which copy of a group stays.

The keeper is the smallest of a struct of sort keys, an aggregate with partial results: a group
that holds a third of all files costs one row per task, not a sort of the group.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.paths import basename, contains_any, slashes
from ..functions.predicates import clean_score, is_junk


@dataclass(frozen=True)
class KeeperRule:
    prefer_folder: str = "organized"
    prefer_paths: tuple[str, ...] = ()
    avoid_paths: tuple[str, ...] = ()
    tiebreakers: tuple[str, ...] = ("cleanest_name", "shortest_path", "longest_name")
    columns: dict = field(default_factory=dict, compare=False)

    def patched(self, patch: dict) -> KeeperRule:
        """Known, non-null entries of a patch replace the rule's own."""
        known = {"prefer_folder", "prefer_paths", "avoid_paths", "tiebreakers"}
        return replace(self, **{k: tuple(v) if isinstance(v, list) else v for k, v in patch.items() if k in known and v is not None})


def tiebreak(name: str) -> Column:
    """Smallest first; an unknown name ranks all alike."""
    base, mtime = basename("path"), F.coalesce("mtime", F.lit(0.0))
    return {
        "cleanest_name": clean_score(base),
        "shortest_path": F.length(slashes("path")),
        "longest_path": -F.length(slashes("path")),
        "longest_name": -F.length(base),
        "shortest_name": F.length(base),
        "newest": -mtime,
        "oldest": mtime,
    }.get(name, F.lit(0))


def sort_keys(rule: KeeperRule) -> list[Column]:
    folder = F.when(F.col("folder") == rule.prefer_folder, 0).otherwise(1) if rule.prefer_folder in ("organized", "snapshot") else F.lit(1)
    ranked = None
    for k, part in enumerate(rule.prefer_paths):
        if part:
            hit = contains_any("path", [part])
            ranked = F.when(hit, k) if ranked is None else ranked.when(hit, k)
    none = len(rule.prefer_paths) + 1
    prefer = F.lit(none) if ranked is None else ranked.otherwise(none)
    avoid = F.when(contains_any("path", list(rule.avoid_paths)), 1).otherwise(0)
    return [folder, prefer, avoid, *map(tiebreak, rule.tiebreakers)]


def copies(files: DataFrame) -> DataFrame:
    """What takes part: files with an md5 that aren't junk; null sizes and times are 0."""
    own = files.filter(F.col("md5").isNotNull() & (F.col("md5") != "") & ~is_junk("path"))
    return own.withColumns({"size": F.coalesce("size", F.lit(0)), "mtime": F.coalesce("mtime", F.lit(0.0))})


def _file(files: DataFrame) -> Column:
    """What tells files apart, as a struct at: their path, and of equal paths their file_id, if they have one."""
    return F.struct("path", F.col("file_id") if "file_id" in files.columns else F.lit(None).cast("long").alias("file_id"))


def _best(files: DataFrame, rule: KeeperRule) -> DataFrame:
    """Per md5: the keeper's path and id, ambiguous, copies, and whether copies lie in either tree. Copies are counted
    by their sort keys first, so that a group of any size is a few rows when it meets."""
    keyed = files.withColumn("k", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(sort_keys(rule))]))
    spans = [F.bool_or(F.col("folder") == f).alias(c) for f, c in (("organized", "o"), ("snapshot", "s"))]
    level = keyed.groupBy("md5", "k").agg(F.min(_file(files)).alias("at"), F.count("*").alias("n"), *spans)
    per = level.groupBy("md5").agg(F.min(F.struct("k", "at", "n")).alias("best"), F.sum("n").alias("copies"), F.bool_or("o").alias("o"), F.bool_or("s").alias("s"))
    return per.select("md5", F.col("best.at.path").alias("keeper"), F.col("best.at.file_id").alias("keeper_id"), (F.col("best.n") > 1).alias("ambiguous"), "copies", "o", "s")


def _overridden(chosen: DataFrame, files: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """chosen with the keepers that overrides name, where these are copies of their groups."""
    if overrides is None:
        return chosen.withColumn("ai_resolved", F.lit(False))
    valid = files.join(overrides.select("md5", F.col("keeper").alias("path")), ["md5", "path"], "left_semi").groupBy("md5").agg(F.min(_file(files)).alias("override"))
    named = F.col("override").isNotNull()
    out = chosen.join(valid, "md5", "left").withColumns({"keeper": F.coalesce("override.path", "keeper"), "keeper_id": F.when(named, F.col("override.file_id")).otherwise(F.col("keeper_id")), "ambiguous": F.col("ambiguous") & ~named, "ai_resolved": named})
    return out.drop("override")


def choose(files: DataFrame, rule: KeeperRule, overrides: DataFrame | None = None) -> DataFrame:
    """Per md5: keeper, ambiguous (several copies share all sort keys), ai_resolved (an override
    names a copy of the group, and so is the keeper)."""
    return _overridden(_best(files, rule), files, overrides).select("md5", "keeper", "ambiguous", "ai_resolved")


def marked(files: DataFrame, rule: KeeperRule = KeeperRule(), cross_only: bool = False, snapshot_only: bool = False, overrides: DataFrame | None = None) -> DataFrame:
    """Every copy of every group with is_keeper, removable, cross_folder, ambiguous, ai_resolved. One
    copy is the keeper, also where several have its path and differ in file_id.

    snapshot_only: only snapshot copies with an organized copy go, and the keeper is organized.
    """
    own = copies(files)
    per = _best(own, rule)
    pool = own
    if snapshot_only:
        pool = own.filter("folder = 'organized'")
        per = _best(pool, rule).select("md5", "keeper", "keeper_id", "ambiguous").join(per.select("md5", "copies", "o", "s"), "md5")
    per = per.filter("copies > 1 and o and s" if cross_only or snapshot_only else "copies > 1")
    per = _overridden(per, pool, overrides).withColumn("cross_folder", F.col("o") & F.col("s")).drop("copies", "o", "s")
    rows = own.join(per, "md5")
    keeper = (F.col("path") == F.col("keeper")) & _file(rows)["file_id"].eqNullSafe(F.col("keeper_id"))
    gone = F.col("folder") == "snapshot" if snapshot_only else ~keeper
    return rows.withColumns({"is_keeper": keeper, "removable": gone}).drop("keeper_id")


def groups(rows: DataFrame) -> DataFrame:
    """One row per group that loses files."""
    out = rows.groupBy("md5").agg(
        F.first("keeper").alias("keeper"),
        F.count_if("removable").alias("redundant_count"),
        F.coalesce(F.sum(F.when(F.col("removable"), F.col("size"))), F.lit(0)).alias("reclaim"),
        F.first("cross_folder").alias("cross_folder"),
        F.first("ambiguous").alias("ambiguous"),
        F.first("ai_resolved").alias("ai_resolved"),
    )
    return out.filter("redundant_count > 0")


def summary(groups: DataFrame) -> DataFrame:
    cross, n, b = F.col("cross_folder"), F.col("redundant_count"), F.col("reclaim")
    total = lambda c, on=None: F.coalesce(F.sum(c if on is None else F.when(on, c)), F.lit(0))
    return groups.agg(
        F.count("*").alias("duplicate_groups"),
        total(n).alias("redundant_files"),
        total(b).alias("reclaimable_bytes"),
        F.count_if(cross).alias("cross_folder_groups"),
        total(n, cross).alias("cross_folder_redundant_files"),
        total(b, cross).alias("cross_folder_reclaimable_bytes"),
        F.count_if(~cross).alias("within_folder_groups"),
        total(n, ~cross).alias("within_folder_redundant_files"),
        F.count_if("ambiguous").alias("ambiguous_groups"),
    )


def page(rows: DataFrame, contains: str | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
    """Groups by reclaimable bytes, with the number of all that match; contains: the keeper's or a
    removable copy's path holds the text."""
    found = groups(rows)
    if contains:
        low = contains.lower()
        hit = rows.filter((F.col("is_keeper") | F.col("removable")) & F.lower(slashes("path")).contains(low)).select("md5")
        found = found.join(hit, "md5", "left_semi")
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy(F.desc("reclaim"), "md5").offset(offset).limit(limit).crossJoin(F.broadcast(total))


def one_keeper_each(rows: DataFrame) -> DataFrame:
    """Groups that break the rule that exactly one copy is the keeper; empty if all is well."""
    return rows.groupBy("md5").agg(F.count_if("is_keeper").alias("keepers")).filter("keepers != 1")


def groups_within(rows: DataFrame, part: str) -> DataFrame:
    """Groups whose keeper or a removable copy has the text in its path, case and slashes aside."""
    hit = rows.filter((F.col("is_keeper") | F.col("removable")) & contains_any("path", [part])).select("md5").distinct()
    return groups(rows).join(hit, "md5", "left_semi")


def all_but_keeper(rows: DataFrame, spared: Column) -> DataFrame:
    """The copies that a bulk selection takes, by path: all but each group's keeper, and none that is spared."""
    return rows.filter((F.col("path") != F.col("keeper")) & ~spared)
