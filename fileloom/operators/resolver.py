"""Resolver: categories of duplicate groups, keepers under a source of truth, removals that are safe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.paths import basename, project_root, under
from ..functions.predicates import is_resolver_junk, is_structural

KEYS = {
    "newest": lambda: -F.col("mtime"),
    "oldest": lambda: F.col("mtime"),
    "longest_name": lambda: -F.length(basename("path")),
    "shortest_path": lambda: F.length("path"),
    "smallest": lambda: F.col("size"),
    "biggest": lambda: -F.col("size"),
}


def categories(files: DataFrame, key: str = "md5") -> DataFrame:
    """Per duplicate group: category, sources, structural, project_roots, counts and waste."""
    rows = files.filter(F.col(key).isNotNull() & (F.col(key) != ""))
    out = rows.groupBy(key).agg(
        F.count("*").alias("file_count"),
        F.max("size").alias("largest"),
        F.bool_or(is_structural("path")).alias("structural"),
        F.sort_array(F.collect_set(F.when(F.col("source") != "", F.col("source")))).alias("sources"),
        F.sort_array(F.collect_set(project_root("path"))).alias("project_roots"),
    )
    category = F.when(F.col("structural"), "structural_internal").when(F.size("sources") > 1, "cross_source_redundant").otherwise("single_source")
    return out.filter("file_count > 1").select(key, "file_count", ((F.col("file_count") - 1) * F.col("largest")).alias("wasted"), "structural", "sources", "project_roots", category.alias("category"))


def reason(category: Column, sources: Column, roots: Column) -> Column:
    names = F.coalesce(F.nullif(F.array_join(F.slice(roots, 1, 3), ", "), F.lit("")), F.lit("framework files"))
    return (
        F.when(category == "structural_internal", F.concat(F.lit("Internals of projects ("), names, F.lit("): each needs its own copy.")))
        .when(category == "cross_source_redundant", F.concat(F.lit("In "), F.size(sources).cast("string"), F.lit(" sources ("), F.array_join(sources, ", "), F.lit(").")))
        .otherwise("Copies within one source: look before removing.")
    )


def with_keepers(files: DataFrame, truth: list[str] = (), tiebreak: str = "biggest", key: str = "md5") -> DataFrame:
    """Every copy of every group with its category and keeper; junk takes no part, and groups with
    fewer than two other files have no keeper. Ties go to the first path."""
    rows = files.join(categories(files, key).select(key, "category", "wasted", "file_count"), key)
    able = rows.filter(~is_resolver_junk("path"))
    order = F.struct(F.when(under("path", list(truth)), 0).otherwise(1).alias("a"), KEYS.get(tiebreak, KEYS["biggest"])().alias("b"), F.col("path").alias("c"))
    keeper = able.groupBy(key).agg(F.min(F.struct(order.alias("o"), F.col("path").alias("path"), F.col("source").alias("source"))).alias("k"), F.count("*").alias("able")).filter("able > 1")
    return rows.join(keeper.select(key, F.col("k.path").alias("keep"), F.col("k.source").alias("keep_source")), key, "left")


def removals(files: DataFrame, truth: list[str] = (), within_source: bool = False, tiebreak: str = "biggest", key: str = "md5") -> DataFrame:
    """Copies that may go: never the keeper, a structural file or junk; across sources never what
    lies under the source of truth; within one source only if asked."""
    rows = with_keepers(files, truth, tiebreak, key).filter("keep is not null and path != keep")
    kinds = ["cross_source_redundant", *(["single_source"] if within_source else [])]
    rows = rows.filter(F.col("category").isin(kinds) & ~is_resolver_junk("path") & ~is_structural("path"))
    safe = (F.col("category") == "cross_source_redundant") & under("path", list(truth))
    return rows.filter(~safe).select(key, "path", "size", "source", "keep", "keep_source", "category")


def by_category(groups: DataFrame) -> DataFrame:
    return groups.groupBy("category").agg(F.count("*").alias("groups"), F.sum("file_count").alias("files"), F.sum("wasted").alias("wasted"))


def by_source(plan: DataFrame) -> DataFrame:
    return plan.groupBy("source").agg(F.count("*").alias("files"), F.sum("size").alias("space"))


def protected(groups: DataFrame, plan: DataFrame, key: str = "md5") -> DataFrame:
    """Extra copies and waste of groups that lose nothing."""
    kept = groups.join(plan.select(key).distinct(), key, "left_anti")
    return kept.agg(F.coalesce(F.sum(F.col("file_count") - 1), F.lit(0)).alias("protected_files"), F.coalesce(F.sum("wasted"), F.lit(0)).alias("protected_space"))


def review(files: DataFrame, truth: list[str] = (), limit: int = 500, key: str = "md5") -> DataFrame:
    """Cards of the most wasteful groups: actionable ones first, with what is preselected."""
    rows = with_keepers(files, truth, key=key)
    gone = removals(files, truth, True, key=key).select(key, "path", F.lit(True).alias("auto"))
    rows = rows.join(gone, [key, "path"], "left").withColumn("auto", F.coalesce("auto", F.lit(False)))
    cards = rows.groupBy(key).agg(
        F.first("category").alias("category"),
        F.first("wasted").alias("wasted"),
        F.max("keep").alias("keep"),
        F.count("*").alias("copies"),
        F.count_if("auto").alias("auto_selected"),
        F.coalesce(F.sum(F.when(F.col("auto"), F.col("size"))), F.lit(0)).alias("reclaimable"),
    )
    cards = cards.withColumn("protected", F.col("auto_selected") == 0)
    return cards.orderBy("protected", F.desc("wasted"), key).limit(limit)


def review_totals(cards: DataFrame) -> DataFrame:
    return cards.agg(F.count("*").alias("cards"), F.coalesce(F.sum("auto_selected"), F.lit(0)).alias("auto_selected"), F.coalesce(F.sum("reclaimable"), F.lit(0)).alias("reclaimable"), F.count_if("protected").alias("protected"))
