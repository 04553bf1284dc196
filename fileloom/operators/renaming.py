"""Rename proposals: bulk previews by kind of file, folder names from what lies in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.names import templated
from ..functions.paths import basename, dirname, short_name, stem
from ..functions.predicates import is_generic, type_group


#: Characters of a shared first part, at least and at most.
LEAST_START, SHARED_START = 12, 20


def preview(files: DataFrame, conventions: dict[str, dict], values: dict[str, Column]) -> DataFrame:
    """original_path, original_name, type_group, new_name, new_path. conventions maps a type group to
    the keywords of templated(); 'default' is for all others."""
    name, group = basename("path"), type_group("path")
    new = templated(name, values=values, **conventions["default"])
    for kind, how in conventions.items():
        if kind != "default":
            new = F.when(F.col("type_group") == kind, templated(name, values=values, **how)).otherwise(new)
    rows = files.withColumn("type_group", group).withColumn("new_name", new)
    path = F.when(dirname("path") != "", F.concat(dirname("path"), F.lit("/"), F.col("new_name"))).otherwise(F.col("new_name"))
    return rows.select(F.col("path").alias("original_path"), name.alias("original_name"), "type_group", "new_name", path.alias("new_path"))


def folder_prefix(name: Column) -> Column:
    """A leading date with the label after it, kept as it is."""
    return F.regexp_extract(name, fixed.DATED_LABEL, 1)


def from_title(folder: Column, title: Column) -> tuple[Column, Column]:
    """(proposal, confidence) for a folder from a descriptive file name inside it: 0.9 where it goes
    on from the folder's cut name, else 0.6; null where the title says too little."""
    dated = folder_prefix(folder)

    def proposed(said: Column) -> Column:
        useful = (F.length(said) >= 8) & ~is_generic(said)
        has_date = F.startswith(F.lower(said), F.lower(dated))
        return F.when(useful, short_name(F.concat(F.when(has_date, F.lit("")).otherwise(dated), said), 180))

    def certainty(found: Column) -> Column:
        """How much of the folder's own name, but for its last four characters, begins the proposal."""
        own = F.lower(F.regexp_replace(folder, fixed.CUT_END, ""))
        says = F.btrim(F.replace(own, F.lower(dated), F.lit(""))) != ""
        begun = F.substr(own, F.lit(1), F.greatest(F.lit(8), F.length(own) - 4))
        return F.when(found.isNotNull(), F.when(says & F.startswith(F.lower(found), begun), 0.9).otherwise(0.6))

    found = proposed(F.btrim(F.regexp_replace(stem(title), fixed.NUMBERED_EVENT, ""), F.lit(" ()-")))
    return found, certainty(found)


def review_order(proposals: DataFrame, limit: int) -> DataFrame:
    """The first of the proposals: changes, then the least certain."""
    return proposals.orderBy(F.desc("is_change"), "confidence", "path").limit(limit)


def downgraded(advice: DataFrame) -> DataFrame:
    """advice(classification, action, readable, evidence, confidence, ...) held to its contract: what
    was not read, or cites nothing, is for a human, and is less certain."""
    unread = ~F.col("readable") & ~F.col("classification").isin("needs_human_review", "needs_more_content", "project_internal")
    bare = F.btrim(F.coalesce("evidence", F.lit(""))) == ""
    human = unread | ((F.col("classification") == "redundant_backup") & bare)
    return advice.withColumns(
        {
            "classification": F.when(human, "needs_human_review").otherwise(F.col("classification")),
            "action": F.when(human, "human_review").otherwise(F.col("action")),
            "needs_review": bare | (F.col("confidence") < 0.8),
            "confidence": F.when(bare, F.least("confidence", F.lit(0.3))).otherwise(F.col("confidence")),
        }
    )


def sidecars(files: DataFrame) -> DataFrame:
    """.json files that accompany a sibling: it has their base as its name or as the start of it, or
    shares a first part of 12 to 20 characters. Siblings meet by folder and that first part, which
    all names give in each of its lengths."""
    name = F.lower(basename("path"))
    rows = files.select("path", dirname("path").alias("folder"), name.alias("name"))
    json = rows.filter(F.col("name").endswith(".json")).withColumn("base", F.regexp_replace("name", r"\.json$", "")).withColumn("head", F.substring(F.rtrim("base", F.lit("( ")), 1, SHARED_START))
    other = rows.filter(~F.col("name").endswith(".json")).select("folder", F.col("name").alias("other"))
    starts = other.select("folder", F.explode(F.transform(F.sequence(F.lit(0), F.least(F.lit(SHARED_START), F.length("other"))), lambda k: F.substr("other", F.lit(1), k))).alias("start")).distinct()
    enough = F.length("head") >= LEAST_START
    short = json.withColumn("start", F.when(enough, F.col("head")).otherwise(F.col("base"))).filter(F.length("start") <= SHARED_START).join(starts, ["folder", "start"], "left_semi")
    # a base that ends in many brackets or spaces is longer than what it is looked up by
    long = json.filter(~enough & (F.length("base") > SHARED_START)).withColumn("start", F.substring("base", 1, SHARED_START))
    long = long.join(other.withColumn("start", F.substring("other", 1, SHARED_START)), ["folder", "start"]).filter(F.startswith("other", "base"))
    return short.select("path").union(long.select("path")).distinct()
