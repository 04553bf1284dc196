"""Mixing sources by temperature, in DataFrame expressions only.

A source with a share p of all tokens gets the weight p^a / sum of p^a. The exponent a in [0, 1] is
the smallest whose weights keep a repetition limit and stay within a target entropy: a = 1 leaves
shares as they are, a = 0 makes them equal. The budget is such that every source is used at least
once in whole, so that no document is lost, unless the caller gives one.

A source's weight is realised in epochs: whole passes, and for the fraction a permutation of hash
blocks, taken in order until the tokens left are spent; in the block where they run out, documents
in hash order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from .shared import stored

SEED = 20240301
OWN = "mix_own_"
TOKEN = r"[^\x20\x09-\x0D]+"


def shares(docs: DataFrame) -> DataFrame:
    """One row per source (null is a source too): tokens and docs."""
    return docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))


def exponent(sources: DataFrame, repetition: float | None, entropy: float | None, places: int = 6) -> float:
    """Bisects a, five halvings a job: each job evaluates 33 exponents over all sources.

    repetition bounds the epochs of the most repeated source while the least repeated has one.
    entropy (0 to 1, of the logarithm of the number of sources) bounds how even weights become.
    """
    some = sources.filter("tokens > 0")
    total = some.agg(F.sum("tokens").alias("n"), F.min("tokens").alias("low"), F.max("tokens").alias("high"), F.count("*").alias("k")).first()
    if not total.k or total.k == 1:
        return 1.0
    low, high = 0.0, 1.0
    while high - low > 10.0**-places:
        grid = [low + (high - low) * i / 32 for i in range(33)]
        p = F.col("tokens") / F.lit(float(total.n))
        rows = (
            some.select(p.alias("p"), F.explode(F.array(*map(F.lit, grid))).alias("a"))
            .groupBy("a")
            .agg(F.sum(F.pow("p", "a")).alias("z"), F.sum(F.pow("p", "a") * F.log("p")).alias("s"))
            .collect()
        )
        even = {r.a: (math.log(r.z) - r.a * r.s / r.z) / math.log(total.k) for r in rows}

        def fits(a: float) -> bool:
            most = math.exp((a - 1) * math.log(total.low / total.high))
            return (repetition is None or most <= repetition * (1 + 1e-12)) and (entropy is None or even[a] <= entropy)

        k = next((i for i, a in enumerate(grid) if fits(a)), 32)
        low, high = (grid[k - 1], grid[k]) if k else (grid[0], grid[0])
    return math.ceil(high * 10**places - 1e-9) / 10**places  # rounded to where the limits hold


def plan(narrow: DataFrame, repetition: float | None, entropy: float | None, budget_tokens: int | None) -> DataFrame:
    """Per source: weight, epochs, whole passes, number of blocks, and where the last pass ends."""
    sources = stored(shares(narrow), "sources")
    a = exponent(sources, repetition, entropy)
    total = sources.agg(F.sum("tokens").alias("n"), F.max("tokens").alias("high")).first()
    n, high = float(total.n or 0) or 1.0, float(total.high or 0) or 1.0
    z = sources.filter("tokens > 0").agg(F.sum(F.pow(F.col("tokens") / n, F.lit(a)))).first()[0] or 1.0
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / n, F.lit(a)) / z).otherwise(0.0)
    budget = float(budget_tokens) if budget_tokens is not None else z * high / (high / n) ** a
    per = sources.withColumn("weight", weight).withColumn("epochs", F.when(F.col("tokens") > 0, F.round(F.lit(budget) * F.col("weight") / F.col("tokens"), 9)).otherwise(1.0))
    per = per.withColumn("whole", F.floor("epochs")).withColumn("left_tokens", F.floor((F.col("epochs") - F.col("whole")) * F.col("tokens"))).withColumn("blocks", F.ceil(F.sqrt("docs")))
    per = stored(per.select("*", F.lit(a).alias("exponent"), F.lit(budget).alias("budget")), "weights")
    placed = narrow.join(per.select(F.col("source").alias("s"), "blocks", "left_tokens"), F.col("source").eqNullSafe(F.col("s"))).filter("left_tokens > 0").select("source", "n_tokens", "doc_key", F.pmod("doc_key", "blocks").alias("block"), "left_tokens")
    sums = placed.groupBy("source", "block", "left_tokens").agg(F.sum("n_tokens").alias("t")).withColumn("block_key", F.xxhash64("source", "block", F.lit(SEED)))
    running = sums.withColumn("cum", F.sum("t").over(Window.partitionBy("source").orderBy("block_key", "block").rowsBetween(Window.unboundedPreceding, 0)))
    ends = running.filter("cum > left_tokens").groupBy("source").agg(F.min(F.struct("cum", "block_key", "block", "t", "left_tokens")).alias("e")).select("source", F.col("e.block").alias("end_block"), F.col("e.block_key").alias("end_key"), (F.col("e.left_tokens") - F.col("e.cum") + F.col("e.t")).alias("rest"))
    ends = stored(ends, "ends")
    inside = placed.join(ends.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("end_block")))
    taken = inside.withColumn("cum", F.sum("n_tokens").over(Window.partitionBy("source").orderBy("doc_key").rangeBetween(Window.unboundedPreceding, 0))).filter("cum <= rest").groupBy("source").agg(F.max("doc_key").alias("end_doc"))
    cut = ends.join(taken.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")), "left").select(F.col("source").alias("s"), "end_block", "end_key", "end_doc")
    return per.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def _counted(docs: DataFrame, repetition: float | None, entropy: float | None, budget_tokens: int | None) -> DataFrame:
    """Each row of docs, its columns renamed by OWN, beside mix_tokens, mix_copies, mix_weight,
    mix_epochs, mix_exponent, mix_source, mix_block, mix_block_key and mix_doc_key."""
    tokens = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(TOKEN)), F.lit(0)).cast("long")
    key = F.xxhash64(F.col("doc_id").cast("long"), F.lit(SEED))
    source = F.col("source").cast("string")
    narrow = stored(docs.select(source.alias("source"), tokens.alias("n_tokens"), key.alias("doc_key")), "tokens")
    per = stored(plan(narrow, repetition, entropy, budget_tokens), "plan")
    per = per.select(F.col("source").alias("mix_source"), "whole", "blocks", "left_tokens", "end_block", "end_key", "end_doc", F.col("weight").alias("mix_weight"), F.col("epochs").alias("mix_epochs"), F.col("exponent").alias("mix_exponent"))
    rows = docs.select(*(F.col(f"`{c}`").alias(f"{OWN}{k}") for k, c in enumerate(docs.columns)), source.alias("own_source"), tokens.alias("mix_tokens"), key.alias("mix_doc_key"))
    rows = rows.join(per, F.col("own_source").eqNullSafe(F.col("mix_source")), "left")
    rows = rows.withColumn("mix_block", F.pmod("mix_doc_key", "blocks")).withColumn("mix_block_key", F.xxhash64("mix_source", "mix_block", F.lit(SEED)))
    extra = F.when(F.col("left_tokens") <= 0, 0).when(F.col("end_key").isNull(), 1).when(F.col("mix_block") == F.col("end_block"), F.when(F.col("mix_doc_key") <= F.col("end_doc"), 1).otherwise(0)).otherwise(F.when(F.struct("mix_block_key", "mix_block") < F.struct("end_key", "end_block"), 1).otherwise(0))
    copies = (F.coalesce("whole", F.lit(1)) + F.coalesce(extra, F.lit(0))).cast("int")
    return rows.select(*(f"{OWN}{k}" for k in range(len(docs.columns))), "mix_tokens", copies.alias("mix_copies"), "mix_weight", "mix_epochs", "mix_exponent", "mix_source", "mix_block", "mix_block_key", "mix_doc_key")


def with_copies(docs: DataFrame, repetition: float | None = 1.5, entropy: float | None = None, budget_tokens: int | None = None) -> DataFrame:
    """docs with mix_tokens, mix_copies, mix_weight, mix_epochs, mix_exponent, mix_block_rank and
    mix_position, in place of columns of these names: where the row's block stands in its source's
    permutation of blocks, and the row in that of documents, both from 1. Epochs 1 to mix_copies
    use the row there. Text null or without words: no tokens, one copy where its source has none.
    Repeated rows of one doc_id go together; a null source is a source, and an empty table stays
    empty. The join with the plan is by source alone: Spark broadcasts the plan if its measured
    size allows it, else splits a skewed source. A source has about as many blocks as a block has
    rows, so that neither grouping meets more than the root of a source in one place.
    """
    rows = _counted(docs, repetition, entropy, budget_tokens)
    sizes = rows.groupBy("mix_source", "mix_block", "mix_block_key").agg(F.count("*").alias("size"))
    order = Window.partitionBy("mix_source").orderBy("mix_block_key", "mix_block")
    starts = sizes.withColumn("mix_block_rank", F.row_number().over(order)).withColumn("mix_before", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = stored(starts.select(F.col("mix_source").alias("s"), F.col("mix_block").alias("b"), "mix_block_rank", "mix_before"), "blocks")
    within = Window.partitionBy("mix_source", "mix_block").orderBy("mix_doc_key")
    placed = rows.withColumn("mix_nth", F.row_number().over(within)).join(starts, F.col("mix_source").eqNullSafe(F.col("s")) & F.col("mix_block").eqNullSafe(F.col("b")), "left")
    added = ["mix_tokens", "mix_copies", "mix_weight", "mix_epochs", "mix_exponent", "mix_block_rank", "mix_position"]
    placed = placed.withColumn("mix_position", F.col("mix_before") + F.col("mix_nth"))
    return placed.select(*(F.col(f"{OWN}{k}").alias(c) for k, c in enumerate(docs.columns) if c not in added), *added)


def mix(docs: DataFrame, repetition: float | None = 1.5, entropy: float | None = None, budget_tokens: int | None = None) -> DataFrame:
    """The mixed corpus: docs' own columns, each row as often as it is used; see with_copies for
    the rules, and sequence for the order."""
    rows = _counted(docs, repetition, entropy, budget_tokens).filter("mix_copies > 0")
    own = [F.col(f"{OWN}{k}").alias(c) for k, c in enumerate(docs.columns)]
    return rows.withColumn("mix_epoch", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select(*own)


def sequence(docs: DataFrame, repetition: float | None = 1.5, entropy: float | None = None, budget_tokens: int | None = None) -> DataFrame:
    """The mixed corpus in the order of its permutation: docs' own columns, mix_epoch and
    mix_place, sorted by both. mix_place (0 to 1) is the row's position as a share of its source,
    by which the sources of an epoch are interleaved evenly."""
    rows = with_copies(docs, repetition, entropy, budget_tokens).filter("mix_copies > 0")
    per = docs.groupBy(F.col("source").cast("string").alias("s")).agg(F.count("*").alias("n"))
    rows = rows.join(per, F.col("source").cast("string").eqNullSafe(F.col("s")), "left").withColumn("mix_epoch", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    return rows.withColumn("mix_place", (F.col("mix_position") - 0.5) / F.col("n")).select(*docs.columns, "mix_epoch", "mix_place").orderBy("mix_epoch", "mix_place", "source", "doc_id")
