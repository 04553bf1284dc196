"""Quality rules: text statistics and a learned decision list, in DataFrame expressions only.

The list is learned by sequential covering: a rule grows by the threshold condition with the best
FOIL gain on two thirds of the labelled documents, is pruned on the last third, and the documents
it covers are taken out before the next rule grows. Every growth step is one aggregation of all
labelled rows to a histogram of (feature, bin); no row leaves the cluster.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .shared import stored

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
FEATURES = ("symbols_per_word", "word_length", "repeat_share", "dup_lines_per_word", "distinct_share", "words")


def text_statistics(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and
    n_distinct_words, of whole texts (null: none of anything).

    Repeated rows each have their row; very long texts are taken whole. Words are compared by
    64-bit hashes. A text whose windows all differ, the usual case, is done
    after one distinct; only the others sort their windows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.filter(F.split(text, SPACE), lambda w: w != "").alias("w"),
        lines.alias("lines"),
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
    )
    second = first.select(
        "doc_id",
        "n_symbols",
        F.size("w").alias("n"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    window = F.when(F.col("n") >= WINDOW, F.transform(F.sequence(F.lit(0), F.col("n") - WINDOW), lambda i: F.xxhash64(*(F.get("h", i + k) for k in range(WINDOW)))))
    third = second.select("*", F.size(F.array_distinct("h")).cast("long").alias("n_distinct_words"), F.coalesce(window, F.array().cast("array<bigint>")).alias("v")).drop("h")
    some = F.size("v") > F.size(F.array_distinct("v"))
    fourth = third.select("*", F.when(some, F.array_sort(F.transform("v", lambda x, i: F.struct(x.alias("v"), i.alias("i"))))).alias("s")).drop("v")
    again = F.transform("s", lambda x, k: F.when((x.v == F.get("s", k - 1).v) | (x.v == F.get("s", k + 1).v), x.i))
    fifth = fourth.select("*", F.array_sort(F.filter(again, lambda x: x.isNotNull())).alias("p")).drop("s")
    covered = F.aggregate(F.transform("p", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("p", k + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return fifth.select("doc_id", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_distinct_words")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def features(stats: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return stats.withColumns(
        {
            "symbols_per_word": F.col("n_symbols") / n,
            "word_length": F.col("word_chars") / n,
            "repeat_share": F.col("n_repeat_words") / n,
            "dup_lines_per_word": F.col("n_dup_lines") / n,
            "distinct_share": F.col("n_distinct_words") / n,
            "words": F.col("n_words").cast("double"),
        }
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > self.threshold if self.above else c <= self.threshold


Rule = tuple[Condition, ...]


def matches(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def any_of(rules: list[Rule]) -> Column:
    out = F.lit(False)
    for r in rules:
        out = out | matches(r)
    return out


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional: the number of the first rule that matches, 0 where none does."""
    out = None
    for k, r in enumerate(rules, 1):
        out = F.when(matches(r), F.lit(k)) if out is None else out.when(matches(r), F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def thresholds(labelled: DataFrame, bins: int) -> dict[str, list[float]]:
    """Per feature its cuts: quantiles of its distinct values, so that a value that most rows share
    takes one of them."""
    values = labelled.select(F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in FEATURES))).alias("e")).select("e.f", "e.v").distinct()
    found = values.groupBy("f").agg(F.percentile_approx("v", [k / bins for k in range(bins)], 10_000).alias("t")).collect()
    return {f: sorted(set(t)) for f, t in ((r.f, r.t or []) for r in found)}


def learn(labelled: DataFrame, max_rules: int = 12, max_conditions: int = 4, bins: int = 32, precision: float = 0.8) -> list[Rule]:
    """Rules for bad = 1 from rows with FEATURES, bad (0 or 1) and part (0 and 1 grow, 2 prunes).

    A rule is taken while, on the pruning rows it newly covers, at least the given share is bad;
    learning stops at the first that fails, or when no bad row is left.
    """
    cuts = {f: [] for f in FEATURES} | thresholds(labelled, bins)
    if not any(cuts.values()):
        return []

    def bin_of(f: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, cuts[f])), lambda t: F.col(f) > t))

    def histogram(rows: DataFrame) -> dict[str, list[tuple[int, int]]]:
        entries = [F.struct(F.lit(f).alias("f"), bin_of(f).alias("b")) for f in FEATURES]
        found = {f: [(0, 0)] * (len(cuts[f]) + 1) for f in FEATURES}
        for r in rows.select("bad", F.explode(F.array(*entries)).alias("e")).groupBy("e.f", "e.b").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect():
            found[r.f][r.b] = (r.p, r.n)
        return found

    def best(rows: DataFrame, least: float) -> tuple[Condition, int, int] | None:
        top = None
        for f, h in histogram(rows).items():
            P, N = sum(p for p, _ in h), sum(n for _, n in h)
            if not P:
                return None
            p = n = 0
            for k, t in enumerate(cuts[f]):
                p, n = p + h[k][0], n + h[k][1]
                for above, a, b in ((False, p, n), (True, P - p, N - n)):
                    if a and (gain := a * (math.log2(a / (a + b)) - math.log2(P / (P + N)))) > least and (top is None or gain > top[0]):
                        top = (gain, Condition(f, above, t), a, b)
        return top and top[1:]

    rules: list[Rule] = []
    while len(rules) < max_rules:
        left = labelled.filter(~any_of(rules))
        grow, rule = left.filter("part < 2"), ()
        while len(rule) < max_conditions and (found := best(grow.filter(matches(rule)), 1e-9)):
            rule += (found[0],)
            if not found[2]:
                break
        if not rule:
            break
        shorter = [rule[:k] for k in range(1, len(rule) + 1)]
        sums = [F.sum(F.when(matches(r), c).otherwise(0)).alias(f"{x}{k}") for k, r in enumerate(shorter) for x, c in (("p", F.col("bad")), ("n", 1 - F.col("bad")))]
        got = left.filter("part = 2").agg(*sums).first()
        score = [((got[f"p{k}"] or 0) - (got[f"n{k}"] or 0)) / max(1, (got[f"p{k}"] or 0) + (got[f"n{k}"] or 0)) for k in range(len(shorter))]
        k = max(range(len(shorter)), key=lambda k: (score[k], -k))
        p, n = got[f"p{k}"] or 0, got[f"n{k}"] or 0
        if p < 1 or p < precision * (p + n):
            break
        rules.append(shorter[k])
    return rules


def quality_filter(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[Rule]]:
    """Every document with its statistics, base_failed, rule (number of the rule that rejects it,
    else 0) and kept; and the rules. Labels(doc_id, quality): 0 is bad; of several labels of a
    document their majority counts, and null labels count nothing. Without labels, kept is the
    base's verdict alone."""
    stats = stored(features(text_statistics(docs)), "statistics")
    marks = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.when(F.avg("quality") < 0.5, 1).otherwise(0).alias("bad"))
    labelled = stored(stats.filter(~base_failed()).join(marks, "doc_id").select("bad", (F.crc32(F.col("doc_id").cast("string")) % 3).alias("part"), *FEATURES), "labelled")
    rules = learn(labelled)
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)), rules
