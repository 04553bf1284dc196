"""URL filters: listed rules of host and path, and for all other URLs association rules that
FP-growth mines from labelled pages.

A URL becomes a set of tokens: its scheme, the ends of its host from two labels up, the host's first
label and its words, its folders, the words of its path, the ending of its last name, its query's keys and pairs,
and its fragment. FP-growth finds the token sets that many labelled URLs share, each set in the task of
its rarest token; a set whose pages are mostly bad becomes a rule for blocking. Rules are matched by an
inverted index: each is posted under the rarest of its tokens, and what a URL's tokens find there is
tested for the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .shared import released, stored

#: Parameters of the fit. A labelled URL takes part with all of its tokens; a set needs SUPPORT of the
#: labelled pages and LEAST of them, bad ones; a rule needs CONFIDENCE. Of the rules, the first MOST_RULES,
#: the most confident, go to all tasks; further ones are joined with what these leave.
SUPPORT = 0.002
LEAST = 20
CONFIDENCE = 0.5
MOST_RULES = 20_000
#: Up to so many frequent tokens, of at most LONG_TOKEN characters, are broadcast.
BROADCAST_TOKENS = 100_000
#: Tokens of more characters stand as their SHA-256, which bounds the size of a rule.
LONG_TOKEN = 80
BAD, GOOD = "bad", "good"


class Rule(NamedTuple):
    tokens: tuple[str, ...]
    bad: int
    support: int

    @property
    def confidence(self) -> float:
        return self.bad / self.support


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: what follows the first :// up to a slash, ? or #, with A-Z in lower case, and
    from there up to ? or #. Both are empty for null and for URLs without ://."""
    known = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(known, r"(?s)\A.*?://([^/?#]*)", 1)
    path = F.regexp_extract(known, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def url_tokens(url: Column) -> Column:
    """The distinct tokens of a URL; none for null and for URLs without ://."""
    host, path = split_url(url)
    lower = F.lower(url)
    rest = F.regexp_extract(lower, r"(?s)\A.*?://[^?#]*(.*)\z", 1)
    labels = F.split(host, r"\.")
    ends = F.transform(F.sequence(F.lit(2), F.greatest(F.size(labels), F.lit(2))), lambda n: F.concat(F.lit("host:"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")))
    low = F.lower(path)
    named = lambda kind, values: F.transform(values, lambda v: F.concat(F.lit(f"{kind}:"), v))
    query = F.filter(F.split(F.regexp_extract(rest, r"(?s)\A\?([^#]*)", 1), "&"), lambda v: v != "")
    tokens = F.concat(
        F.array(F.concat(F.lit("scheme:"), F.substring_index(lower, "://", 1)), F.concat(F.lit("label:"), F.get(labels, F.lit(0)))),
        ends,
        named("name", F.regexp_extract_all(host, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))),
        named("folder", F.regexp_extract_all(low, F.lit(r"/([^/]+)(?=/)"), F.lit(1))),
        named("word", F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))),
        named("ending", F.regexp_extract_all(low, F.lit(r"\.([^./]+)\z"), F.lit(1))),
        named("key", F.transform(query, lambda v: F.substring_index(v, "=", 1))),
        named("pair", query),
        named("fragment", F.regexp_extract_all(rest, F.lit(r"(?s)#(.+)\z"), F.lit(1))),
    )
    bounded = F.transform(tokens, lambda t: F.when(F.length(t) > LONG_TOKEN, F.concat(F.lit("long:"), F.sha2(t, 256))).otherwise(t))
    return F.when(F.contains(url, F.lit("://")), F.array_distinct(bounded)).otherwise(F.array().cast("array<string>"))


def labelled(pages: DataFrame, labels: DataFrame, page_col: str = "page_id") -> DataFrame:
    """tokens and bad of every page of which labels(doc_id, quality, toxic) say something: bad if one
    of them has toxic 1 or quality 0. Equal pages count once; URLs without tokens don't count."""
    said = labels.filter("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").alias("of")).agg(F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)).alias("bad"))
    known = pages.select(F.col(page_col).alias("of"), "url").distinct()
    return known.join(said, "of").select(url_tokens(F.col("url")).alias("tokens"), "bad").filter(F.size("tokens") > 0)


def grown(end: str, rows: list[tuple[tuple[str, ...], int, int]], wanted: int, confidence: float) -> Iterator[tuple[tuple[str, ...], int, int]]:
    """FP-growth below one token: (tokens, bad, support) of the rules with end as their rarest token.
    rows(more frequent tokens, most frequent first; pages; bad ones) are the pages that have end.

    A token of all pages of a set adds nothing to it: what contains both says what the set without it
    says, and isn't grown. Good pages that have all tokens a set can grow by stay in whatever grows
    from it, which bounds its confidence: nothing grows that can't be a rule, or none better than this."""
    stack = [((end,), rows)]
    while stack:
        base, rows = stack.pop()
        n, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
        if bad / n >= confidence:
            yield base, bad, n
        counts: dict[str, list[int]] = {}
        for items, k, b in rows:
            for t in items:
                c = counts.setdefault(t, [0, 0])
                c[0] += k
                c[1] += b
        open_ = {t for t, (k, b) in counts.items() if b >= wanted and k < n}
        stay = sum(k - b for items, k, b in rows if open_.issubset(items))
        if bad / (bad + stay) < confidence or stay == n - bad:
            continue
        below: dict[str, dict[tuple[str, ...], list[int]]] = {}
        for items, k, b in rows:
            live = tuple(t for t in items if t in open_)
            for i, t in enumerate(live):
                c = below.setdefault(t, {}).setdefault(live[:i], [0, 0])
                c[0] += k
                c[1] += b
        stack += [((*base, t), [(x, k, b) for x, (k, b) in sets.items()]) for t, sets in below.items()]


SETS = "end string, tokens array<string>, bad long, support long"


def rule_sets(known: DataFrame, support: float = SUPPORT, least: int = LEAST, confidence: float = CONFIDENCE, most_tokens: int | None = None) -> DataFrame:
    """All rules of known(tokens, bad), as end (their rarest token), tokens, bad, support, and place, by
    which the best come first; of sets that a more general one of equal pages speaks for, not all.
    A caller may bound the tokens of a page, the most frequent first; none is left out otherwise."""
    known = stored(known.withColumn("row", F.monotonically_increasing_id()), "labelled")
    wanted = max(least, int(np.ceil(support * known.count())))
    # tokens of wanted support are at most tokens-a-page / support
    each = known.select("bad", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("count"), F.sum("bad").alias("b"))
    frequent = stored(each.filter(F.col("b") >= wanted).select("token", "count"), "frequent")
    few = frequent.count() <= BROADCAST_TOKENS
    pairs = known.select("row", "bad", F.explode("tokens").alias("token")).join(F.broadcast(frequent) if few else frequent, "token")
    ranked = pairs.groupBy("row", "bad").agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("less"), "token"))).alias("found"))
    items = F.transform("found", lambda f: f.token)
    baskets = ranked.groupBy((items if most_tokens is None else F.slice(items, 1, most_tokens)).alias("items")).agg(F.count("*").alias("n"), F.sum("bad").alias("b"))
    ends = baskets.select(F.posexplode("items").alias("at", "end"), "items", "n", "b")
    ends = ends.groupBy("end", F.slice("items", F.lit(1), F.col("at")).alias("before")).agg(F.sum("n").alias("n"), F.sum("b").alias("b"))

    def grow(t: pa.Table) -> pa.Table:
        rows = [(tuple(x), n, b) for x, n, b in zip(*(t.column(c).to_pylist() for c in ("before", "n", "b")))]
        end = t.column("end")[0].as_py()
        found = list(grown(end, rows, wanted, confidence))
        return pa.table({"end": pa.array([end] * len(found), pa.string()), "tokens": pa.array([sorted(x) for x, _, _ in found], pa.list_(pa.string())), "bad": pa.array([b for _, b, _ in found], pa.int64()), "support": pa.array([n for _, _, n in found], pa.int64())})

    sets = ends.groupBy("end").applyInArrow(grow, SETS)
    place = F.struct((-F.col("bad") / F.col("support")).alias("c"), (-F.col("support")).alias("s"), F.size("tokens").alias("k"), F.col("tokens").alias("t"))
    return stored(sets.withColumn("place", place), "rules")


def foremost(sets: DataFrame, most_rules: int = MOST_RULES) -> tuple[list[Rule], DataFrame | None]:
    """The first of the rules and, if there are any, the others. Of the first, one that contains a
    more general one of no less confidence says nothing new and goes."""
    rows = sets.orderBy("place").limit(most_rules).collect()
    found: list[Rule] = []
    by_token: dict[str, list[int]] = {}
    for r in sorted((Rule(tuple(r.tokens), r.bad, r.support) for r in rows), key=lambda r: (len(r.tokens), r.tokens)):
        general = {i for t in r.tokens for i in by_token.get(t, ())}
        if any(set(found[i].tokens) <= set(r.tokens) and found[i].confidence >= r.confidence for i in general):
            continue
        for t in r.tokens:
            by_token.setdefault(t, []).append(len(found))
        found.append(r)
    others = None
    if sets.count() > len(rows):
        last = rows[-1].place
        others = sets.filter(F.col("place") > F.struct(F.lit(last.c).alias("c"), F.lit(last.s).cast("long").alias("s"), F.lit(last.k).alias("k"), F.array(*map(F.lit, last.t)).alias("t")))
    return sorted(found, key=lambda r: (-r.confidence, -r.support, len(r.tokens), r.tokens)), others


def mined(known: DataFrame, most_rules: int = MOST_RULES, **fit) -> list[Rule]:
    """The first rules of known(tokens, bad), the best first. With nothing labelled there are none."""
    return foremost(rule_sets(known, **fit), most_rules)[0]


def joined(found: DataFrame, others: DataFrame) -> DataFrame:
    """found(tokens, learned, confidence, support, ...) with the best of the other rules where no first
    one fits. Equal token sets are asked once, under each of their tokens."""
    open_ = found.filter("learned is null")
    asked = open_.select("tokens").distinct().withColumn("end", F.explode("tokens"))
    fits = asked.join(others.select("end", "place"), "end").filter(F.size(F.array_except("place.t", "tokens")) == 0)
    best = fits.groupBy("tokens").agg(F.min("place").alias("place"))
    said = {"learned": F.array_join("place.t", " "), "confidence": -F.col("place.c"), "support": -F.col("place.s")}
    return found.filter("learned is not null").unionByName(open_.join(best, "tokens", "left").withColumns(said).select(*found.columns))


class Index:
    """Rules by their rarest token: numbers of tokens, postings as bounds and rules, and the other
    tokens of each rule."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        uses: dict[str, int] = {}
        for r in rules:
            for t in r.tokens:
                uses[t] = max(uses.get(t, 0), r.support)  # the support of a token is that of its own set, or more
        self.names = pa.array(sorted(uses), pa.string())
        number = {t: i for i, t in enumerate(sorted(uses))}
        order = [sorted(r.tokens, key=lambda t: (uses[t], t)) for r in rules]
        keys = np.array([number[o[0]] for o in order], dtype=np.int64)
        self.posted = np.argsort(keys, kind="stable")
        self.bounds = np.searchsorted(keys[self.posted], np.arange(len(number) + 1))
        widest = max(map(len, order), default=1)
        self.others = np.full((len(rules), widest - 1), -1, dtype=np.int64)
        for i, o in enumerate(order):
            self.others[i, : len(o) - 1] = [number[t] for t in o[1:]]

    def first(self, tokens: pa.Array) -> np.ndarray:
        """Of each row of tokens the first rule that it has all tokens of, or -1."""
        best = np.full(len(tokens), len(self.rules), dtype=np.int64)
        if len(self.rules) and len(tokens):
            rows = np.repeat(np.arange(len(tokens)), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
            ids = pc.fill_null(pc.index_in(tokens.flatten(), value_set=self.names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            rows, ids = rows[ids >= 0], ids[ids >= 0]
            have = np.sort(rows * len(self.names) + ids)
            n = self.bounds[ids + 1] - self.bounds[ids]
            row = np.repeat(rows, n)
            rule = self.posted[np.repeat(self.bounds[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            for k in range(self.others.shape[1]):
                other = self.others[rule, k]
                key = row * len(self.names) + other
                at = np.minimum(np.searchsorted(have, key), max(0, len(have) - 1))
                fits = (other < 0) | (have[at] == key) if len(have) else other < 0
                row, rule = row[fits], rule[fits]
            np.minimum.at(best, row, rule)
        return np.where(best == len(self.rules), -1, best)


def listed(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, or null. rules are (verdict, host/path...), a
    list written by hand; of equal length, the first in the alphabet."""
    whole = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        at, _, below = text.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(f"/{below}"))
        whole = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(whole)
    return whole


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], page_col: str = "page_id", most_rules: int = MOST_RULES, **fit) -> DataFrame:
    """Every page's page_id, host, path, rule, verdict, and of mined rules the tokens, confidence and
    support of the best that fits (learned, confidence, support; else null).

    A listed rule decides first. Otherwise a URL is blocked if a mined rule fits it, and allowed if
    none does: so are null, empty URLs and those without ://, whose host and path are empty. Equal
    rows come back as often as they stand; null page_ids are judged like others. Very long URLs are
    read whole; their long tokens stand as hashes. Empty tables give no rows, or no mined rules. Other
    columns of pages are not read, whatever their names. No row is shuffled to be judged by the first
    most_rules rules, which go to all tasks; if there are more, URLs that none of them fits are joined
    with the others.
    """
    first, others = foremost(rule_sets(labelled(pages, labels, page_col), **fit), most_rules)
    index = Index(first)
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col(page_col).alias("page_id"), host.alias("host"), path.alias("path"), url_tokens(F.col("url")).alias("tokens"))
    kind = dict(rows.dtypes)["page_id"]
    kept = ["page_id", "host", "path", *([] if others is None else ["tokens"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = pa.array([" ".join(r.tokens) for r in index.rules], pa.string())
        shares, counts = pa.array([r.confidence for r in index.rules], pa.float64()), pa.array([r.support for r in index.rules], pa.int64())
        for batch in batches:
            best = index.first(batch.column("tokens"))
            at = pa.array(best, pa.int64(), mask=best < 0)
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, texts.take(at), shares.take(at), counts.take(at)], names=[*kept, "learned", "confidence", "support"])

    found = rows.mapInArrow(released(run), f"page_id {kind}, host string, path string, {'' if others is None else 'tokens array<string>, '}learned string, confidence double, support long")
    if others is not None:
        found = joined(stored(found, "judged"), others)
    found = found.withColumn("said", listed(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("said.verdict"), F.when(F.col("learned").isNotNull(), "block").otherwise("allow"))
    return found.select("page_id", "host", "path", F.col("said.rule").alias("rule"), verdict.alias("verdict"), "learned", "confidence", "support")
