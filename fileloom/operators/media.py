"""Transcripts, scenes and text search over media."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .storage import stored


def sentences(items: DataFrame) -> DataFrame:
    """items(file_id, seq, kind, content, start_time, end_time, confidence) to sentences: file_id,
    seg, start_time, end_time, text, confidence (mean of its words). A '.', '!' or '?' item ends
    a sentence; punctuation joins the word before it."""
    w = Window.partitionBy("file_id").orderBy("seq")
    ends = (F.col("kind") == "punctuation") & F.col("content").isin(".", "!", "?")
    marked = items.withColumn("seg", F.coalesce(F.sum(F.when(ends, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    word = F.col("kind") != "punctuation"
    per = marked.groupBy("file_id", "seg").agg(
        F.min(F.when(word, F.col("start_time"))).alias("start_time"),
        F.max(F.when(word, F.col("end_time"))).alias("end_time"),
        F.array_sort(F.collect_list(F.struct("seq", F.when(word, F.concat(F.lit(" "), F.col("content"))).otherwise(F.col("content")).alias("t")))).alias("parts"),
        F.avg(F.when(word, F.col("confidence"))).alias("confidence"),
    )
    return per.select("file_id", "seg", F.coalesce("start_time", F.lit(0.0)).alias("start_time"), F.coalesce("end_time", F.lit(0.0)).alias("end_time"), F.btrim(F.array_join(F.col("parts.t"), "")).alias("text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence")).filter("text != ''")


SPEECH = "results struct<items: array<struct<type: string, start_time: string, end_time: string, alternatives: array<struct<content: string, confidence: string>>>>>"


def spoken_items(answers: DataFrame) -> DataFrame:
    """answers(file_id, json) of a speech service to the items that sentences() takes. An answer
    that is no JSON, or has no items, gives none; an item's first alternative counts."""
    items = answers.select("file_id", F.posexplode(F.from_json("json", SPEECH)["results"]["items"]).alias("seq", "i"))
    first = F.get("i.alternatives", F.lit(0))
    number = lambda c: F.coalesce(F.expr(f"try_cast({c} as double)"), F.lit(0.0))
    return items.withColumn("first", first).select("file_id", "seq", F.col("i.type").alias("kind"), F.col("first.content").alias("content"), number("i.start_time").alias("start_time"), number("i.end_time").alias("end_time"), number("first.confidence").alias("confidence"))


def with_files(segments: DataFrame, files: DataFrame) -> DataFrame:
    """Segments with the path of their file; those of unknown files go."""
    return segments.join(files.select("file_id", "file_path"), "file_id")


def ordered_hits(hits: DataFrame, limit: int) -> DataFrame:
    return hits.orderBy("file_path", "start_time").limit(limit)


def bundle(files: DataFrame, segments: DataFrame, topics: DataFrame, keywords: DataFrame) -> DataFrame:
    """Per file all of its layers as sorted arrays: transcript and topics by time, keywords by
    frequency. One row a file is what is asked for; a file without a layer has an empty one."""

    def layer(rows: DataFrame, name: str, *fields) -> DataFrame:
        return rows.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))

    out = files
    for rows, name, fields in ((segments, "transcript", ["start_time", "end_time", "text"]), (topics, "topics", ["start_time", "topic", "confidence"]), (keywords, "keywords", [(-F.col("frequency")).alias("rank"), "keyword", "start_time"])):
        out = out.join(layer(rows, name, *fields), "file_id", "left")
    return out


#: Seconds of a bin of the interval join.
BIN = 1.0


def with_speakers(segments: DataFrame, speakers: DataFrame, bin_seconds: float = BIN) -> DataFrame:
    """The first speaker interval (by ord) that holds a segment's midpoint; null without one.

    Time is cut into bins. An interval is registered in the bins of its two ends, where times are
    compared, and as the fewest aligned blocks of 1, 2, 4, ... whole bins in between, where they need
    not be: of each block only the first interval is kept. A midpoint looks its bin up, and the one
    block of each size that holds it. So what a segment meets doesn't grow with the intervals of its
    file, and a file is spread by its bins."""
    at = lambda c: F.floor(F.col(c) / bin_seconds)
    mid = segments.select("file_id", "seg", ((F.col("start_time") + F.col("end_time")) / 2).alias("mid")).filter("mid is not null").withColumn("bin", at("mid"))
    s = speakers.select(F.col("file_id"), F.col("start_time").alias("s"), F.col("end_time").alias("e"), F.struct("ord", "speaker").alias("h")).filter("s <= e").withColumns({"first": at("s"), "last": at("e")})
    ends = s.select("file_id", "s", "e", "h", F.explode(F.array_distinct(F.array("first", "last"))).alias("bin"))
    near = mid.join(ends, ["file_id", "bin"]).filter("s <= mid and mid <= e").select("file_id", "seg", "h")
    blocks = F.expr("""filter(flatten(transform(sequence(0, 52), j -> transform(
        array(named_struct('l', -floor(-(first + 1) / power(2, j)), 'r', floor(last / power(2, j)))),
        x -> named_struct('j', j, 'l', x.l, 'r', x.r)))), x -> x.l < x.r and (x.l % 2 <> 0 or x.r % 2 <> 0))""")
    pieces = s.filter("last - first > 1").select("file_id", "h", F.explode(blocks).alias("x"))
    pieces = pieces.select("file_id", "h", F.col("x.j").alias("size"), F.explode(F.array_compact(F.array(F.when(F.col("x.l") % 2 != 0, F.col("x.l")), F.when(F.col("x.r") % 2 != 0, F.col("x.r") - 1)))).alias("block"))
    pieces = stored(pieces.groupBy("file_id", "size", "block").agg(F.min("h").alias("h")), "blocks")
    sizes = [r[0] for r in pieces.select("size").distinct().orderBy("size").collect()]  # 53 at most
    asked = mid.select("file_id", "seg", F.explode(F.array(*(F.struct(F.lit(j).alias("size"), F.floor(F.col("bin") / 2.0**j).alias("block")) for j in sizes))).alias("x")).select("file_id", "seg", "x.size", "x.block") if sizes else None
    hits = near if asked is None else near.unionByName(asked.join(pieces, ["file_id", "size", "block"]).select("file_id", "seg", "h"))
    best = hits.groupBy("file_id", "seg").agg(F.min("h").alias("h"))
    return segments.join(best.select("file_id", "seg", F.col("h.speaker").alias("speaker")), ["file_id", "seg"], "left")


def _chunk_numbers(start: np.ndarray, seconds: float, began: float, chunk: int) -> tuple[np.ndarray, float, int]:
    """Chunks of one file's sorted starts, going on from a chunk: one step for each chunk."""
    out, at = np.empty(len(start), dtype=np.int32), 0
    while at < len(start):
        if not chunk or start[at] - began > seconds:
            began, chunk = start[at], chunk + 1
        to = max(at + 1, int(np.searchsorted(start, began + seconds, side="right")))
        while to < len(start) and start[to] - began <= seconds:  # the sum may have been rounded
            to += 1
        while to > at + 1 and start[to - 1] - began > seconds:
            to -= 1
        out[at:to] = chunk
        at = to
    return out, began, chunk


def chunks(segments: DataFrame, seconds: float = 60.0) -> DataFrame:
    """Segments (file_id, start_time, end_time, text) to chunks that begin anew once a segment
    starts more than so many seconds after the chunk did: file_id, chunk, start_time, end_time,
    text, n_segments. Files' sorted segments stream past one state; no file is held whole. Segments
    without a start stand first, in a chunk of their own."""
    n = max(1, int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = segments.select("file_id", F.col("start_time").cast("double").alias("start_time"), F.col("end_time").cast("double").alias("end_time"), "text")
    schema = rows.withColumn("chunk", F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, began, chunk = object(), 0.0, 0
        for b in batches:
            if not b.num_rows:
                continue
            start = pc.fill_null(b.column("start_time"), -1e300).to_numpy(zero_copy_only=False)
            code = b.column("file_id").dictionary_encode(null_encoding="encode")
            of, names = code.indices.to_numpy(), code.dictionary.to_pylist()
            bounds = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            numbers = []
            for low, high in itertools.pairwise(bounds):
                if names[of[low]] != file:
                    file, began, chunk = names[of[low]], 0.0, 0
                made, began, chunk = _chunk_numbers(start[low:high], seconds, began, chunk)
                numbers.append(made)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(numbers))], [*b.schema.names, "chunk"])

    ordered = rows.repartition(n, "file_id").sortWithinPartitions("file_id", "start_time", "end_time", "text")
    numbered = ordered.mapInArrow(run, schema)
    return numbered.groupBy("file_id", "chunk").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_time", "end_time", "text"))), lambda x: x.text), " ").alias("text"), F.count("*").alias("n_segments"))


def keyword_frequency(keywords: DataFrame) -> DataFrame:
    """keywords(file_id, keyword, start_time, end_time): case-insensitive counts with the first
    spelling and start, and the last end."""
    return keywords.groupBy("file_id", F.lower("keyword").alias("key")).agg(F.min_by("keyword", "start_time").alias("keyword"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.count("*").alias("frequency"))


def like(c: Column | str, query: str) -> Column:
    escaped = query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return (F.col(c) if isinstance(c, str) else c).ilike(f"%{escaped}%")


def search_topics(topics: DataFrame, keywords: DataFrame, files: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Topics by confidence, then keywords by frequency, cut to the limit."""
    t = topics.filter(like("topic", query)).select(F.lit(0).alias("section"), "file_id", "topic", "start_time", F.col("confidence").cast("double").alias("weight"))
    k = keywords.filter(like("keyword", query)).select(F.lit(1).alias("section"), "file_id", F.col("keyword").alias("topic"), "start_time", F.col("frequency").cast("double").alias("weight"))
    return t.unionByName(k).join(files, "file_id").orderBy("section", F.desc("weight"), "file_id", "topic", "start_time").limit(limit)


def search_visual(segments: DataFrame, files: DataFrame, query: str, limit: int = 50) -> DataFrame:
    return segments.filter(like("description", query) | like("ocr_text", query)).join(files, "file_id").orderBy("timestamp", "file_id").limit(limit)


def terms(c: Column | str) -> Column:
    """Lower-case words of letters and digits."""
    return F.regexp_extract_all(F.lower(F.col(c) if isinstance(c, str) else c), F.lit(r"([\p{L}\p{N}]+)"), 1)


def full_text(segments: DataFrame, query: str, limit: int | None = 50, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 over segments(id, text) for all words of the query: id, score, best first. One scan; only
    the query's words are counted, with their statistics in one row."""
    words = list(dict.fromkeys(query.lower().split()))
    rows = segments.select("id", terms("text").alias("t")).select("id", F.size("t").alias("n"), *[_count("t", w).alias(f"c{k}") for k, w in enumerate(words)])
    stats = rows.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"c{k}") > 0).alias(f"d{k}") for k in range(len(words))])
    every = F.lit(True)
    score = F.lit(0.0)
    for k in range(len(words)):
        c, d = F.col(f"c{k}"), F.col(f"d{k}")
        every = every & (c > 0)
        idf = F.greatest(F.log((F.col("docs") - d + 0.5) / (d + 0.5)), F.lit(1e-6))
        score = score + idf * c * (k1 + 1) / (c + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    found = rows.filter(every).crossJoin(F.broadcast(stats)).select("id", F.round(score, 9).alias("score"))
    return found.orderBy(F.desc("score"), "id").limit(limit) if limit is not None else found


def _count(c: str, word: str) -> Column:
    return F.size(F.filter(c, lambda x: x == word))


def split_scenes(scenes: DataFrame, longest: float = 120.0) -> DataFrame:
    """scenes(file_id, start_time, end_time) cut into pieces of the longest length; reindexed."""
    n = F.greatest(F.ceil((F.col("end_time") - F.col("start_time")) / longest).cast("int"), F.lit(1))
    cut = scenes.select("file_id", "start_time", "end_time", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"), (n > 1).alias("forced_split"))
    out = cut.select("file_id", (F.col("start_time") + F.col("k") * longest).alias("start_time"), F.least(F.col("start_time") + (F.col("k") + 1) * longest, F.col("end_time")).alias("end_time"), "forced_split")
    return out.withColumn("scene_index", F.row_number().over(Window.partitionBy("file_id").orderBy("start_time")) - 1)


def keyframes(files: DataFrame, step: float = 30.0, cap: int = 200) -> DataFrame:
    """files(file_id, duration) to the times 0, step, ... below the duration, so many at most."""
    n = F.least(F.ceil(F.col("duration") / step).cast("int"), F.lit(cap))
    return files.filter("duration > 0").select("file_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("frame")).withColumn("timestamp", F.col("frame") * F.lit(step))


def clip_range(start: Column, end: Column, duration: Column, pad: float = 0.5) -> tuple[Column, Column]:
    return F.greatest(start - pad, F.lit(0.0)), F.least(end + pad, duration)


def storyboard_time(start: Column, end: Column) -> Column:
    return start + F.least(F.lit(1.0), 0.1 * (end - start))


def layers(transcripts: DataFrame, topics: DataFrame, visuals: DataFrame) -> DataFrame:
    """Hits of all layers as one typed list, by file and time."""
    parts = [df.withColumn("type", F.lit(t)) for t, df in (("transcript", transcripts), ("topic", topics), ("visual", visuals))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
