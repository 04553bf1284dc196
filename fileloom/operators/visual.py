"""Search of frames by vector and by tags."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import unit
from .storage import stored

#: Query vectors in one block, and bytes of vectors that a task multiplies with each of them.
QUERY_ROWS = 2048
HELD_BYTES = 32 << 20


def similar(vectors: DataFrame, query: DataFrame, k: int = 10, least: float = 0.3) -> DataFrame:
    """For each query(query_id, v) the k nearest of vectors(vec_id, v) by cosine, from least up.

    Queries are stored as blocks of about QUERY_ROWS, one row group of a file each. A task holds
    vectors up to HELD_BYTES, takes one block after another from the shared folder, and passes on at
    most k rows for each query. The plan is the same for any number of queries, and neither queries
    nor vectors pass the driver. Vectors of another width than a query's aren't compared with it."""
    asked = query.select(F.col("query_id").cast("long"), unit("v").alias("q")).filter("query_id is not null and q is not null")
    n = stored(asked, "asked")
    blocks = max(1, -(-n.count() // QUERY_ROWS))
    dealt = stored(n.repartition(blocks, F.xxhash64("query_id", "q")), "queries")
    files, own = dealt.inputFiles(), vectors.select(F.col("vec_id").cast("long"), unit("v").alias("u")).filter("u is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u in _held(batches):
            for path in files:
                system, at = fs.FileSystem.from_uri(path)
                with system.open_input_file(at) as f:
                    for q in pq.ParquetFile(f).iter_batches(QUERY_ROWS, columns=["query_id", "q"]):
                        yield from _nearest(u, q, k, least)

    found = own.mapInArrow(run, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= HELD_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def _by_width(ids: pa.ChunkedArray | pa.Array, vectors: pa.ChunkedArray | pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the vectors of each width."""
    widths, ids, out = pc.list_value_length(vectors).to_numpy(zero_copy_only=False) if isinstance(vectors, pa.Array) else pc.list_value_length(vectors).to_numpy(), np.asarray(ids), {}
    for w in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == w)
        values = pc.list_flatten(vectors.take(pa.array(rows)))
        out[w] = (ids[rows], np.asarray(values, dtype=np.float64).reshape(len(rows), w))
    return out


def _nearest(u: pa.Table, q: pa.RecordBatch, k: int, least: float) -> Iterator[pa.RecordBatch]:
    vectors = _by_width(u.column("vec_id"), u.column("u"))
    for w, (ids, asked) in _by_width(q.column("query_id"), q.column("q")).items():
        vec, own = vectors.get(w, (np.zeros(0, np.int64), None))
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(vec), 1024):
            score = np.round(own[at : at + 1024] @ asked.T, 6)
            r, c = np.nonzero(score >= least)
            best.append((c, score[r, c], vec[at + r]))
        if not best:
            continue
        c, x, v = (np.concatenate(p) for p in zip(*best, strict=True))
        order = np.lexsort((v, -x, c))
        c, x, v = c[order], x[order], v[order]
        first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.zeros(0, int)
        top = np.arange(len(c)) - np.repeat(first, np.diff(np.append(first, len(c)))) < k
        yield pa.RecordBatch.from_arrays([pa.array(ids[c[top]]), pa.array(v[top]), pa.array(x[top])], ["query_id", "vec_id", "score"])


def tag_score(tags: Column, query: dict) -> Column:
    """Mean over the query's criteria of the share of its words found in the frame's tags, as parts
    of a name or attribute; content_type counts whole."""

    def share(values: Column, words: list[str]) -> Column:
        low = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.lower(x))
        hits = F.lit(0)
        for w in words:
            hits = hits + F.when(F.exists(low, _holds(w.lower())), 1).otherwise(0)
        return hits / len(words)

    parts = []
    if query.get("objects"):
        objects = F.coalesce(tags["objects"], F.array().cast("array<struct<name:string,attributes:array<string>>>"))
        parts.append(share(F.concat(F.transform(objects, lambda o: o["name"]), F.flatten(F.transform(objects, lambda o: F.coalesce(o["attributes"], F.array().cast("array<string>"))))), query["objects"]))
    for name in ("materials", "scene_tags", "colors"):
        if query.get(name):
            parts.append(share(tags[name], query[name]))
    if query.get("content_type"):
        parts.append(F.when(F.lower(F.coalesce(tags["content_type"], F.lit(""))).contains(query["content_type"].lower()), 1.0).otherwise(0.0))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total / len(parts)


def _holds(word: str):
    return lambda x: x.contains(word)


def search_tags(frames: DataFrame, query: dict, least: float = 0.5, limit: int = 50) -> DataFrame:
    """frames(frame_id, tags) by score, best first."""
    scored = frames.withColumn("score", F.round(tag_score(F.col("tags"), query), 6))
    return scored.filter(F.col("score") >= least).orderBy(F.desc("score"), "frame_id").limit(limit)


def search_both(frames: DataFrame, vectors: DataFrame, query: DataFrame, tags: dict, k: int = 10) -> DataFrame:
    """The best k frames by vector, of the best 2k, whose tags fit a little."""
    near = similar(vectors, query, 2 * k, 0.2).select(F.col("vec_id").alias("frame_id"), F.col("score").alias("vector_score"))
    fit = frames.join(near, "frame_id").withColumn("tag_score", tag_score(F.col("tags"), tags)).filter("tag_score >= 0.3")
    return fit.orderBy(F.desc("vector_score"), "frame_id").limit(k)
