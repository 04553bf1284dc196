"""Queries over real files: trees and archives written from documents, walked, crawled and read back."""

from __future__ import annotations

import io
import os
import tarfile
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import catalog, logstore
from ..operators.storage import shared_folder, stored
from ..sources import archives, files as walked_files, listings
from ..streaming import live
from .tables import table


def _folder(spark, kind):
    """A new folder below the shared one, as a path of the system, which all executors reach."""
    shared = shared_folder(spark)
    if not shared.startswith("file://"):
        raise ValueError("these queries write files: spark.checkpoint.dir must be a mounted folder")
    return f"{shared.removeprefix('file://')}/{kind}-{uuid.uuid4().hex}"


def _written(rows):
    """Writes rows(path, data); a null data takes the file away. Runs once, as a stored table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in ((p.as_py(), d.as_py()) for p, d in zip(b.column("path"), b.column("data"), strict=True)):  # one text at a time
                if data is None:
                    os.remove(path)
                    continue
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as f:
                    f.write(data)
            yield b.select(["path"])

    return stored(rows.mapInArrow(run, "path string"), "written")


def _documents(spark, sf, root):
    """Documents as files root/source/k/doc_id.txt or .TXT."""
    d = table(spark, sf, "documents")
    k = F.col("doc_id")
    end = F.when(k % 3 == 0, F.lit(".TXT")).when(k % 3 == 1, F.lit(".txt")).otherwise(".md")
    path = F.concat(F.lit(f"{root}/"), F.coalesce("source", F.lit("none")), F.lit("/"), (k % 6).cast("string"), F.lit("/"), k.cast("string"), end)
    return d.select("doc_id", path.alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))


def _below(path, root):
    return F.substring(path, F.lit(len(root) + 2), F.length(path))


def q_walked_files(spark, sf):
    """Files of an ending and size below folders of one beginning: the walk lists no others."""
    root = _folder(spark, "tree")
    _written(_documents(spark, sf, root).select("path", "data"))
    found = walked_files.wanted_files(walked_files.walk(spark, [root]), 500, 5000, ["txt"]).filter(F.col("path").startswith(f"{root}/src1"))
    return found.select(_below(F.col("path"), root).alias("rel"), "source", "size", "ext").withColumn("source", F.lit("tree"))


def q_crawled_tree(spark, sf):
    """Every folder and file of a tree, from crawls of few folders a task and round."""
    root = _folder(spark, "tree")
    _written(_documents(spark, sf, root).select("path", "data"))
    return walked_files.crawl(spark, [root], folders_per_task=3).select(_below(F.col("path"), root).alias("rel"), "is_dir", "size", "ext", "scan_gen")


def q_catalog_crawl(spark, sf):
    """A catalog after two crawls, between which files were changed, taken away and added."""
    root = _folder(spark, "tree")
    rows = _documents(spark, sf, root)
    store = logstore.Store(spark, f"file://{root}-catalog")
    _written(rows.select("path", "data"))
    catalog.recrawled(store, walked_files.crawl(spark, [root], 1))
    k = F.col("doc_id")
    changed = rows.filter("doc_id % 5 = 0 and doc_id % 7 != 0").select("path", F.concat("data", F.lit(b"!")).alias("data"))
    gone = rows.filter("doc_id % 7 = 0").select("path", F.lit(None).cast("binary").alias("data"))
    added = rows.filter("doc_id % 11 = 0").select(F.concat("path", F.lit(".new")).alias("path"), k.cast("string").cast("binary").alias("data"))
    _written(changed.unionByName(gone).unionByName(added))
    catalog.recrawled(store, walked_files.crawl(spark, [root], catalog.next_generation(store.read(), root)))
    return store.read().select(_below(F.col("path"), root).alias("rel"), "is_dir", F.when(F.col("is_dir") == 0, F.col("size")).otherwise(0).alias("size"), "scan_gen")


def q_hashed_stream(spark, sf):
    """Hashes of a tree's files from a stream of two crawls, between which some were changed."""
    root = _folder(spark, "tree")
    rows = _documents(spark, sf, root)
    index, schema = logstore.Store(spark, f"file://{root}-index"), "path string, size long, mtime double"
    changed = rows.filter("doc_id % 9 = 0").select("path", F.concat("data", F.lit(b"!")).alias("data"))
    for some in (rows.select("path", "data"), changed):
        _written(some)
        live.enqueue(walked_files.wanted_files(walked_files.crawl(spark, [root])).select("path", "size", "mtime").repartition(4), f"{root}-queue")
        live.index_new(live.arriving(spark, f"{root}-queue", schema), index, f"{root}-state", lambda batch: walked_files.hashed(batch).select("path", "size", "md5")).awaitTermination()
    return index.read().select(_below(F.col("path"), root).alias("rel"), "size", "md5")


_ENDS = [".txt", ".PDF", ".png", ".mp4", ".bin", ".svg", ".md"]


def q_read_files(spark, sf):
    """Documents as files of several endings, read as far as an analysis takes them."""
    root = _folder(spark, "read")
    d = table(spark, sf, "documents")
    k = F.col("doc_id")
    end = F.element_at(F.array(*map(F.lit, _ENDS)), (k % len(_ENDS) + 1).cast("int"))
    _written(d.select(F.concat(F.lit(f"{root}/f"), k.cast("string"), end).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("data")))
    found = walked_files.read_for_analysis(walked_files.walk(spark, [root]).filter("is_dir = 0"))
    return found.select(_below(F.col("path"), root).alias("rel"), "size", "type", "mime", F.md5(F.col("content").cast("binary")).alias("content_md5"), "error")


_IN_ARCHIVE = 40


def q_csv_listing(spark, sf):
    """Texts with their line ends and quotes, written as CSV and read by ranges."""
    at = f"{shared_folder(spark)}/listing-{uuid.uuid4().hex}"
    d = table(spark, sf, "documents").select("doc_id", "source", "text")
    d.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(at)
    read = listings.csv_listing(spark, at, ["doc_id", "text", "source", "owner"], expect_rows=True, range_bytes=1 << 16)
    return read.select(F.col("doc_id").cast("long").alias("doc_id"), F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("md5"), "source", "owner")


def q_archive_members(spark, sf):
    """Texts in zip, tar and compressed tar archives of forty, some cut, written and read back."""
    root = _folder(spark, "archives")
    d = table(spark, sf, "documents")
    k, group = F.col("doc_id"), F.floor(F.col("doc_id") / _IN_ARCHIVE)
    name = F.concat(F.lit("a"), group.cast("string"), F.element_at(F.array(*map(F.lit, (".zip", ".tgz", ".tar", ".ZIP", ".tar.bz2"))), (group % 5 + 1).cast("int")))
    member = F.concat(F.when(k % 17 == 0, F.lit("../")).when(k % 19 == 0, F.lit("__MACOSX/")).when(k % 23 == 0, F.lit("Mail/x.MBOX/")).otherwise(""), F.coalesce("lang", F.lit("none")), F.lit("/"), k.cast("string"))
    rows = d.select(F.concat(F.lit(f"{root}/"), name).alias("path"), member.alias("member"), F.coalesce("text", F.lit("")).cast("binary").alias("data"), (group % 10 == 3).alias("cut"))

    def pack(b: pd.DataFrame) -> pd.DataFrame:
        path, out = b.path.iloc[0], io.BytesIO()
        b = b.sort_values("member")
        if path.lower().endswith(".zip"):
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for m, data in zip(b.member, b.data, strict=True):
                    z.writestr(m, data)
        else:
            with tarfile.open(fileobj=out, mode="w:gz" if path.endswith("gz") else "w:bz2" if path.endswith("bz2") else "w") as t:
                for m, data in zip(b.member, b.data, strict=True):
                    t.addfile(_tarred(m, data), io.BytesIO(data))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(out.getvalue()[: len(out.getvalue()) // 2 if b.cut.iloc[0] else None])
        return pd.DataFrame({"path": [path]})

    found = stored(rows.groupBy("path").applyInPandas(pack, "path string"), "packed")
    read = archives.read_members(found, f"{root}/out", task_bytes=1 << 20)
    return read.select(_below(F.col("archive"), root).alias("archive"), "member", "bytes", "md5", "skip", "error")


def _tarred(member, data):
    info = tarfile.TarInfo(member)
    info.size = len(data)
    return info


_PATHS = "coalesce(source, 'none') || '/' || (doc_id % 6) || '/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.TXT' WHEN 1 THEN '.txt' ELSE '.md' END"
_TREE = f"d AS (SELECT doc_id, coalesce(source, 'none') AS s, doc_id % 6 AS k, {_PATHS} AS rel, strlen(coalesce(text, '')) AS size FROM documents)"

QUERIES = {
    "src01_crawled_tree": q_crawled_tree,
    "src02_walked_files": q_walked_files,
    "src04_catalog_crawl": q_catalog_crawl,
    "src09_csv_listing": q_csv_listing,
    "src19_read_files": q_read_files,
    "src14_archive_members": q_archive_members,
    "st06_hashed_stream": q_hashed_stream,
}

SQL = {
    "src01_crawled_tree": f"""
WITH {_TREE}
SELECT rel, 0 AS is_dir, CAST(size AS BIGINT) AS size, CASE WHEN doc_id % 3 = 2 THEN 'md' ELSE 'txt' END AS ext, 1 AS scan_gen FROM d
UNION ALL SELECT DISTINCT s || '/' || k, 1, 0, '', 1 FROM d UNION ALL SELECT DISTINCT s, 1, 0, '', 1 FROM d UNION ALL SELECT '', 1, 0, '', 1
""",
    "src02_walked_files": f"""
WITH {_TREE}
SELECT rel, 'tree' AS source, CAST(size AS BIGINT) AS size, 'txt' AS ext FROM d WHERE doc_id % 3 < 2 AND size BETWEEN 500 AND 5000 AND starts_with(rel, 'src1')
""",
    "src04_catalog_crawl": f"""
WITH {_TREE}
SELECT rel, 0 AS is_dir, CAST(size + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS size, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS scan_gen FROM d WHERE doc_id % 7 <> 0
UNION ALL SELECT rel || '.new', 0, length(CAST(doc_id AS VARCHAR)), 2 FROM d WHERE doc_id % 11 = 0
UNION ALL SELECT s || '/' || k, 1, 0, CASE WHEN bool_or(doc_id % 7 = 0 OR doc_id % 11 = 0) THEN 2 ELSE 1 END FROM d GROUP BY s, k
UNION ALL SELECT DISTINCT s, 1, 0, 1 FROM d UNION ALL SELECT '', 1, 0, 1
""",
    "src19_read_files": f"""
WITH d AS (SELECT doc_id, doc_id % {len(_ENDS)} AS e, coalesce(text, '') AS t FROM documents)
SELECT 'f' || doc_id || {_ENDS}[e + 1] AS rel, CAST(strlen(t) AS BIGINT) AS size, ['text', 'document', 'image', 'video', 'binary', 'image', 'text'][e + 1] AS type,
       ['text/plain', 'application/pdf', 'image/png', 'video/mp4', 'application/octet-stream', 'image/png', 'text/markdown'][e + 1] AS mime,
       CASE WHEN e IN (0, 6) THEN md5(substr(t, 1, 100000)) WHEN e <> 4 THEN md5(base64(encode(t))) END AS content_md5, CAST(NULL AS VARCHAR) AS error FROM d
""",
    "src09_csv_listing": "SELECT doc_id, length(text) AS chars, md5(text) AS md5, source, CAST(NULL AS VARCHAR) AS owner FROM documents",
    "st06_hashed_stream": f"SELECT {_PATHS} AS rel, CAST(strlen(t) AS BIGINT) AS size, md5(t) AS md5 FROM (SELECT *, coalesce(text, '') || CASE WHEN doc_id % 9 = 0 THEN '!' ELSE '' END AS t FROM documents)",
    "src14_archive_members": f"""
WITH d AS (
    SELECT doc_id, doc_id // {_IN_ARCHIVE} AS g, coalesce(text, '') AS text, coalesce(lang, 'none') AS lang FROM documents
), m AS (
    SELECT *, 'a' || g || ['.zip', '.tgz', '.tar', '.ZIP', '.tar.bz2'][g % 5 + 1] AS archive,
           CASE WHEN doc_id % 17 = 0 THEN 'outside' WHEN doc_id % 19 = 0 THEN 'system' WHEN doc_id % 23 = 0 THEN 'mail' END AS skip FROM d
)
SELECT archive, CASE skip WHEN 'outside' THEN '../' WHEN 'system' THEN '__MACOSX/' WHEN 'mail' THEN 'Mail/x.MBOX/' ELSE '' END || lang || '/' || doc_id AS member,
       CASE WHEN skip IS NULL THEN strlen(text) END AS bytes, CASE WHEN skip IS NULL THEN md5(text) END AS md5, skip, CAST(NULL AS VARCHAR) AS error
FROM m WHERE g % 10 <> 3
UNION ALL SELECT DISTINCT archive, NULL, CAST(NULL AS BIGINT), NULL, NULL, 'NotAZip' FROM m WHERE g % 10 = 3
""",
}
