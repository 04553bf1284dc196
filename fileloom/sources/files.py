"""File trees as tables: walks of local folders, and hashing of files.

`walk` is a Spark data source with one partition per folder below a root, which takes over filters.
`crawl` lists trees of any shape in stored rounds. Only metadata is read; hashing is a later step over
the rows that need it.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import os
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

from ..functions import fixed
from ..functions.predicates import mime_type
from ..operators.storage import stored

WALKED = "path string, root string, source string, parent string, name string, is_dir int, size long, mtime double, ctime double, ext string"
#: From this size on a file is known by three samples of SAMPLE bytes.
SAMPLED_SIZE = 52_428_800
SAMPLE = 262_144
CHUNK = 1 << 20
#: Files and folders after which a task of a crawl hands on the folders that it has not come to.
ENTRIES_PER_TASK = 20_000
#: Characters of content that are handed on together; one file's content always is.
READ_TOGETHER = 4 << 20
ARCHIVES = r"(?i)\.(zip|tar|tgz|tar\.gz|gz|rar|7z|tar\.bz2)$"


def frames(rows: Iterator[tuple], schema: str) -> Iterator[pd.DataFrame]:
    """Rows as frames of bounded length."""
    kinds = {"string": "object", "long": "Int64", "int": "Int32", "double": "Float64", "boolean": "boolean"}
    columns = [c.split() for c in schema.split(", ")]
    held: list[tuple] = []

    def frame() -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series([r[i] for r in held], dtype=kinds[t]) for i, (c, t) in enumerate(columns)})

    for row in rows:
        held.append(row)
        if len(held) == 4096:
            yield frame()
            held = []
    if held:
        yield frame()


class _Folder(InputPartition):
    def __init__(self, root: str, top: str, deep: bool):
        self.root, self.top, self.deep = root, top, deep


def extension_of(name: str) -> str:
    """Lower-case extension; empty without one, and for names that only begin with a dot."""
    stem, dot, end = name.rpartition(".")
    return end.lower() if stem and dot else ""


def _row(root: str, path: str, is_dir: bool) -> tuple | None:
    try:
        s = os.stat(path)
    except OSError:
        return None
    name = os.path.basename(path.rstrip("/"))
    return (path, root, os.path.basename(root.rstrip("/")) or root, os.path.dirname(path), name, int(is_dir), 0 if is_dir else s.st_size, s.st_mtime, s.st_ctime, "" if is_dir else extension_of(name))


#: Known of a folder's entry before it is looked at more closely.
_BEFORE = ("path", "root", "source", "parent", "name", "is_dir", "ext")
_TESTS = {
    EqualTo: lambda x, v: x == v,
    EqualNullSafe: lambda x, v: x == v,
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
    In: lambda x, v: x in v,
    StringStartsWith: lambda x, v: x.startswith(v),
    StringEndsWith: lambda x, v: x.endswith(v),
    StringContains: lambda x, v: v in x,
}


def may_hold(f: Filter, folder: str) -> bool:
    """Whether something below the folder can pass a filter on path or parent."""
    inside, column = folder.rstrip("/") + "/", f.attribute[0]
    goals = [f.value] if isinstance(f, (EqualTo, EqualNullSafe)) else f.value if isinstance(f, In) else None
    if column == "path" and goals is not None:
        return any(isinstance(g, str) and g.startswith(inside) for g in goals)
    if column == "parent" and goals is not None:
        return any(isinstance(g, str) and (g + "/").startswith(inside) for g in goals)
    if column in ("path", "parent") and isinstance(f, StringStartsWith):
        return inside.startswith(f.value) or f.value.startswith(inside) or (column == "parent" and folder.startswith(f.value))
    return True


class _Walk(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = [r.rstrip("/") or "/" for r in options["paths"].split("\n") if r]
        self.hidden = options.get("include_hidden", "false") == "true"
        self.recursive = options.get("recursive", "true") == "true"
        self.skip = tuple(p for p in options.get("skip_prefixes", "").split("\n") if p)
        self.columns = [c.split()[0] for c in WALKED.split(", ")]
        self.early: list[tuple[int, Filter]] = []
        self.late: list[tuple[int, Filter]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        """Takes what compares one column with values, and not null, which holds everywhere. What needs
        no look at the file is tested before it; folders that can hold nothing aren't listed."""
        for f in filters:
            known = getattr(f, "attribute", ("",))[0] in self.columns
            if known and isinstance(f, IsNotNull):
                continue
            if known and type(f) in _TESTS and f.value is not None:
                (self.early if f.attribute[0] in _BEFORE else self.late).append((self.columns.index(f.attribute[0]), f))
            else:
                yield f

    def _listed(self, name: str, is_dir: bool) -> bool:
        return (self.hidden or not name.startswith(".")) and not (is_dir and self.skip and name.startswith(self.skip))

    def _descends(self, folder: str) -> bool:
        return all(may_hold(f, folder) for _, f in self.early)

    def _roots(self) -> list[str]:
        return [r for r in self.roots if self._descends(r) and all(_TESTS[type(f)](r, f.value) for _, f in self.early if f.attribute[0] == "root")]

    def partitions(self) -> list[_Folder]:
        out = []
        for root in self._roots():
            out.append(_Folder(root, root, False))
            if self.recursive and os.path.isdir(root):
                out += [_Folder(root, e.path, True) for e in os.scandir(root) if e.is_dir(follow_symlinks=False) and self._listed(e.name, True) and self._descends(e.path)]
        return out

    def read(self, partition: _Folder) -> Iterator[tuple]:
        source = os.path.basename(partition.root.rstrip("/")) or partition.root
        stack = [partition.top]
        while stack:
            folder = stack.pop()
            for name, path, is_dir in _entries(folder):
                if not self._listed(name, is_dir):
                    continue
                if is_dir and partition.deep and self._descends(path):
                    stack.append(path)
                before = (path, partition.root, source, folder, name, int(is_dir), None, None, None, "" if is_dir else extension_of(name))
                if all(_TESTS[type(f)](before[i], f.value) for i, f in self.early) and (row := _row(partition.root, path, is_dir)) and all(_TESTS[type(f)](row[i], f.value) for i, f in self.late):
                    yield row


def _entries(folder: str) -> list[tuple[str, str, bool]]:
    """(name, path, is_dir) of what a folder holds, by name. One that can't be listed holds nothing."""
    try:
        return sorted((e.name, e.path, e.is_dir(follow_symlinks=False)) for e in os.scandir(folder))
    except OSError:
        return []


class WalkSource(DataSource):
    """Options: paths (one a line), recursive, include_hidden, skip_prefixes (of folder names).
    Filters are taken over by the source; Spark's Python sources can't leave out columns."""

    @classmethod
    def name(cls) -> str:
        return "fswalk"

    def schema(self) -> str:
        return WALKED

    def reader(self, schema) -> DataSourceReader:
        return _Walk(self.options)


def walk(spark: SparkSession, roots: list[str], recursive: bool = True, include_hidden: bool = False, skip_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Every folder and file below the roots, which executors must reach under the same paths: for
    roots that are wide. `crawl` spreads any shape of tree."""
    spark.dataSource.register(WalkSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"paths": "\n".join(roots), "recursive": str(recursive).lower(), "include_hidden": str(include_hidden).lower(), "skip_prefixes": "\n".join(skip_prefixes)}
    return spark.read.format("fswalk").options(**options).load()


def crawl(spark: SparkSession, roots: list[str], generation: int = 1, include_hidden: bool = True, skip_prefixes: tuple[str, ...] = (), folders_per_task: int = 2000, tasks: int | None = None) -> DataFrame:
    """The roots and everything below as WALKED rows with scan_gen and listed_by (round and task).

    Goes in rounds over a frontier of folders, dealt evenly over all tasks. A task lists breadth-first
    until it has done folders_per_task, or listed ENTRIES_PER_TASK, and hands on what it has not come to, so that a deep or lopsided
    tree is spread as well as a wide one. Each round is stored: a lost executor costs its tasks alone.
    A folder that can't be listed holds nothing, a root that isn't there gives no row.
    """
    tasks = tasks or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    skip, schema = tuple(skip_prefixes), f"{WALKED}, todo boolean, listed_by string"

    def run(number: int):
        def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            by = f"{number}-{TaskContext.get().partitionId()}"
            yield from frames(rows(((r, p) for b in batches for r, p in zip(b.root, b.path, strict=True)), by), schema)

        def rows(given: Iterator[tuple[str, str]], by: str) -> Iterator[tuple]:
            queue: deque[tuple[str, str]] = deque()
            seen = 0
            for _ in range(folders_per_task):
                if seen >= ENTRIES_PER_TASK:
                    break
                at = next(given, None) or (queue.popleft() if queue else None)
                if at is None:
                    return
                root, folder = at
                for name, path, is_dir in _entries(folder):
                    seen += 1
                    if (include_hidden or not name.startswith(".")) and not (is_dir and skip and name.startswith(skip)):
                        if row := _row(root, path, is_dir):
                            yield (*row, False, by)
                        if is_dir:
                            queue.append((root, path))
            for root, folder in itertools.chain(given, queue):
                yield (folder, root, *[None] * 8, True, by)

        return listed

    own = [(*row, False, "0-0") for r in roots if (row := _row(r.rstrip("/") or "/", r.rstrip("/") or "/", True))]
    done = [stored(spark.createDataFrame(own, schema), "crawl")]
    frontier, waiting = spark.createDataFrame([(r[1], r[0]) for r in own], "root string, path string"), len(own)
    while waiting:
        found = stored(frontier.repartition(min(tasks, waiting)).mapInPandas(run(len(done)), schema), "crawl")
        done.append(found)
        frontier = found.filter("todo").select("root", "path")
        waiting = frontier.count()
    whole = spark.read.schema(schema).parquet(*(d.stored_path for d in done))
    return whole.filter("not todo").drop("todo").withColumn("scan_gen", F.lit(generation))


def wanted_files(walked: DataFrame, least: int = 0, most: int | None = None, extensions: list[str] | None = None) -> DataFrame:
    """Files of a size (no upper bound where most is 0 or None) and, if given, of the extensions."""
    out = walked.filter((F.col("is_dir") == 0) & (F.col("size") >= least))
    if most:
        out = out.filter(F.col("size") <= most)
    if extensions:
        out = out.filter(F.col("ext").isin([e.lower().removeprefix(".") for e in extensions]))
    return out


def relative(walked: DataFrame) -> DataFrame:
    """rel: the path below its root."""
    return walked.withColumn("rel", F.expr("substr(path, length(root) + 2)"))


def _hashes(path: str) -> tuple[str | None, str | None, str | None]:
    """(hash, md5, error) in one pass over the file, CHUNK bytes at a time."""
    try:
        size, md5, sha = os.path.getsize(path), hashlib.md5(), hashlib.sha256()
        sampled = size >= SAMPLED_SIZE
        with open(path, "rb") as f:
            while part := f.read(CHUNK):
                md5.update(part)
                if not sampled:
                    sha.update(part)
            if sampled:
                sha.update(str(size).encode())
                for at in (0, max(0, size // 2 - SAMPLE // 2), max(0, size - SAMPLE)):
                    f.seek(at)
                    sha.update(f.read(SAMPLE))
        return sha.hexdigest(), md5.hexdigest(), None
    except OSError as e:
        return None, None, type(e).__name__


def hashed(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """files(path, size, mtime) with hash, md5 and error. Rows that known(path, size, mtime, hash,
    md5) has unchanged take its values and aren't read; a file that fails has its error alone."""
    columns = files.select("path", "size", "mtime")
    current = columns.limit(0).selectExpr("*", "'' hash", "'' md5", "'' error") if known is None else columns.join(known.select("path", "size", "mtime", "hash", "md5"), ["path", "size", "mtime"]).withColumn("error", F.lit(None).cast("string"))
    left = columns if known is None else columns.join(known, ["path", "size", "mtime"], "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [_hashes(p) for p in b.path]
            yield b.assign(hash=[x[0] for x in found], md5=[x[1] for x in found], error=[x[2] for x in found])

    return left.mapInPandas(run, "path string, size long, mtime double, hash string, md5 string, error string").unionByName(current)


def archives(walked: DataFrame) -> DataFrame:
    return walked.filter((F.col("is_dir") == 0) & F.col("name").rlike(ARCHIVES))


def _content(path: str, kind: str) -> tuple[str, str | None, str | None]:
    """(type, content, error): texts as they are, up to so many characters; images and documents whole
    and videos up to so many bytes in base64; of others nothing."""
    try:
        if kind == "text":
            with open(path, encoding="utf-8", errors="replace") as f:
                return kind, f.read(fixed.READ_TEXT_CHARACTERS), None
        if kind == "binary":
            os.stat(path)
            return kind, None, None
        with open(path, "rb") as f:
            return kind, base64.b64encode(f.read(fixed.READ_VIDEO_BYTES if kind == "video" else -1)).decode(), None
    except OSError as e:
        return ("binary" if kind == "text" else kind), None, type(e).__name__


def read_for_analysis(files: DataFrame) -> DataFrame:
    """files(path, name, size) with type (text, image, video, document or binary, by the ending),
    mime, content and error. Texts are cut to 100,000 characters and videos to 25 MiB, as what reads
    them takes no more; a vector image counts as a PNG. A file that can't be read has its error."""
    end = F.lower(F.regexp_extract("name", r"(\.[^.]*)\z", 1))
    kind = F.lit("binary")
    for k, ends in fixed.READ_CLASSES.items():
        kind = F.when(end.isin(ends), k).otherwise(kind)
    mime = F.when(end == ".svg", "image/png").otherwise(mime_type("name"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            begun, made, held = 0, [], 0
            for at, (path, kind) in enumerate(zip(b.path, b.kind, strict=True)):
                made.append(_content(path, kind))
                held += len(made[-1][1] or "")
                if held >= READ_TOGETHER or at == len(b) - 1:
                    yield answer(b.iloc[begun : at + 1], made)
                    begun, made, held = at + 1, [], 0

    def answer(b: pd.DataFrame, made: list[tuple]) -> pd.DataFrame:
        kinds, contents, errors = (pd.Series(x, index=b.index, dtype=object) for x in zip(*made, strict=True))
        return pd.DataFrame({"path": b.path, "size": b["size"], "type": kinds, "mime": b.mime, "content": contents, "error": errors})

    # a walk lists a folder's files in one task, whatever their number
    tasks = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = files.select("path", "size", kind.alias("kind"), mime.alias("mime")).repartition(tasks, "path")
    return dealt.mapInPandas(run, "path string, size long, type string, mime string, content string, error string")
