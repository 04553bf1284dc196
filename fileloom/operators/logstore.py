"""Tables that outlive a session: immutable Parquet parts, and numbered manifests that say which of
them a version is made of.

An upsert writes its own rows and a manifest, and nothing else. Readers take the newest manifest and
merge: a row counts unless a later part names its key. The merge reads the keys of the later parts
only, and doesn't shuffle the base while those are few. `compact` rewrites the key ranges that have
gathered enough changes and leaves the others.

A version exists when its manifest does. That is put under its name in one step, which fails if the
name is taken: a writer that comes second takes up the other's version and tries again, so that no
writer's rows are lost, and parts of a writer that died are never read.
"""

from __future__ import annotations

import contextlib
import json
import os
import time
import uuid
from collections.abc import Callable
from functools import reduce
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, IntegralType, StringType, StructField, StructType

from .duplicates import latest

#: Keys of later parts are broadcast up to this many and so many bytes of Parquet; beyond, the merge
#: is an ordinary join.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 8 << 20
#: Tries of a commit among other writers.
TRIES = 50


class Conflict(RuntimeError):
    """Another writer has rewritten what this one has read."""


class Taken(Exception):
    pass


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # files and manifests ------------------------------------------------------------------------

    def _path(self, *below: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *below]))

    def _system(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self) -> list[tuple[int, int]]:
        """(version, milliseconds of its commit), oldest first."""
        system, log = self._system(), self._path("log")
        if not system.exists(log):
            return []
        names = [(s.getPath().getName(), s.getModificationTime()) for s in system.listStatus(log)]
        return sorted((int(n[:-5]), at) for n, at in names if n.endswith(".json") and not n.startswith("."))

    def _manifest(self, version: int | None = None) -> dict | None:
        if version is None:
            whole = self._listed()
            if not whole:
                return None
            version = whole[-1][0]
        stream = self._system().open(self._path("log", f"{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _put(self, version: int, content: dict) -> None:
        """The manifest under its name, whole or not at all; Taken if there is one already."""
        system, draft, final = self._system(), self._path("log", f".{uuid.uuid4().hex}"), self._path("log", f"{version:012d}.json")
        out = system.create(draft, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        try:
            if system.getScheme() == "file":  # a local rename would replace the other's manifest; a link fails
                os.link(*(unquote(urlparse(p.toUri().toString()).path) for p in (draft, final)))
            else:
                self._renamed(system, draft, final)
        except FileExistsError as e:
            raise Taken from e
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Taken from e
            raise
        finally:
            with contextlib.suppress(Exception):
                system.delete(draft, False)

    def _renamed(self, system, draft, final) -> None:
        """A rename that fails where the name is taken, as the shared file systems have it."""
        fs = self.spark._jvm.org.apache.hadoop.fs
        kind = getattr(fs, "Options$Rename")
        modes = self.spark.sparkContext._gateway.new_array(kind, 1)
        modes[0] = kind.NONE
        fs.FileContext.getFileContext(system.getUri(), self.spark._jsc.hadoopConfiguration()).rename(system.makeQualified(draft), system.makeQualified(final), modes)

    def _commit(self, change: Callable[[dict | None, int], dict]) -> Store:
        """change(newest manifest or None, new version) gives the new one; again if another came first."""
        for _ in range(TRIES):
            now = self._manifest()
            version = now["version"] + 1 if now else 1
            try:
                self._put(version, {**change(now, version), "version": version})
            except Taken:
                time.sleep(0.05)
            else:
                return self
        raise Conflict(f"{self.folder}: {TRIES} other commits came first")

    def _part(self, df: DataFrame, kind: str) -> dict:
        at = f"data/{kind}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.folder}/{at}")
        return {"at": at, "rows": self.spark.read.parquet(f"{self.folder}/{at}").count() if df.columns else 0, "bytes": self._system().getContentSummary(self._path(*at.split("/"))).getLength()}

    # reading ------------------------------------------------------------------------------------

    def exists(self) -> bool:
        return bool(self._listed())

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the newest if none is named."""
        m = self._manifest(version)
        if m is None:
            raise FileNotFoundError(self.folder)
        return self._merged(m)

    def _merged(self, m: dict) -> DataFrame:
        schema = StructType.fromJson(m["schema"])
        parts = [p for p in m["parts"] if p.get("rows_at")]
        if not parts:
            return self.spark.createDataFrame([], schema)
        voids = [p for p in m["parts"] if p.get("keys_at")]
        if not voids and not any("low" in p for p in parts):
            return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{p['rows_at']}" for p in parts))
        alike: dict[tuple[int, bool], list[str]] = {}
        for p in parts:  # a range's v is the version up to which it holds all changes
            alike.setdefault((p["v"], "low" in p), []).append(f"{self.folder}/{p['rows_at']}")
        frames = {of: self.spark.read.schema(schema).parquet(*at) for of, at in alike.items()}
        rows = reduce(DataFrame.unionByName, [(df if merged else self._unmerged(df, m, v)).withColumn("_v", F.lit(v)) for (v, merged), df in frames.items()])
        if not voids:
            return rows.drop("_v")
        keys, kinds = m["key"], StructType([f for f in schema if f.name in m["key"]])
        named = [self.spark.read.schema(kinds).parquet(f"{self.folder}/{p['keys_at']}").select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys)), F.lit(p["v"]).alias("_by")) for p in voids]
        last = reduce(DataFrame.unionByName, named).groupBy(*(f"_{i}" for i in range(len(keys)))).agg(F.max("_by").alias("_by"))
        if sum(p["keys"] for p in voids) <= BROADCAST_ROWS and sum(p["bytes"] for p in voids) <= BROADCAST_BYTES:
            last = F.broadcast(last)
        same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)))
        return rows.join(last, same, "left").filter("_by is null or _v >= _by").select(*schema.names)

    def _unmerged(self, df: DataFrame, m: dict, v: int) -> DataFrame:
        """Rows of a part of version v without those that compacted ranges hold already."""
        held = [p for p in m["parts"] if "low" in p and p["v"] >= v]
        for low, high in {(p["low"], p["high"]) for p in held}:
            df = df.filter(~_within(m["key"][0], low, high))
        return df

    def version(self) -> int:
        return self._listed()[-1][0]

    def note(self) -> dict:
        """What the newest version says of itself."""
        return ((self._manifest() or {}).get("note")) or {}

    def changed_since(self, version: int, until: int | None = None) -> DataFrame | None:
        """The keys that versions after the given one name; None where that isn't known, as all rows
        were written, or a version between is forgotten."""
        last = self.version() if until is None else until
        known = {v for v, _ in self._listed()}
        if not set(range(version, last + 1)) <= known:
            return None
        newest, found = self._manifest(last), []
        for v in range(version + 1, last + 1):
            m = self._manifest(v)
            if m["did"] == "write" or not newest["key"]:
                return None
            if m["did"] != "compact":
                part = m["parts"][-1]
                found.append(f"{self.folder}/{part['keys_at'] or part['rows_at']}")
        kinds = StructType([f for f in StructType.fromJson(newest["schema"]) if f.name in (newest["key"] or ())])
        return self.spark.read.schema(kinds).parquet(*found).distinct() if found else self.spark.createDataFrame([], kinds)

    def versions(self) -> DataFrame:
        """version and modified of every version, newest first."""
        return self.spark.createDataFrame([(v, t / 1000) for v, t in reversed(self._listed())], "version int, modified double")

    def bytes_of(self, version: int | None = None) -> dict[str, int]:
        """Bytes of each part of a version."""
        return {p["rows_at"] or p["keys_at"]: p["bytes"] for p in self._manifest(version)["parts"]}

    # writing ------------------------------------------------------------------------------------

    def write(self, df: DataFrame, note: dict | None = None) -> Store:
        """df in place of all rows. note: what the version should say of itself."""
        part = self._part(df, "whole")
        entry = {"rows_at": part["at"], "keys_at": None, "rows": part["rows"], "bytes": part["bytes"]}
        return self._commit(lambda now, v: {"schema": df.schema.jsonValue(), "key": (now or {}).get("key"), "parts": [entry | {"v": v}], "did": "write", "note": note})

    def append(self, new: DataFrame) -> Store:
        now = self._manifest()
        if now is None:
            return self.write(new)
        part = self._part(self._shaped(new, now), "more")
        return self._commit(lambda m, v: m | {"parts": [*m["parts"], {"rows_at": part["at"], "keys_at": None, "rows": part["rows"], "bytes": part["bytes"], "v": v}], "did": "append"})

    def upsert(self, new: DataFrame, key: str | list[str]) -> Store:
        """Rows of new(..., seq) take the place of rows with their key; the latest by seq counts. Only
        new's rows are written, sorted by key."""
        keys = [key] if isinstance(key, str) else list(key)
        fresh = latest(new, keys, "seq").drop("seq")
        return self._over(fresh, None, keys)

    def replace(self, new: DataFrame, key: str | list[str], named: DataFrame | None = None, note: dict | None = None) -> Store:
        """All rows of the keys that new has, or of those in named, give way to new's rows."""
        keys = [key] if isinstance(key, str) else list(key)
        return self._over(new, (new if named is None else named).select(*keys).distinct(), keys, note)

    def delete(self, gone: DataFrame) -> Store:
        """Rows whose key is in gone go."""
        now = self._manifest()
        if now is None or not now["key"]:
            raise ValueError("a store without upserts has no key to delete by")
        return self._over(None, gone.select(*now["key"]).distinct(), now["key"])

    def _over(self, rows: DataFrame | None, named: DataFrame | None, keys: list[str], note: dict | None = None) -> Store:
        now = self._manifest()
        if now and now["key"] not in (None, keys):
            raise ValueError(f"the key of this store is {now['key']}")
        schema = now["schema"] if now else rows.schema.jsonValue()
        wrote = self._part((self._shaped(rows, now) if now else rows).sortWithinPartitions(*keys), "changes") if rows is not None else None
        by = self._part(named.sortWithinPartitions(*keys), "keys") if named is not None else None
        entry = {"rows_at": wrote and wrote["at"], "keys_at": (by or wrote)["at"], "rows": wrote["rows"] if wrote else 0, "keys": (by or wrote)["rows"], "bytes": (wrote["bytes"] if wrote else 0) + (by["bytes"] if by else 0)}

        def change(m: dict | None, v: int) -> dict:
            if m and m["key"] not in (None, keys):
                raise ValueError(f"the key of this store is {m['key']}")
            m = m or {"schema": schema, "parts": []}
            return m | {"key": keys, "parts": [*m["parts"], entry | {"v": v}], "did": "change", "note": note}

        return self._commit(change)

    def _shaped(self, df: DataFrame, m: dict) -> DataFrame:
        return df.select(*(F.col(f.name).cast(f.dataType) for f in StructType.fromJson(m["schema"])))

    def compact(self, ranges: int = 16, share: float = 0.1, key: str | None = None) -> Store:
        """Merges changes into the base by ranges of the first key column. The first time, and where
        the key is of another type than a text or whole number, everything is rewritten, as up to
        `ranges` parts; later only ranges where changes come to a share of the rows. A key value with
        many rows makes one range, of many files."""
        m = self._manifest()
        keys = m["key"] or ([key] if key else None)
        if not keys:
            raise ValueError("name a key to compact by")
        upto = m["version"]
        have = [p for p in m["parts"] if "low" in p]
        if have:
            changed = self._changed(m, have)
            chosen = [p for p in have if changed.get(p["rows_at"], 0) > share * max(1, p["rows"])]
            new = self._rewritten(m, chosen)
        else:
            chosen, new = [p for p in m["parts"] if p.get("rows_at")], self._ranged(m, keys, ranges)
        if not chosen:
            return self
        gone = {p["rows_at"] for p in chosen}

        def change(now: dict, v: int) -> dict:
            if not gone <= {p["rows_at"] for p in now["parts"]}:
                raise Conflict("another writer has rewritten these ranges")
            held = [*(p for p in now["parts"] if "low" in p and p["rows_at"] not in gone), *(p | {"v": upto} for p in new)]
            least = min(p["v"] for p in held)  # all ranges hold the changes up to here
            late = [p for p in now["parts"] if "low" not in p and p["v"] > least]
            return now | {"key": keys, "parts": [*held, *late], "did": "compact"}

        return self._commit(change)

    def _ranged(self, m: dict, keys: list[str], n: int) -> list[dict]:
        """All rows, sorted by key, in at most n ranges of the first key column."""
        kind = StructType.fromJson(m["schema"])[keys[0]].dataType
        rows = self._merged(m)
        if not isinstance(kind, (StringType, IntegralType)):
            n = 1
        spread = F.xxhash64(*rows.columns).alias("_h")  # rows of one key may go to several tasks
        at = f"data/ranges-{uuid.uuid4().hex}"
        cut = rows.select("*", spread).repartitionByRange(n, keys[0], "_h").withColumn("_r", F.spark_partition_id()).drop("_h")
        cut.sortWithinPartitions("_r", *keys).write.option("compression", "zstd").partitionBy("_r").parquet(f"{self.folder}/{at}")
        wrote = self.spark.read.schema(StructType([*rows.schema, StructField("_r", IntegerType())])).parquet(f"{self.folder}/{at}")
        bounds = wrote.groupBy("_r").agg(F.min(keys[0]), F.max(keys[0]), F.count("*")).orderBy("_r").collect()
        groups: list[list] = []
        for r in bounds:
            joined = groups and (groups[-1][-1][2] is None or r[1] is None or r[1] <= groups[-1][-1][2])
            groups[-1].append(r) if joined else groups.append([r])
        out = []
        for i, g in enumerate(groups):
            low = g[0][1] if i else None
            high = groups[i + 1][0][1] if i + 1 < len(groups) else None
            for r in g:
                where = f"{at}/_r={r[0]}"
                out.append({"rows_at": where, "keys_at": None, "rows": r[3], "bytes": self._system().getContentSummary(self._path(*where.split("/"))).getLength(), "low": low, "high": high})
        return out or [{"rows_at": self._part(rows, "whole")["at"], "keys_at": None, "rows": 0, "bytes": 0, "low": None, "high": None}]

    def _changed(self, m: dict, have: list[dict]) -> dict[str, int]:
        """Rows and keys of later parts by the range that they fall into."""
        first, counts = m["key"][0], {p["rows_at"]: 0 for p in have}
        for p in m["parts"]:
            if "low" in p:
                continue
            df = self.spark.read.parquet(f"{self.folder}/{p['keys_at'] or p['rows_at']}").select(first)
            later = [x for x in have if x["v"] < p["v"]]
            if later:
                found = df.agg(*(F.count_if(_within(first, x["low"], x["high"])) for x in later)).first()
                for x, c in zip(later, found, strict=True):
                    counts[x["rows_at"]] += c
        return counts

    def _rewritten(self, m: dict, chosen: list[dict]) -> list[dict]:
        first, out = m["key"][0], []
        rows = self._merged(m)
        for low, high in dict.fromkeys((p["low"], p["high"]) for p in chosen):  # parts of one range go together
            for p in m["parts"]:
                if p.get("low", self) == low and p.get("high", self) == high and p not in chosen:
                    chosen.append(p)
            part = self._part(rows.filter(_within(first, low, high)).sortWithinPartitions(*m["key"]), "range")
            out.append({"rows_at": part["at"], "keys_at": None, "rows": part["rows"], "bytes": part["bytes"], "low": low, "high": high})
        return out

    def clear(self, keep: int = 0) -> None:
        """Forgets all but the newest versions, and deletes the parts that only the forgotten ones
        have. Parts of writers that haven't committed yet are left alone."""
        whole = [v for v, _ in self._listed()]
        old, kept = (whole[: len(whole) - keep], whole[len(whole) - keep :]) if keep else (whole, [])
        used = {at for v in kept for p in self._manifest(v)["parts"] for at in (p["rows_at"], p["keys_at"]) if at}
        gone = {at for v in old for p in self._manifest(v)["parts"] for at in (p["rows_at"], p["keys_at"]) if at} - used
        for v in old:
            self._system().delete(self._path("log", f"{v:012d}.json"), False)
        for at in gone:
            self._system().delete(self._path(*at.split("/")), True)


def _within(first: str, low: str | int | None, high: str | int | None) -> Column:
    """Whether the first key column lies in [low, high); null lies in the lowest range."""
    k = F.col(first)
    above = F.lit(True) if low is None else k >= F.lit(low)
    below = F.lit(True) if high is None else k < F.lit(high)
    return F.coalesce(above & below, F.lit(low is None))
