"""The store of parts and manifests: what an upsert writes, what readers see, and writers that meet."""

import threading

import pytest
from pyspark.sql import functions as F

from fileloom.operators import logstore
from fileloom.operators.logstore import Store

ROWS = "path string, size long, md5 string"


def base(spark, n=20_000):
    return spark.range(n).select(F.format_string("/a/%06d", "id").alias("path"), F.col("id").alias("size"), F.md5(F.col("id").cast("string").cast("binary")).alias("md5"))


def seen(store):
    return {r.path: r.size for r in store.read().collect()}


def test_an_upsert_writes_its_own_rows(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s").write(base(spark))
    whole = sum(store.bytes_of().values())
    new = base(spark).filter("size % 100 = 7").withColumn("size", F.col("size") + 1).withColumn("seq", F.lit(1))
    store.upsert(new.unionByName(new.withColumns({"seq": F.lit(2), "size": F.lit(5)})), "path")
    added = list(store.bytes_of().values())[-1]
    assert 0 < added < 0.03 * whole  # one in a hundred rows, and the footers
    want = {f"/a/{i:06d}": 5 if i % 100 == 7 else i for i in range(20_000)}
    assert seen(store) == want
    assert {r.path: r.size for r in store.read(1).collect()} == {f"/a/{i:06d}": i for i in range(20_000)}
    plan = store.read().filter("path = '/a/000007'")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "PushedFilters: [IsNotNull(path), EqualTo(path,/a/000007)]" in plan
    assert plan.count("Exchange hashpartitioning") <= 2 * plan.count("Exchange SinglePartition") + 4  # the base isn't dealt out


def test_a_merge_beyond_the_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(logstore, "BROADCAST_ROWS", 0)
    store = Store(spark, f"file://{tmp_path}/s").write(base(spark, 500))
    store.upsert(base(spark, 700).filter("size >= 400").withColumns({"size": F.lit(1), "seq": F.lit(1)}), ["path"])
    assert seen(store) == {f"/a/{i:06d}": i if i < 400 else 1 for i in range(700)}


def test_readers_see_no_half_commit(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s").write(base(spark, 100))
    new = base(spark, 100).withColumns({"size": F.lit(-1), "seq": F.lit(1)})

    def dies(self, version, content):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(Store, "_put", dies)
        with pytest.raises(OSError):
            store.upsert(new, "path")
    assert seen(store) == {f"/a/{i:06d}": i for i in range(100)}
    reader = store.read()  # of the version before
    store.upsert(new, "path")
    assert {r["size"] for r in reader.collect()} == set(range(100)) and set(seen(store).values()) == {-1}


@pytest.mark.parametrize("shared", [False, True])
def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch, shared):
    if shared:  # the rename of shared file systems, and a writer that comes between
        monkeypatch.setattr(Store, "_put", _shared_put)
    at = f"file://{tmp_path}/s"
    Store(spark, at).write(base(spark, 10))
    failed = []

    def write(k):
        try:
            for i in range(3):
                Store(spark, at).upsert(spark.createDataFrame([(f"/w{k}/{i}", k, "m", 1)], ROWS + ", seq int"), "path")
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    writers = [threading.Thread(target=write, args=(k,)) for k in range(1 if shared else 3)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not failed
    assert {p for p in seen(Store(spark, at)) if p.startswith("/w")} == {f"/w{k}/{i}" for k in range(len(writers)) for i in range(3)}
    if shared:
        store = Store(spark, at)
        with pytest.raises(logstore.Taken):
            store._put(store._manifest()["version"], {})


def _shared_put(self, version, content):
    import json
    import uuid

    system, draft, final = self._system(), self._path("log", f".{uuid.uuid4().hex}"), self._path("log", f"{version:012d}.json")
    out = system.create(draft, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    try:
        self._renamed(system, draft, final)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            raise logstore.Taken from e
        raise


def test_ranges_are_compacted_alone(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s").write(base(spark, 2000))
    store.upsert(base(spark, 2000).filter("size % 10 = 3").withColumns({"size": F.lit(0), "seq": F.lit(1)}), "path")
    want = {f"/a/{i:06d}": 0 if i % 10 == 3 else i for i in range(2000)}
    store.compact(ranges=4)
    before = set(store.bytes_of())
    assert seen(store) == want and len(before) == 4
    # changes at the low end, one beyond the high end, and null keys
    store.upsert(spark.createDataFrame([(f"/a/{i:06d}", 7, "m", 1) for i in range(300)] + [("/b", 8, "m", 1), (None, 9, "m", 1)], ROWS + ", seq int"), "path")
    store.delete(spark.createDataFrame([("/a/000000",), ("/a/001999",)], "path string"))
    want |= {f"/a/{i:06d}": 7 for i in range(300)} | {"/b": 8, None: 9}
    del want["/a/000000"], want["/a/001999"]
    assert seen(store) == want
    store.compact(share=0.3)
    assert len(before & set(store.bytes_of())) == 3 and seen(store) == want  # one of four was written anew
    store.upsert(spark.createDataFrame([("/a/000001", 70, "m", 1), ("/a/001500", 71, "m", 1)], ROWS + ", seq int"), "path")
    want |= {"/a/000001": 70, "/a/001500": 71}
    assert seen(store) == want
    store.compact(share=-1)
    assert seen(store) == want and all("low" in p for p in store._manifest()["parts"])
    store.clear(keep=1)
    assert seen(store) == want and store.versions().count() == 1


def test_a_compaction_keeps_what_comes_meanwhile(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s").write(base(spark, 100))
    store.upsert(base(spark, 10).withColumns({"size": F.lit(1), "seq": F.lit(1)}), "path")
    made = Store._ranged

    def slow(self, *a):
        out = made(self, *a)
        Store(spark, self.folder).upsert(base(spark, 20).filter("size >= 15").withColumns({"size": F.lit(2), "seq": F.lit(1)}), "path")
        return out

    monkeypatch.setattr(Store, "_ranged", slow)
    store.compact(ranges=3)
    assert seen(store) == {f"/a/{i:06d}": 1 if i < 10 else 2 if 15 <= i < 20 else i for i in range(100)}
    monkeypatch.setattr(Store, "_ranged", lambda self, *a: (Store(spark, self.folder).write(base(spark, 5)), made(self, *a))[1])
    with pytest.raises(logstore.Conflict):
        Store(spark, f"file://{tmp_path}/t").write(base(spark, 9)).compact(key="path")


def test_replacing_keys_of_many_rows(spark, tmp_path):
    kind = "drive string, path string, size int"
    store = Store(spark, f"file://{tmp_path}/s").write(spark.createDataFrame([("d1", "a", 1), ("d1", "b", 1), ("d2", "a", 1), (None, "z", 1)], kind))
    store.replace(spark.createDataFrame([("d1", "c", 2), ("d1", "d", 2), (None, "y", 2)], kind), "drive").append(spark.createDataFrame([("d1", "e", 3)], kind))
    rows = lambda: sorted((str(r.drive), r.path) for r in store.read().collect())
    want = [("None", "y"), ("d1", "c"), ("d1", "d"), ("d1", "e"), ("d2", "a")]
    assert rows() == want
    store.compact(ranges=2)
    assert rows() == want
    with pytest.raises(ValueError):
        store.upsert(spark.createDataFrame([("d1", "c", 2, 1)], kind + ", seq int"), "path")
    store.delete(spark.createDataFrame([("d1",)], "drive string"))
    assert rows() == [("None", "y"), ("d2", "a")]
