"""File walks, hashes, archives, listings and streams on small folders."""

import gzip
import hashlib
import os
import tarfile
import zipfile

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from fileloom.operators import catalog, logstore
from fileloom.sources import archives, files, listings
from fileloom.streaming import live


def tree(root):
    for rel, data in {"a.txt": b"one", "sub/b.TXT": b"two", "sub/deep/c.bin": b"x" * 3000, ".hidden/d": b"no", "sub/.e": b"no", "_kept/f": b""}.items():
        path = root / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)


def test_walk(spark, tmp_path):
    tree(tmp_path)
    found = files.relative(files.walk(spark, [str(tmp_path)]))
    assert {r.rel for r in found.filter("is_dir = 0").collect()} == {"a.txt", "sub/b.TXT", "sub/deep/c.bin", "_kept/f"}
    assert {r.rel for r in found.filter("is_dir = 1").collect()} == {"sub", "sub/deep", "_kept"}
    assert files.walk(spark, [str(tmp_path)], include_hidden=True).filter("is_dir = 0").count() == 6
    assert {r.name for r in files.walk(spark, [str(tmp_path)], recursive=False).filter("is_dir = 0").collect()} == {"a.txt"}
    assert files.walk(spark, [str(tmp_path)], skip_prefixes=("_",)).filter("name = 'f'").count() == 0
    assert {r.name for r in files.wanted_files(found, 1, 10, [".txt"]).collect()} == {"a.txt", "b.TXT"}


def test_hashes_are_kept(spark, tmp_path):
    tree(tmp_path)
    found = files.wanted_files(files.walk(spark, [str(tmp_path)]))
    first = files.hashed(found)
    got = {os.path.basename(r.path): r for r in first.collect()}
    assert got["a.txt"].md5 == hashlib.md5(b"one").hexdigest() and got["a.txt"].hash == hashlib.sha256(b"one").hexdigest()
    known = first.withColumn("md5", F.lit("kept")).drop("error")
    rows = spark.createDataFrame(known.collect(), known.schema)
    (tmp_path / "a.txt").write_bytes(b"other")
    again = {os.path.basename(r.path): r.md5 for r in files.hashed(files.wanted_files(files.walk(spark, [str(tmp_path)])), rows).collect()}
    assert again["a.txt"] == hashlib.md5(b"other").hexdigest() and again["b.TXT"] == "kept"
    gone = spark.createDataFrame([("/no/such", 1, 1.0)], "path string, size long, mtime double")
    assert files.hashed(gone).first().error == "FileNotFoundError"


def test_sampled_hash(tmp_path):
    data = bytes((7 * i + 13) % 256 for i in range(4096)) * (60 * 256)
    (tmp_path / "big").write_bytes(data)
    n, k = len(data), files.SAMPLE
    want = hashlib.sha256(str(n).encode() + data[:k] + data[n // 2 - k // 2 : n // 2 + k // 2] + data[-k:]).hexdigest()
    assert files._hashes(str(tmp_path / "big"))[:2] == (want, hashlib.md5(data).hexdigest())


def test_filters_are_pushed_into_the_walk(spark, tmp_path, monkeypatch, capsys):
    tree(tmp_path)
    found = files.walk(spark, [str(tmp_path)])
    few = files.wanted_files(found, 2, 5000, ["txt"]).filter(F.col("path").startswith(f"{tmp_path}/sub"))
    few.explain("formatted")
    plan = capsys.readouterr().out
    pushed = plan.split("PushedFilters: [")[1].split("]\n")[0]
    assert ") Filter" not in plan and "GreaterThanOrEqual(size,2)" in pushed and "EqualTo(ext,txt)" in pushed and "StringStartsWith(path," in pushed
    assert [r.name for r in few.collect()] == ["b.TXT"]
    assert found.filter("size >= 3 or name = 'f'").filter("is_dir = 0").count() == 4  # not taken over, tested by Spark

    listed = []
    scandir = os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: listed.append(os.path.relpath(p, tmp_path)) or scandir(p))
    for filters, folders, names in [
        ([files.StringStartsWith(("path",), f"{tmp_path}/sub/deep/")], {".", "sub", "sub/deep"}, {"c.bin"}),
        ([files.EqualTo(("parent",), f"{tmp_path}/sub")], {".", "sub"}, {"b.TXT", "deep"}),
        ([files.In(("path",), (f"{tmp_path}/_kept/f", f"{tmp_path}/a.txt"))], {".", "_kept"}, {"f", "a.txt"}),
        ([files.EqualTo(("root",), "/other")], set(), set()),
    ]:
        listed.clear()
        reader = files._Walk({"paths": str(tmp_path)})
        assert list(reader.pushFilters(filters)) == []
        rows = [r for p in reader.partitions() for r in reader.read(p)]
        assert set(listed) == folders and {r[4] for r in rows} == names


def test_a_deep_tree_is_crawled_by_many_tasks(spark, tmp_path):
    for a in range(6):
        at = tmp_path / "one" / f"d{a}"
        for d in range(25):
            at = at / f"n{d}"
            at.mkdir(parents=True)
            (at / f"f{d}.txt").write_bytes(b"x" * d)
    (tmp_path / "one" / "_skipped").mkdir()
    found = files.crawl(spark, [f"{tmp_path}/one/", "/no/such"], generation=7, skip_prefixes=("_",), folders_per_task=5, tasks=4).cache()
    walked = {(r.path, r.size) for r in files.walk(spark, [f"{tmp_path}/one"], skip_prefixes=("_",)).collect()}
    assert {(r.path, r["size"]) for r in found.collect()} == walked | {(f"{tmp_path}/one", 0)}
    assert found.count() == len(walked) + 1 and {r.scan_gen for r in found.collect()} == {7}
    by = {r.listed_by for r in found.collect()}
    assert len({b.split("-")[1] for b in by}) == 4 and len(by) > 20


def test_folders_of_many_files_are_crawled_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "ENTRIES_PER_TASK", 30)
    for a in range(8):
        (tmp_path / f"d{a}").mkdir()
        for k in range(25):
            (tmp_path / f"d{a}" / str(k)).write_bytes(b"x")
    found = files.crawl(spark, [str(tmp_path)], tasks=4).collect()
    assert len({r.path for r in found}) == len(found) == 1 + 8 + 200
    assert len({r.listed_by for r in found if not r.is_dir}) > 2


def test_two_crawls_and_a_catalog(spark, tmp_path):
    tree(tmp_path / "r")
    root = f"{tmp_path}/r"
    store = logstore.Store(spark, f"file://{tmp_path}/catalog")
    first = catalog.recrawled(store, files.crawl(spark, [root], 1))
    assert {r.change for r in first.collect()} == {"added"} and catalog.next_generation(store.read(), root) == 2
    (tmp_path / "r" / "new").mkdir()
    (tmp_path / "r" / "new" / "n.txt").write_bytes(b"1")
    (tmp_path / "r" / "a.txt").write_bytes(b"changed")
    (tmp_path / "r" / "sub" / "deep" / "c.bin").unlink()
    changes = {(os.path.relpath(r.path, root), r.change) for r in catalog.recrawled(store, files.crawl(spark, [root], 2)).collect()}
    assert {("new", "added"), ("new/n.txt", "added"), ("a.txt", "changed"), ("sub/deep/c.bin", "deleted")} <= changes
    assert not {c for c in changes if c[0] in ("sub/b.TXT", ".hidden/d", "sub/.e")}
    now = {os.path.relpath(r.path, root): r.scan_gen for r in store.read().collect()}
    assert now["a.txt"] == now["new/n.txt"] == 2 and now["sub/b.TXT"] == 1 and "sub/deep/c.bin" not in now
    assert catalog.recrawled(store, files.crawl(spark, [root], 3)).count() == 0


def _zip(path, members, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        for name, data in members:
            z.writestr(name, data)


def test_archives(spark, tmp_path):
    import warnings

    warnings.simplefilter("ignore")  # the twice-named member
    _zip(tmp_path / "a.zip", [("x/y.txt", b"hello"), ("../out.txt", b"no"), ("__MACOSX/x", b"no"), ("Mail/all.mbox", b"no"), ("big", bytes(range(256)) * 20_000), ("x/y.txt", b"again"), ("empty", b""), ("d/", b"")])
    for k, method in enumerate([zipfile.ZIP_STORED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA]):
        _zip(tmp_path / f"m{k}.zip", [("m", b"some text " * 300_000)], method)
    (tmp_path / "before.zip").write_bytes(b"a program" * 9 + (tmp_path / "m0.zip").read_bytes())
    for name, mode in [("b.tar.gz", "w:gz"), ("c.tar", "w"), ("e.tar.bz2", "w:bz2")]:
        with tarfile.open(tmp_path / name, mode) as t:
            t.add(tmp_path / "m1.zip", "in.zip")
            t.add(tmp_path / "m1.zip", "../leaves.zip")
    (tmp_path / "f.txt.gz").write_bytes(gzip.compress(b"gz" * 9))
    whole = (tmp_path / "a.zip").read_bytes()
    (tmp_path / "bad.zip").write_bytes(b"zip?")
    (tmp_path / "cut.zip").write_bytes(whole[: len(whole) // 2])
    at = whole.index(b"big") + 3 + 200
    (tmp_path / "flip.zip").write_bytes(whole[:at] + bytes([whole[at] ^ 255]) + whole[at + 1 :])
    gz = (tmp_path / "b.tar.gz").read_bytes()
    (tmp_path / "cut.tar.gz").write_bytes(gz[: len(gz) // 2])
    (tmp_path / "old.rar").write_bytes(b"Rar!")
    found = archives.archives(files.walk(spark, [str(tmp_path)]))
    rows = archives.read_members(found, f"{tmp_path}/out", task_bytes=1 << 20).collect()
    got = {(os.path.basename(r.archive), r.member): (r.skip, r.error, r.md5) for r in rows if r.skip != "replaced"}
    md5 = lambda data: hashlib.md5(data).hexdigest()
    text, inner = md5(b"some text " * 300_000), md5((tmp_path / "m1.zip").read_bytes())
    assert {k[1]: v for k, v in got.items() if k[0] == "a.zip"} == {"x/y.txt": (None, None, md5(b"again")), "../out.txt": ("outside", None, None), "__MACOSX/x": ("system", None, None), "Mail/all.mbox": ("mail", None, None), "big": (None, None, md5(bytes(range(256)) * 20_000)), "empty": (None, None, md5(b""))}
    assert sum(r.skip == "replaced" for r in rows if r.archive.endswith("/a.zip")) == 1
    assert all(got[f"{n}.zip", "m"] == (None, None, text) for n in ("m0", "m1", "m2", "before"))
    assert all(got[n, "in.zip"] == (None, None, inner) and got[n, "../leaves.zip"][0] == "outside" for n in ("b.tar.gz", "c.tar", "e.tar.bz2"))
    assert got["f.txt.gz", "f.txt"] == (None, None, md5(b"gz" * 9))
    assert got["bad.zip", None][1] == "NotAZip" and got["cut.zip", None][1] == "NotAZip" and got["old.rar", None][1] == "Format" and got["cut.tar.gz", None][1]
    assert got["flip.zip", "big"][1] and got["flip.zip", "x/y.txt"] == (None, None, md5(b"again"))  # the others are read
    for r in rows:
        if r.target and not r.error:
            with open(r.target, "rb") as f:
                assert md5(f.read()) == r.md5
    assert not os.path.exists(tmp_path / "out.txt") and not [f for _, _, names in os.walk(tmp_path / "out") for f in names if len(f) > 33]
    listed = {(os.path.basename(r.archive), r.member, r.skip) for r in archives.members(found).filter("archive like '%/a.zip' or archive like '%/b.tar.gz'").collect()}
    assert ("a.zip", "x/y.txt", None) in listed and ("b.tar.gz", "in.zip", None) in listed


def test_files_are_read_as_far_as_an_analysis_takes_them(spark, tmp_path):
    import base64

    for name, data in {"long.txt": "é".encode() * 150_000, "bad.md": b"a\xff\r\nb", "v.MP4": b"v" * (26 << 20), "d.pdf": b"%PDF", "i.svg": b"<svg/>", "none": b"x", "x.zip": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    found = files.walk(spark, [str(tmp_path)]).filter("is_dir = 0").select("path", "name", "size").union(spark.createDataFrame([("/no/such.txt", "such.txt", 1)], "path string, name string, size long"))
    got = {os.path.basename(r.path): r for r in files.read_for_analysis(found).collect()}
    assert got["long.txt"].content == "é" * 100_000 and got["bad.md"].content == "a\ufffd\nb"
    assert len(base64.b64decode(got["v.MP4"].content)) == 25 << 20 and got["v.MP4"]["size"] == 26 << 20 and got["d.pdf"].content == base64.b64encode(b"%PDF").decode()
    assert (got["i.svg"].mime, got["none"].type, got["none"].content, got["x.zip"].type) == ("image/png", "binary", None, "binary")
    assert (got["such.txt"].error, got["such.txt"].type) == ("FileNotFoundError", "binary")


def test_files_of_one_folder_are_read_by_many_tasks(spark, tmp_path):
    for k in range(60):
        (tmp_path / f"{k}.txt").write_text(f"text {k}")
    got = files.read_for_analysis(files.walk(spark, [str(tmp_path)]).filter("is_dir = 0"))
    assert {(os.path.basename(r.path), r.content) for r in got.collect()} == {(f"{k}.txt", f"text {k}") for k in range(60)}
    assert got.select(F.spark_partition_id()).distinct().count() > 1


def test_drive_only_members():
    skip = lambda m: archives.skip_of(m, only_drive=True)
    assert [skip(m) for m in ("Takeout/Drive/a.txt", "Takeout/My Activity/Drive/x", "Takeout/Photos/a.jpg", "Takeout/Drive/My Activity/b", "Takeout/Drive/x.mbox")] == [None, "not_drive", "not_drive", "not_drive", "mail"]


def test_a_zip_of_64_bit_fields(tmp_path):
    with zipfile.ZipFile(tmp_path / "w.zip", "w") as z:
        with z.open("wide", "w", force_zip64=True) as f:
            f.write(b"x" * 1000)
        for k in range(70_000):
            z.writestr(f"n{k}", b"")
    with open(tmp_path / "w.zip", "rb") as f:
        found = list(archives.zip_entries(f))
        assert len(found) == 70_001 and b"".join(archives._unpacked(f, found[0])) == b"x" * 1000


def test_listings(spark, tmp_path):
    (tmp_path / "l.csv").write_text("id,name,parents.0.id\n1, A ,p\n2,,q\n3,\" A \",r\n")
    got = listings.csv_listing(spark, str(tmp_path / "l.csv"), ["id", "name", "parents.0.id", "parents.0"])
    assert [tuple(r) for r in got.orderBy("id").limit(1).collect()] == [("1", " A ", "p", None)]
    assert [r.name for r in listings.names(got, "name").collect()] == ["A"]
    old = spark.createDataFrame([("d1", "f1", 5), ("d2", "f2", 6)], "drive_id string, file_id string, size long")
    new = spark.createDataFrame([("d1", "f3", None)], "drive_id string, file_id string, size long")
    assert sorted(map(tuple, listings.replace_drive(old, new).collect())) == [("d1", "f3", 0), ("d2", "f2", 6)]
    folders = spark.createDataFrame([("1", "a", "r"), ("2", "b", "1"), ("3", "c", "2"), ("4", "z", "x")], "id string, name string, parent_id string")
    assert {r.rel_dir for r in listings.tree_below(folders, "r").collect()} == {"a", "a/b", "a/b/c"}
    assert {r.rel_dir for r in listings.tree_below(folders, "r", depth=2).collect()} == {"a", "a/b"}


def test_streams_go_on_where_they_ended(spark, tmp_path):
    schema = "path string, hash string, size long, mtime double"
    for rows in ([("a", "h", 3, 1.0), ("b", "h", 3, 1.0)], [("c", "h", 3, 1.0), ("a", "h", 3, 1.0), ("d", "k", 1, 1.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        live.running_groups(live.arriving(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out", f"{tmp_path}/s1").awaitTermination()
    assert [tuple(r) for r in live.groups_so_far(spark, f"{tmp_path}/out").collect()] == [("h", 3, 4, 9)]


def test_a_hashing_stream_keeps_what_it_hashed_as_state(spark, tmp_path):
    schema, read, dies = "path string, size long, mtime double", [], []
    index = logstore.Store(spark, f"file://{tmp_path}/index")

    def hashes(rows):
        found = rows.collect()
        if dies:
            raise OSError(dies.pop())
        read.append(sorted(r.path for r in found))
        return spark.createDataFrame(found, rows.schema).withColumn("md5", F.md5(F.concat("path", F.col("size").cast("string")).cast("binary")))

    def run():
        stream = live.index_new(live.arriving(spark, f"{tmp_path}/in", schema, files_per_batch=1), index, f"{tmp_path}/state", hashes)
        stream.awaitTermination()

    first = [(f"/p/{k:04d}", k, 1.0) for k in range(700)]
    live.enqueue(spark.createDataFrame(first, schema).coalesce(1), f"{tmp_path}/in", batch=300)
    run()
    assert sorted(map(len, read)) == [100, 300, 300]
    want = {p: s for p, s, _ in first}
    assert {r.path: r["size"] for r in index.read().collect()} == want
    # a second run: known rows, changed ones and new ones; the index's rows can't be read meanwhile
    os.rename(tmp_path / "index" / "data", tmp_path / "index" / "away")
    (tmp_path / "index" / "data").mkdir()
    more = [*first[:50], ("/p/0007", 7, 2.0), ("/p/0008", 9, 1.0), ("/q", 1, 1.0)]
    live.enqueue(spark.createDataFrame(more, schema).coalesce(1), f"{tmp_path}/in")
    dies.append("lost")
    try:
        run()
        raise AssertionError("the batch was to die")
    except StreamingQueryException:
        pass
    read.clear()
    run()  # the same batch again
    assert read == [["/p/0007", "/p/0008", "/q"]]
    for part in (tmp_path / "index" / "away").iterdir():
        os.rename(part, tmp_path / "index" / "data" / part.name)
    want |= {"/p/0008": 9, "/q": 1}
    assert {r.path: r["size"] for r in index.read().collect()} == want and index.read().count() == len(want)


def test_template_elements(spark):
    from fileloom.functions.names import compiled_template, template_elements

    rows = [("{date}_{category}-x {y}{Z}.{ext}.{ext}", "_"), ("{date}--{a}", "--"), ("{", "_"), ("", "_"), (None, "_"), ("a{b\n}_", "_"), ("{x}_", None)]
    df = spark.createDataFrame(rows, "t string, sep string").select("t", "sep", template_elements("t", "sep").alias("e"))
    got = {r.t: ([tuple(x) for x in r.e] if r.e is not None else None, r.c) for r in df.withColumn("c", compiled_template("e", F.lit("+"))).collect()}
    assert got["{date}_{category}-x {y}{Z}.{ext}.{ext}"] == ([("token", "{date}"), ("sep", "_"), ("token", "{category}"), ("literal", "-x "), ("token", "{y}"), ("literal", "{Z}")], "{date}+{category}-x {y}{Z}.{ext}")
    assert got["{date}--{a}"] == ([("token", "{date}"), ("sep", "--"), ("token", "{a}")], "{date}+{a}.{ext}")
    assert got["{"] == ([("literal", "{")], "{.{ext}") and got[""] == ([], ".{ext}") and got[None] == (None, None)
    assert got["a{b\n}_"][0] == [("literal", "a{b\n}_")] and got["{x}_"][0] == [("token", "{x}"), ("literal", "_")]


def test_choices(spark, tmp_path):
    import pytest

    from fileloom.operators.settings import Choices

    keys = spark.createDataFrame([("a", "ENV_A", "d1"), ("b", "ENV_B", "d2"), ("c", "ENV_C", "d3")], "key string, env_var string, default string")
    choices = Choices(logstore.Store(spark, f"file://{tmp_path}/s"), keys)
    now = lambda: {r.key: (r.value, r.is_custom) for r in choices.effective({"ENV_B": "e", "ENV_C": ""}).collect()}
    assert now() == {"a": ("d1", False), "b": ("e", False), "c": ("d3", False)}
    put = lambda *rows: choices.put(spark.createDataFrame(list(rows), "key string, value string, seq int"))
    put(("b", "x", 1), ("b", "y", 2), ("c", "z", 1))
    assert now() == {"a": ("d1", False), "b": ("y", True), "c": ("z", True)}
    put(("b", "", 1), ("c", None, 1))
    assert now()["b"] == ("e", False) and now()["c"] == ("d3", False)
    with pytest.raises(KeyError):
        put(("nope", "x", 1))
