"""Groups that are brought up to date from what has changed."""

import random

from pyspark.sql import functions as F

from fileloom.operators import keepers, maintained
from fileloom.operators.keepers import KeeperRule
from fileloom.operators.logstore import Store

FILES = "path string, md5 string, size long, mtime double, folder string, source string"


def rows(n=600):
    rng = random.Random(4)
    out = []
    for i in range(n):
        folder, size = rng.choice(["organized", "snapshot"]), i % 40 + 1
        out.append((f"/{folder}/s{i % 5}/f{i}.txt", f"m{size}" if i % 3 else f"u{i}", size, float(i), folder, f"s{i % 5}"))
    return [*out, ("/organized/null", None, 1, 1.0, "organized", "s0")]


def test_only_changed_contents_are_computed_again(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/files").write(spark.createDataFrame(rows(), FILES))
    store.upsert(spark.createDataFrame([], FILES + ", seq int"), "path")
    view, rule = maintained.MaintainedGroups(store, f"file://{tmp_path}/view"), KeeperRule()
    seen = []
    made = keepers.marked
    monkeypatch.setattr(maintained.keepers, "marked", lambda files, *a, **k: (seen.append({r.md5 for r in files.select("md5").distinct().collect()}), made(files, *a, **k))[1])

    def right(took):
        seen.clear()
        assert view.refresh(rule) == took
        whole = made(store.read(), rule)
        assert sorted(map(tuple, view.view.read().select("md5", "keeper", "redundant_count", "reclaim", "cross_folder", "ambiguous").collect())) == sorted(map(tuple, keepers.groups(whole).select("md5", "keeper", "redundant_count", "reclaim", "cross_folder", "ambiguous").collect()))

    right("whole")
    right("nothing")
    assert not seen
    # one in a hundred files: another content, a new path, and a content that comes to have copies
    some = spark.createDataFrame(rows(), FILES).filter("path like '%7.txt' and size = 8").withColumn("md5", F.lit("m3"))
    new = spark.createDataFrame([("/snapshot/s9/u", "u0", 1, 1.0, "snapshot", "s9")], FILES)
    store.upsert(some.unionByName(new).withColumn("seq", F.lit(1)), "path")
    right("changed")
    assert seen == [{"m3", "u0"}]  # what had size 8 has no copy left
    # a purge and its undo
    gone = spark.createDataFrame(rows(), FILES).filter("md5 in ('m5', 'm6') and folder = 'snapshot'")
    store.delete(gone.select("path"))
    right("changed")
    assert seen == [{"m5", "m6"}]
    store.upsert(gone.withColumn("seq", F.lit(1)), "path")
    right("changed")
    store.compact(ranges=3)
    right("changed")  # a compaction changes no row
    assert seen == [set()]
    rule = KeeperRule(prefer_folder="snapshot")
    right("whole")
    store.write(spark.createDataFrame(rows(100), FILES))
    right("whole")
