"""Queries use all of their input, beside brute force on small tables."""

import re

import pytest
from pyspark.sql import functions as F

from fileloom.operators import drives
from fileloom.plans import registry


@pytest.fixture()
def long_texts(spark, tmp_path):
    texts = ["one two, three. " * 60 + "the very last", "none " * 200 + "50%_ here", "short. end", "", None]
    spark.createDataFrame([(3 * k + 1, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k,) for k in range(50)], "conv_id long").write.parquet(f"{tmp_path}/conversations.parquet")
    return texts, str(tmp_path)


def test_sentences_take_whole_texts(spark, long_texts):
    texts, folder = long_texts
    want = []
    for k, t in enumerate(texts):
        for part in (t or "").split("."):
            words = re.findall(r"[^\W\d_]+|,", part)
            if words:
                want.append((3 * k + 1, " ".join(words).replace(" ,", ",")))
    got = registry.QUERIES["ag21_sentences"](spark, folder).collect()
    assert sorted((r.file_id, r.text.strip(" .")) for r in got if r.text.strip(" .")) == sorted(want)


def test_visual_search_looks_at_whole_texts(spark, long_texts):
    texts, folder = long_texts
    got = registry.QUERIES["jn21_visual_search"](spark, folder).collect()
    assert [(r.file_id, r.timestamp) for r in got] == [(3 * k + 1, (3 * k + 1) * 2.5) for k, t in enumerate(texts) if "50%_" in (t or "")]


def test_paths_take_every_document(spark, tmp_path):
    spark.range(700).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    parent = {k: None if k % 40 == 1 or k == 0 else k // 7 for k in range(700)}

    def way(k):
        return [*(way(parent[k]) if parent[k] is not None else []), f"f{k}"]

    got = registry.QUERIES["jn25_paths"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted((f"n{k}", "/".join(way(k)), len(way(k))) for k in parent)


def test_paths_go_below_64_levels(spark):
    chain = [(f"c{k}", f"c{k - 1}" if k else "", str(k)) for k in range(70)]
    nodes = spark.createDataFrame([*chain, ("x", "y", "x"), ("y", "x", "y")], "id string, parent string, name string").coalesce(1)
    got = {r.id: (r.rel_path, r.depth) for r in drives.paths(nodes).collect()}
    assert got == {f"c{k}": ("/".join(map(str, range(k + 1))), k + 1) for k in range(70)}


def test_paths_name_a_cycle_below_a_root(spark):
    nodes = spark.createDataFrame([("a", "", "a"), ("a", "b", "a"), ("b", "a", "b")], "id string, parent string, name string")
    with pytest.raises(ValueError, match="cycle"):
        drives.paths(nodes).collect()


def test_throughput_has_every_user(spark, tmp_path):
    some = [(k, k % 60, 1_700_000_000 + 7 * k, float(k)) for k in range(180)]
    events = spark.createDataFrame(some, "event_id long, user_id long, t long, value double")
    events.selectExpr("event_id", "user_id", "timestamp_seconds(t) as ts", "value").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.rate for r in registry.QUERIES["fn53_throughput"](spark, str(tmp_path)).collect()}
    # without an event before it, greatest() leaves one second
    assert got == {k: round(v / (420 if k >= 60 else 1), 6) for k, _, _, v in some}


def test_a_chain_takes_few_joins(spark, monkeypatch):
    made = []
    keep = drives.stored
    monkeypatch.setattr(drives, "stored", lambda df, kind: made.append(kind) or keep(df, kind))
    n = 3000
    nodes = spark.range(n).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent"), F.lit("n").alias("name"))
    got = drives.paths(nodes).agg(F.count("*"), F.sum("depth"), F.max(F.length("rel_path"))).first()
    assert tuple(got) == (n, n * (n + 1) // 2, 2 * n - 1) and len(made) <= 14
