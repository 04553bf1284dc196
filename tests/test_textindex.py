"""Index searches against scans."""

import random

import pytest
from pyspark.sql import functions as F

from fileloom.operators import media, textindex


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(8)
    words = ["the", "The", "river", "of", "stone", "Éa", "x1", "rare", *(f"w{i}" for i in range(300))]
    rows = [(i * 7 - 500, " ".join(rng.choice(words[: rng.choice([4, 8, 300])]) for _ in range(rng.randrange(0, 60)))) for i in range(3000)]
    rows += [(90_000, None), (90_001, ""), (90_002, "100%_off A"), (90_003, "a\nb the\triver"), (90_004, "the river " * 5000)]
    return spark.createDataFrame(rows, "id long, text string").repartition(5).cache()


@pytest.fixture(scope="module")
def index(texts, tmp_path_factory):
    return textindex.TextIndex.built(texts, f"file://{tmp_path_factory.mktemp('index')}")


@pytest.mark.parametrize("query", ["the river", "the", "éa stone", "rare w7 the", "w1 w2", "nothing the", "the the", "x1", "off"])
@pytest.mark.parametrize("limit", [5, 40, None])
def test_full_text_equals_a_scan(texts, index, query, limit):
    got, want = (sorted(map(tuple, df.collect())) for df in (index.full_text(query, limit), media.full_text(texts, query, limit)))
    assert got == want


def test_no_query(index):
    assert index.full_text(" ", 5).count() == 0


@pytest.mark.parametrize("query", ["river of", "RIVER", "éA", "w29", "0%_o", "%", "he r", "b the\tri", "absent!"])
def test_like_equals_a_scan(texts, index, query):
    assert sorted(r.id for r in index.like(texts, query).collect()) == sorted(r.id for r in texts.filter(media.like("text", query)).collect())


def test_a_search_reads_its_own_lists(spark, texts, index, capsys):
    every = spark.read.parquet(f"{index.folder}/words")
    own = index.lists(["w7", "rare"])
    assert own.count() == every.filter("word in ('w7', 'rare')").count() < every.count() / 30
    assert every.agg(F.sum("n")).first()[0] == texts.select("id", F.explode(media.terms("text")).alias("w")).distinct().count()
    own.explain("formatted")
    plan = capsys.readouterr().out
    assert "In(word, [rare,w7])" in plan
    # the postings of a frequent word lie in several blocks, which no task has alone
    assert every.filter("word = 'the'").count() > 8 and every.agg(F.max("n")).first()[0] <= textindex.BLOCK
    assert index.holding("w29").count() < 1000 and index.holding("w2") is None


def test_runs_leave_a_task_as_lists():
    import pyarrow as pa

    texts = {7: "the then", 3: "a😀é the", 5: "th", 9: ""}
    batch = pa.RecordBatch.from_arrays([pa.array(list(texts), pa.int64()), pa.array(list(texts.values()))], names=["id", "low"])
    blocks = [r for b in textindex._parts(iter([batch] * 2)) for r in b.to_pylist()]
    want = {t[k : k + 3] for t in texts.values() for k in range(len(t) - 2)}
    assert {r["word"] for r in blocks} == want and len(blocks) == len(want)
    assert {(r["first"], r["last"], r["n"], tuple(r["gaps"])) for r in blocks if r["word"] == "the"} == {(3, 7, 4, (0, 0, 4, 0))}
