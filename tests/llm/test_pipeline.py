"""The pipeline's stages: what each keeps, and its columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fileloom.llm.queries import table
from fileloom.llm.shared import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    docs, out = table(spark, SF, "documents"), {}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, before, SF), name)
        out[name] = (before, after)
        before = after
    return out


def test_stages_take_effect(spark, results):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "decontamination", "mixture", "token_ids"]
    for name in names[:-1]:
        before, after = results[name]
        assert after.columns == before.columns
        assert after.exceptAll(before).count() == 0 or name == "mixture"
    before, after = results["near_duplicates"]
    assert 0 < after.count() < before.count()
    assert results["mixture"][1].select("doc_id").distinct().count() == results["mixture"][0].count()
    before, after = results["token_ids"]
    assert after.count() == before.count()
    last = after.orderBy(F.desc("start")).first()
    assert last.start + last.n_tokens == after.agg(F.sum("n_tokens")).first()[0]


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
    assert docs.count() == 0


def test_awkward_rows(spark, docs, texts):
    """Null columns, repeated rows, clashing names, empty and very long texts, in every stage."""
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, before, SF), name)
        if name != "token_ids":
            assert after.columns == docs.columns
            assert after.select("doc_id", "text").distinct().exceptAll(docs.select("doc_id", "text").distinct()).count() == 0
        before, last = after, before
    assert before.count() == last.count() > 0
    kept = {r.doc_id for r in last.select("doc_id").collect()}
    assert not kept & {100, 101, 102, 113} and 107 in kept
