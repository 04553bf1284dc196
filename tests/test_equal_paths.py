"""Queries on files of which several have one path, against their SQL."""

import pytest

from fileloom.plans import registry

from .oracle import of_duckdb, of_spark

NAMES = (
    "ag06_keeper_summary ag19_folder_analysis jn01_blueprint_match jn13_relocated jn36_overrides prj22_preview prj27_group_filter snk01_upsert snk02_merged_stores "
    "snk04_index_upsert snk06_ledger_upsert snk17_copy_plan src05_hash_passes st08_maintained_groups wn01_keepers wn07_one_keeper_each wn12_all_but_first wn14_all_but_keeper"
).split()


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """Sixteen copies of each text, four of them in one source: the third and on have one path."""
    folder = str(tmp_path_factory.mktemp("copies"))
    texts = [f"text {k % 15} of many copies. " * (20 + k % 15) for k in range(240)]
    rows = [(k, t, "en", f"src{k // 60}", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/made")
    import glob
    import os

    os.rename(glob.glob(f"{folder}/made/*.parquet")[0], f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_files_of_one_path_are_told_apart(spark, copies, name):
    assert of_spark(registry.QUERIES[name](spark, copies)) == of_duckdb(registry.SQL[name], copies)


@pytest.fixture(scope="module")
def cut_numbers(spark, tmp_path_factory):
    """Documents of five and six digits, whose names, cut to five, repeat within a source; texts
    recur within a name, between names, and on one side alone."""
    import glob
    import os

    folder = str(tmp_path_factory.mktemp("cut"))
    ids = [*range(10_000, 10_200), *(k * 10 + d for k in range(10_000, 10_200) for d in (0, 1, 3, 4)), *(k * 100 + 14 for k in range(10_000, 10_200, 2))]
    rows = [(k, f"text {k % 50 if k % 3 else k} of its own. " * (5 + k % 4), "en", f"src{int(str(k)[:5]) % 3}") for k in ids]
    rows = [(k, t, lang, source, len(t)) for k, t, lang, source in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/made")
    os.rename(glob.glob(f"{folder}/made/*.parquet")[0], f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", ["ag24_action_counts", "q20_delta_report"])
def test_decisions_on_paths_that_repeat(spark, cut_numbers, name):
    assert of_spark(registry.QUERIES[name](spark, cut_numbers)) == of_duckdb(registry.SQL[name], cut_numbers)


@pytest.mark.parametrize("name", ["snk03_refresh", "snk11_quarantine_plan", "src06_path_list"])
def test_states_and_moves_of_files_of_one_path(spark, copies, name):
    assert of_spark(registry.QUERIES[name](spark, copies)) == of_duckdb(registry.SQL[name], copies)
