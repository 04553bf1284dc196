"""Every registered query of the library against its SQL on whole tables."""

import os

import pytest

from fileloom.plans import registry

from .oracle import of_duckdb, of_spark

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = of_spark(registry.QUERIES[name](spark, SF))
    if name in registry.SQL:
        want = of_duckdb(registry.SQL[name], SF)
        assert got[0] == want[0]
        assert len(got[1]) == len(want[1])
        assert got[1] == want[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
