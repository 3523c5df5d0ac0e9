"""Every registered query against its SQL, on the small tables."""

import os

import pytest
from conftest import DATA
from oracle import compare, connect

from tabkit.plans import QUERIES

SF_DIR = os.environ.get("TABKIT_SF_DIR", DATA)


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    q = QUERIES[name]
    df = q.run(spark, SF_DIR)
    if q.sql is None:
        assert df.count() > 0
    else:
        problem = compare(df, con, q.sql)
        assert problem is None, problem


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
