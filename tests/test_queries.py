"""Every registered query runs and equals its oracle at the smallest scale."""

from pathlib import Path

import pytest
from check_oracle import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLE = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE:
        problem, _ = compare(df, con, ORACLE[name])
        assert problem is None, problem
    else:
        df.collect()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
