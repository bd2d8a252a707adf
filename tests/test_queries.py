"""Every registered query against its SQL, on the smallest test data."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import difference, duck

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, connection, name):
    df = queries()[name](spark, SF_DIR)
    if name in oracle_sql():
        assert difference(df, connection, oracle_sql()[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry(spark).count() > 0
