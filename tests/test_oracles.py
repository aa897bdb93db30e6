import pytest
from oracle_check import connect, mismatch

from __spark_entry__ import entry, oracle_sql, queries
from nearwise.plans.table_queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_of_the_library_has_an_oracle():
    assert set(QUERIES) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert mismatch(queries()[name](spark, SF_DIR), oracle_sql()[name], con) is None


def test_entry(spark):
    assert entry(spark).count() > 0
