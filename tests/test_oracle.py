"""Every named query against its SQL on the smallest test tables."""

import pytest

from __spark_entry__ import entry
from brookmart.plans.catalog import all_queries as queries
from brookmart.plans.oracle import all_sql as oracle_sql
from tests.oracle_check import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_same_names():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    problem = difference(spark, con, queries()[name], oracle_sql()[name], SF_DIR)
    assert problem in (None, "both empty"), problem


def test_entry(spark):
    assert entry(spark).count() > 0
