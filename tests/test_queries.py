"""Every registered query with SQL gives the rows of its SQL."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_its_sql(spark, duck, name):
    verdict = compare(spark, duck, FOLDER, queries()[name], SQL[name])
    assert verdict.startswith("ok"), verdict


def test_names_match():
    assert set(SQL) <= set(queries())


def test_flagship(spark):
    assert entry(spark).count() == 127
