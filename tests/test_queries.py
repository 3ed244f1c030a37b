"""Every registered query against its SQL twin, or at least for rows."""

import pytest

import __spark_entry__ as contract
from tests import compare

QUERIES, ORACLE = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return compare.connect(folder)


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_twin(spark, folder, con, name):
    assert compare.difference(QUERIES[name](spark, folder), con, ORACLE[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_has_rows(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 100 and {"building_id", "day", "mae"} <= set(df.columns)
