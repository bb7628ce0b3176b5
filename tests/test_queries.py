"""Every registered query runs, and equals its SQL where it has one."""

import pytest
from checking import connect, differences

import __spark_entry__ as driver

QUERIES, CHECKS = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def other_engine(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, other_engine, name):
    if name in CHECKS:
        assert differences(spark, data, QUERIES[name], CHECKS[name], other_engine) is None
    else:
        assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    df = driver.entry(spark)
    assert df.count() > 0 and "flows" in df.columns


def test_checks_name_only_queries():
    assert set(CHECKS) <= set(QUERIES)
