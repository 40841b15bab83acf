"""Every registered query against its SQL twin, at the smallest scale."""

import pytest

from anomaloom.plans.catalog import QUERIES, SQL
from compare import connect, differences


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


def test_sql_twins_have_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, sf_dir, name):
    if name in SQL:
        assert differences(spark, connection, QUERIES[name], SQL[name], sf_dir) == ""
    else:
        assert QUERIES[name](spark, sf_dir).count() > 0
