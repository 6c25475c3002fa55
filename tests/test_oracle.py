"""Every query against its SQL on the same tables."""

import pytest
from compare import connect, differences

from headersieve.plans.oracle import ORACLE_SQL
from headersieve.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, spark, con, sf_dir):
    assert differences(spark, con, QUERIES[name], ORACLE_SQL[name], sf_dir) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_gives_rows(name, spark, sf_dir):
    assert not QUERIES[name](spark, sf_dir).isEmpty()


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
