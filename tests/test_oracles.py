"""Every query with an SQL oracle, on the smallest tables."""

from __future__ import annotations

import pytest
from __spark_entry__ import entry, oracle_sql, queries
from tools.check_oracles import compare, connect

FOLDER = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert compare(queries()[name](spark, FOLDER), duck, SQL[name]) is None


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(queries())
