"""Every catalog query next to its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from compare import difference, duck

from siftwall.catalog import QUERIES
from siftwall.oracle import SQL

SF = "/root/testdata/sf0.001"

@pytest.fixture(scope="module")
def connection():
    return duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, name):
    assert difference(QUERIES[name](spark, SF), connection.sql(SQL[name])) is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
