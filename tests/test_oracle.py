"""Every registered query with SQL gives DuckDB's rows; the others give rows."""

from __future__ import annotations

import pytest
from loomery.plans import catalogue
from oracle import compare

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, small, name):
    differs, n = compare(spark, QUERIES[name], SQL[name], small)
    assert not differs
    assert n > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.queries()) >= set(QUERIES)
    assert e.entry(spark).count() > 0
