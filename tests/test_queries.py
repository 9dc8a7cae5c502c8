"""Every query with SQL against DuckDB, every other one for rows, on the smallest tables."""

from __future__ import annotations

import pytest

from caseforge import catalog

from .conftest import SMALL, tidy


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    ours = tidy(catalog.QUERIES[name](spark, SMALL).toPandas())
    theirs = tidy(duck.sql(catalog.ORACLES[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    assert len(ours) == len(theirs)
    assert ours.equals(theirs), ours.compare(theirs).head()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
