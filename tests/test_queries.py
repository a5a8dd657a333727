"""Every query gives rows, and those with SQL the same rows as DuckDB."""

from __future__ import annotations

import pytest
from conftest import SF, same_rows

from cellweave.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_like_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_columns_and_rows(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert df.columns and rows


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
