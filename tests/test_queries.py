"""Every query with SQL gives the same rows as the SQL on the smallest tables; the others give rows of a stable schema."""

import pytest

from evigraph.plans import registry

from .oracle import differences, views


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, sf, name):
    assert differences(registry.QUERIES[name](spark, sf), views(sf), registry.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0
