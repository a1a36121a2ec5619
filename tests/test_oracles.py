"""Every registered query against its DuckDB statement on the smallest data folder."""

import catalog
import pytest
from tests.compare import compare

catalog.load()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, folder, name):
    ok, note = compare(spark, folder, catalog.QUERIES[name], catalog.ORACLES.get(name))
    assert ok, note


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
