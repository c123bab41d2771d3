import pytest

from tests.oracle import compare
from tidemark.plans import catalog


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_sql(spark, name):
    assert compare(spark, catalog.QUERIES[name], catalog.ORACLES[name]) > 0
