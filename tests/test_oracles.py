"""Every registered query against its SQL, or for rows, at the smallest scale."""

import pytest

from tests.oracle_check import difference
from trackframe import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.load()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert difference(spark, SF, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() == 1


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
