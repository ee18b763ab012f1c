"""Every registered query equals its SQL statement on the smallest tables."""

import pytest

import __spark_entry__ as contract
from tidewatch.catalog.oracle import ORACLE
from tidewatch.catalog.queries import QUERIES
from tests.compare import database, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    assert difference(contract.queries()[name](spark, FOLDER), con,
                      contract.oracle_sql()[name]) is None
