"""Every registered query against its SQL, over whole tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect

from parley.plans import registry

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
ORACLES = registry.ORACLES
# Sessions with random ids and other queries SQL cannot state would be listed here.
UNCHECKED = set(registry.QUERIES) - set(ORACLES)


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    ok, rows, message = compare(spark, duck, FOLDER, registry.QUERIES[name], ORACLES[name])
    assert ok, message
    assert rows > 0


def test_every_query_has_sql():
    assert UNCHECKED == set()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_entry_has_all_queries():
    assert set(registry.QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
