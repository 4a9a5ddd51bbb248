"""Every registered query that has a SQL twin gives the twin's rows, on whole tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = os.environ.get("FLOWLAB_SF_DIR", "/root/testdata/sf0.001")
QUERIES, TWINS = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_twin_has_a_query():
    assert set(TWINS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_equals_sql(spark, con, name):
    problems, n = compare(spark, con, SF, QUERIES[name], TWINS[name])
    assert not problems and n > 0


def test_flagship(spark):
    assert entry.entry(spark).count() == 12
