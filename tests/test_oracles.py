"""Every registered query against its SQL on the smallest tables."""

import pytest

from formbook.catalog import load
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(load()[0]))
def test_query(spark, con, name):
    queries, oracles = load()
    problem = compare(spark, FOLDER, name, queries[name], oracles.get(name), con)
    # A rule that finds nothing in the smallest tables is still equal.
    assert problem in (None, "no rows on either side"), problem


def test_every_oracle_has_a_query():
    queries, oracles = load()
    assert set(oracles) <= set(queries)
