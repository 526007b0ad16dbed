"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import pytest

from tests.oracle import connect, both
from weftline.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    mine, theirs = both(spark, con, registry.queries()[name], registry.oracle_sql()[name], SF)
    assert mine[0] == theirs[0]
    assert len(mine[1]) == len(theirs[1])
    assert mine[1] == theirs[1]


def test_every_twin_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
