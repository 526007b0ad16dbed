"""The operators with SQL give DuckDB's rows over whole tables."""

import pytest

from tests.oracle import both, connect
from weftline.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_operator_matches_oracle(spark, name):
    mine, theirs = both(spark, connect(SF), registry.queries()[name], registry.oracle_sql()[name], SF)
    assert mine == theirs
