"""The training-data queries that SQL can express, against DuckDB on the same tables."""

import pytest

import __spark_entry__ as E
from captionflow.llm.oracle_sql import ORACLE
from tests.oracle_check import check, duck


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, sf_small, name):
    ok, n = check(spark, name, E.queries()[name], E.oracle_sql()[name], sf_small, duck(sf_small), verbose=True)
    assert ok and n > 0
