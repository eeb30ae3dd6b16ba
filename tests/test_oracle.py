"""Every registered query against its DuckDB oracle (order-free, floats to 6
places) on the smallest test tables; queries without an oracle must run."""

import pytest

import __spark_entry__ as E
from captionflow.plans import registry
from tests.oracle_check import check, duck

QUERIES = registry.queries()  # those of the optional subpackage have tests of their own
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_small):
    return duck(sf_small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, sf_small, con, name):
    ok, n = check(spark, name, QUERIES[name], ORACLE.get(name), sf_small, con, verbose=True)
    assert ok, name


def test_every_query_has_an_oracle():
    assert sorted(set(QUERIES) - set(ORACLE)) == []


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["video_id", "seg", "start_ts", "keywords"]
    assert df.count() > 0
