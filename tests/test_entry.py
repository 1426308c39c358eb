"""The driver contract: entry(), and every query against its oracle at sf0.001."""
import pytest

import __spark_entry__ as E
from tests.oracle_harness import compare, duck


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "status" in df.columns


def test_keys_match():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def con(sf_small):
    return duck(sf_small)


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_matches_oracle(spark, sf_small, con, name):
    r = compare(spark, name, E.queries()[name], E.oracle_sql().get(name), sf_small, con)
    assert r["status"] in ("OK", "rows-only"), r
