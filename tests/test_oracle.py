"""Every registered query with an oracle must equal its DuckDB statement (sf0.001, order-insensitive)."""

import pytest

import __spark_entry__ as entry
from tools.oracle_check import compare, duck

ORACLE = entry.oracle_sql()
QUERIES = entry.queries()
KEYS = sorted(k for k in QUERIES if k in ORACLE)


@pytest.fixture(scope="module")
def con(sf_small):
    return duck(sf_small)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, sf_small, key):
    msg, ok = compare(spark, con, key, QUERIES[key], ORACLE[key], sf_small)
    assert ok, msg


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert df.columns == ["bet_type", "bets", "handle", "gross_profit", "net_profit", "hold_pct"]


def test_every_query_has_a_callable():
    assert len(QUERIES) >= 90
    assert all(callable(v) for v in QUERIES.values())
