"""Every registered query with an SQL oracle matches DuckDB on sf0.001
(the driver repeats this at sf0.01)."""

import pytest

import __spark_entry__ as entry
from oracle_util import compare
from conftest import SF_SMALL

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, name):
    problems, rows, _ = compare(spark, name, SF_SMALL, QUERIES, ORACLES)
    assert not problems, problems


def test_every_query_has_ops():
    from kairos.registry import REGISTRY
    assert all(q.ops for q in REGISTRY.values())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["ticker", "dt", "close", "drawdown_pct", "drawdown_percentile", "signal_1"]
    assert 0 < len(rows) <= 20
