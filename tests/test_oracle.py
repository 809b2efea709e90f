"""Every registered query against its DuckDB oracle (or a rows-only run when it has none)."""

import pytest

import __spark_entry__ as E
from shelfwise.plans import registry
from tools.check_oracle import compare

QUERIES = E.queries()
ORACLES = E.oracle_sql()
REGISTERED, REGISTERED_ORACLES = registry.QUERIES, registry.ORACLES


def test_every_query_has_an_oracle_or_is_documented():
    missing = sorted(set(REGISTERED) - set(REGISTERED_ORACLES))
    assert missing == [], missing


def test_entry_returns_rows(spark):
    df = E.entry(spark)
    assert df.columns == ["function_id", "name", "usecase", "keywords", "username", "average"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(REGISTERED))
def test_query_matches_oracle(spark, duck, sf_dir, name):
    line, ok = compare(spark, duck, name, QUERIES[name], ORACLES.get(name), sf_dir)
    assert ok, line
