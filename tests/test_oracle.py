"""Every registered query against its DuckDB oracle on the smallest fixture."""

import pytest

import __spark_entry__ as entry
from tidemark.testing import oracle, queries
from tidemark.testing.compare import compare, duckdb_connection
from tidemark.testing.params import SF_SMALL


NAMES = sorted(queries.registry())


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(queries.registry()) == set(oracle.oracle_sql())
    assert set(NAMES) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(entry.queries()[name](spark, SF_SMALL), con, entry.oracle_sql()[name])
    assert r["columns_match"], (r["spark_columns"], r["oracle_columns"])
    assert r["rows_spark"] == r["rows_oracle"]
    assert r["values_match"], r["diff_example"]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns[0] == "type" and len(rows) == 2
