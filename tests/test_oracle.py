"""Every query of the library against its DuckDB oracle at sf0.01 (the driver's gate)."""

import pytest

import __spark_entry__ as E
from rubricon.plans.catalog import QUERIES
from rubricon.plans.compare import compare
from rubricon.plans.oracle import SQL

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, key):
    r = compare(QUERIES[key](spark, SF), SQL[key], SF)
    assert r["columns_match"], r
    assert r["rows_spark"] == r["rows_oracle"], r
    assert r["values_match"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert [f.name for f in df.schema.fields] == ["lang", "metric", "value"]


def test_every_query_has_oracle_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())
