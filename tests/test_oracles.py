"""Every query with a DuckDB twin gives the same rows at the smallest size; the others give rows."""

import decimal
import math

import duckdb
import pytest

from quillon import catalog, tables

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, decimal.Decimal):
        return f"decimal {v}"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return [plain(x) for x in v] if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in tables.NAMES:
        c.sql(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    rows = df.collect()
    columns = sorted(df.columns)
    assert len(set(columns)) == len(columns)
    oracle = catalog.oracles().get(name)
    if not oracle:
        return
    other = duck.sql(oracle)
    assert sorted(other.columns) == columns
    at = [other.columns.index(c) for c in columns]
    assert sorted(str([plain(r[c]) for c in columns]) for r in rows) == sorted(str([plain(r[i]) for i in at]) for r in other.fetchall())
