"""Every registered particle query against its SQL, run by DuckDB on the same small tables."""

import math
from pathlib import Path

import duckdb
import pytest

from motefield.plans import catalogue

SMALL = Path("/root/testdata/sf0.001")


def told(value):
    """One value as text that both engines agree on."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 5) + 0.0)
    return str(value)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(SMALL.glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, tables, name):
    found = catalogue.QUERIES[name](spark, str(SMALL))
    columns = sorted(found.columns)
    result = tables.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(told(row[names.index(c)]) for c in columns) for row in result.fetchall())
    assert sorted(tuple(told(v) for v in row) for row in found.select(*columns).collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_repeats_itself(spark, name):
    first, again = (sorted(map(str, catalogue.QUERIES[name](spark, str(SMALL)).collect())) for _ in range(2))
    assert first and first == again
