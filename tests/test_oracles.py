"""Every registered query of the reference's operators against its SQL in DuckDB."""

import decimal
from pathlib import Path

import duckdb
import pytest

from webloom.plans import registry


def plain(v):
    return float(v) if isinstance(v, decimal.Decimal) else round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def engine(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).iterdir():
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, engine, name):
    df = registry.queries()[name](spark, sf_dir)
    expected = engine.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    assert got == sorted((tuple(map(plain, r)) for r in expected.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)


def test_queries_without_sql_give_rows(spark, sf_dir):
    for name in set(registry.queries()) - set(registry.oracle_sql()):
        assert registry.queries()[name](spark, sf_dir).columns
