"""Every registered query that has SQL gives the same table on DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from isotherma.plans import CATALOG
from tools.check import TABLES, canon

from .conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(n for n, q in CATALOG.items() if q.sql is not None))
def test_matches_sql(spark, duck, name):
    df = CATALOG[name].run(spark, SMALL)
    cols = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    rel = duck.sql(entry_points.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    order = [rel.columns.index(c) for c in cols]
    assert got == sorted(tuple(canon(r[i]) for i in order) for r in rel.fetchall())


def test_entry_runs(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
