"""Every query with SQL against DuckDB, as the driver compares them."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from stratagraph.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def larger():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(norm(r[i]) for i in order) for r in rows], key=repr), [columns[i] for i in order]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, sf, name):
    df = registry.queries()[name](spark, sf)
    got, columns = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(SQL[name])
    want, expected = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    assert columns == expected
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() >= 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_has_rows(larger, name):
    """Two empty tables are equal whatever the query does."""
    assert larger.execute(f"SELECT count(*) FROM ({SQL[name].rstrip().rstrip(';')}) AS x").fetchone()[0] > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
