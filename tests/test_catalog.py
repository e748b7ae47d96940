"""Every registered query against its SQL, run by another engine on the same files."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def comparable(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)):
        return (2, repr(float(value)))
    return (3, str(value))


def as_bag(rows, columns):
    return sorted(tuple(comparable(row[c]) for c in sorted(columns)) for row in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, sf_dir, db):
    df = QUERIES[name](spark, sf_dir)
    got = as_bag(df.collect(), df.columns)
    result = db.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    wanted = as_bag([dict(zip(columns, row)) for row in result.fetchall()], columns)
    assert got == wanted


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert rows
    assert not [r for r in rows if "error" in df.columns and r["error"] is not None]


def test_entry(spark):
    assert contract.entry(spark).columns == ["code", "lat", "lon", "total_flights"]
