"""Every query of the library against its SQL, run by DuckDB on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from flowkit.queries import operations, relational, transforms

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = transforms.QUERIES | relational.QUERIES | operations.QUERIES
ORACLES = transforms.ORACLE_SQL | relational.ORACLE_SQL | operations.ORACLE_SQL
MAY_BE_EMPTY = {"sql_scalar_subquery", "set_except"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float) and not isinstance(v, bool):
        return "nan" if math.isnan(v) else float(f"{v:.12g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v.isoformat() if isinstance(v, datetime.date) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect()), key=repr)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    expected = sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
    assert columns == sorted(names)
    assert got == expected
    assert got or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
