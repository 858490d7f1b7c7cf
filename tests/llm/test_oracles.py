"""The queries that SQL can state, against DuckDB."""

import duckdb
import pytest

from flowkit.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    expected = sorted((tuple(sorted(zip(names, r, strict=True))) for r in found.fetchall()), key=repr)
    got = sorted((tuple(sorted(r.asDict().items())) for r in queries.QUERIES[name](spark, SF).collect()), key=repr)
    assert got == expected and got
