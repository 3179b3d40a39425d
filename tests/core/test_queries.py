"""Every query with SQL against DuckDB on the smallest tables, where they are at hand."""

import decimal
from pathlib import Path

import pytest

from manloom import queries

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 9) if isinstance(v, float) else float(v) if isinstance(v, decimal.Decimal) else v


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_like_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, str(SF))
    columns = sorted(df.columns)
    other = con.sql(queries.oracle_sql()[name])
    assert columns == sorted(other.columns)
    key = lambda row: tuple((v is not None, str(v)) for v in row)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=key)
    want = sorted((tuple(map(plain, r)) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()), key=key)
    assert got == want


def test_every_query_has_sql_or_is_named_here():
    assert set(queries.queries()) - set(queries.oracle_sql()) == set()
