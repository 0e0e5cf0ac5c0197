"""Every registered query with DuckDB text gives the rows that DuckDB gives."""

import duckdb
import pandas as pd
import pytest

from keelson import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return None if v is None or v is pd.NaT else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    cur = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in cur.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name, rows", [("srt_01_key_order_whole", "customer"), ("srt_02_priority_order_whole", "part")])
def test_whole_table_in_order(spark, sf, duck, name, rows):
    df = registry.queries()[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    assert got == duck.execute(registry.oracle_sql()[name]).fetchall()
    assert len(got) == duck.execute(f"SELECT count(*) FROM {rows}").fetchone()[0]
    assert "TakeOrdered" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_rows_only(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0
