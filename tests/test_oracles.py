"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(5)
    return df.astype(object).where(df.notna(), None).sort_values(list(df.columns), key=lambda s: s.map(str)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got, want = plain(queries()[name](spark, SF).toPandas()), plain(duck.execute(oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.values.tolist() == want.values.tolist()
