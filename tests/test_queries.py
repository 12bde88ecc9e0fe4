"""Every registered query against its SQL on DuckDB, on whole tables."""

import os

import duckdb
import pandas as pd
import pytest

from lineweave.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{os.path.join(DIR, t)}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    value = lambda v: None if pd.isna(v) else round(float(v), 6) if isinstance(v, float) or hasattr(v, "is_integer") and not isinstance(v, bool) else str(v)
    return sorted((tuple(str(value(v)) for v in r) for r in df.itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DIR).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    want = duck.execute(ORACLES[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want), "an empty result proves nothing"
    assert plain(got) == plain(want)
