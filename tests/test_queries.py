"""Every registered query of the library against the SQL on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from lectern.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        return f"{v:.6f}" if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sql, name):
    got = catalogue.QUERIES[name](spark, FOLDER).toPandas()
    if name in catalogue.ORACLES:
        want = sql.execute(catalogue.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)
    else:
        assert len(got)
