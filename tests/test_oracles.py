"""Every query with SQL gives DuckDB's rows."""

import duckdb
import pandas as pd
import pytest

from orrery import queries as engine

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def same(a: pd.DataFrame, b: pd.DataFrame, places: float = 2e-6):
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    assert len(a) == len(b)
    keys = [c for c in cols if a[c].dtype.kind not in "f"] + [c for c in cols if a[c].dtype.kind == "f"]
    a, b = (x[cols].sort_values(keys).reset_index(drop=True) for x in (a, b))
    for c in cols:
        if a[c].dtype.kind == "f" or b[c].dtype.kind == "f":
            x, y = a[c].astype(float), b[c].astype(float)
            assert ((x - y).abs().fillna(0) <= places + 1e-6 * y.abs().fillna(0)).all() and (x.isna() == y.isna()).all(), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c


@pytest.mark.parametrize("name", sorted(engine.queries()))
def test_same_as_sql(spark, db, name):
    got = engine.queries()[name](spark, SF).toPandas()
    if name in engine.oracle_sql():
        same(got, db.sql(engine.oracle_sql()[name]).df())
    else:
        assert len(got)
