"""Every query with a SQL form gives the same rows in DuckDB; the others run and give rows."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark.plans import model_queries, reference_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    out = []
    for r in df.itertuples(index=False):
        out.append(tuple(None if pd.isna(x) else float(x) if isinstance(x, (int, float, np.number)) and not isinstance(x, bool) else str(x) for x in r))
    return sorted(out, key=str)


QUERIES = reference_queries.QUERIES | model_queries.QUERIES
ORACLE_SQL = reference_queries.ORACLE_SQL | model_queries.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got)


@pytest.mark.parametrize("name", ["A5_snapshot", "M2", "M4", "M6", "M7", "D1", "V9", "V12", "D7", "M9", "M12_summary"])
def test_rows_only(spark, name):
    assert model_queries.QUERIES[name](spark, SF).count()
