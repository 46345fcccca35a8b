"""Every registered query with SQL gives the rows that DuckDB gives for it."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tactus.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return "null"
        if isinstance(x, bool) or str(x) in ("True", "False"):
            return str(x)
        try:
            return f"{float(x):.7e}"
        except (TypeError, ValueError):
            return str(x)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
