"""Every registered query with a DuckDB twin gives the same rows at the smallest size."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from filigree.plans import catalog

DATA = "/root/testdata/sf0.001"
#: Queries of iterative operators; one of each kind is enough here, the others run on hand-made cases.
SLOW = {"topo_counts", "f1_topo", "mean_f1_topo", "weighted_score", "stream_f1_topo"}
NAMES = sorted(set(catalog.SQL) - SLOW)


def shown(v) -> str:
    if pd.isna(v):
        return "null"
    return v if isinstance(v, str) else f"{float(v) + 0.0:.5f}"


def rows(df):
    return sorted(tuple(map(shown, values)) for values in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        source = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.sql(f"create view {p.stem} as select * from '{source}'")
    return con


@pytest.mark.skipif(not Path(DATA).exists(), reason="no given tables here")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), duck.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_each_name_has_a_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
    assert catalog.FLAGSHIP in catalog.QUERIES
