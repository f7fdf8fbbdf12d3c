"""Every registered query against its DuckDB oracle (the driver's correctness gate),
on the smallest scale factor; queries without an oracle must at least run."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from featshare.plans.registry import ORACLES, QUERIES
from featshare.sources.fixtures import BASE_TABLES

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE_TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None).isoformat()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False)), key=repr)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["segment", "n_rows", "n_matched", "sum_target", "avg_acctbal"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    assert sorted(QUERIES) == sorted(ORACLES)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    got = QUERIES[key](spark, SF_SMALL).toPandas()
    if key not in ORACLES:
        return
    want = con.execute(ORACLES[key]).df()
    c1, r1 = _rows(got)
    c2, r2 = _rows(want)
    assert c1 == c2
    assert r2, "an empty answer proves nothing"
    assert len(r1) == len(r2)
    assert r1 == r2


def test_no_fixed_input_queries():
    # every oracle reads at least one of the driver's tables
    for key, sql in ORACLES.items():
        assert any(f" {t}" in sql for t in BASE_TABLES), key
    assert os.path.exists(SF_SMALL)
