"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import numpy as np
import pandas as pd
import pytest

duckdb = pytest.importorskip("duckdb")

from leafmill import catalog  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if str(frame[c].dtype) in ("object", "str", "string"):
            frame[c] = frame[c].map(lambda v: None if v is None or v is pd.NaT else str(v)[:10] if hasattr(v, "isoformat") else str(v))
        elif str(frame[c].dtype).startswith("datetime"):
            frame[c] = frame[c].map(lambda v: str(v)[:19])
        else:
            frame[c] = frame[c].astype(float).round(6)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    a, b = normal(a), normal(b)
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    for c in a.columns:
        if a[c].dtype == float and b[c].dtype == float:
            assert np.allclose(a[c], b[c], equal_nan=True, rtol=1e-12, atol=1e-6), c
        else:
            left, right = (x.astype(str).str[:10] if c in ("day",) else x.astype(str) for x in (a[c], b[c]))
            assert (left == right).all(), c


@pytest.fixture(scope="module")
def oracle():
    db = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return db


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, oracle, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    if name in catalog.ORACLES:
        same(got, oracle.execute(catalog.ORACLES[name]).df())
    else:
        assert len(got)
