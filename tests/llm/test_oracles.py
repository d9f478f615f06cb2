"""The queries that have SQL against it, on the smallest tables."""

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from leafmill.llm import queries  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    db = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = queries.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = db.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    assert sorted(rows, key=str) == sorted((tuple(r[i] for i in place) for r in want.fetchall()), key=str)
