"""Every catalogued query against its SQL in DuckDB, on the smallest tables."""

import glob
from pathlib import Path

import duckdb
import pytest

from logweir import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(str, r)) for r in frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist())


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name not in catalog.ORACLES:
        assert len(got) > 0
        return
    want = duck.execute(catalog.ORACLES[name]).df()
    for c in want.columns:
        if str(want[c].dtype).startswith("datetime"):
            want[c] = want[c].dt.date
    assert rows(got) == rows(want)
