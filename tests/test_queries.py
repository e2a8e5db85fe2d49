"""Each query against its SQL, on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def _rows(frame):
    columns = sorted(frame.columns)
    clean = lambda v: None if v is None or v != v else round(float(v), 9) if isinstance(v, float) else int(v) if hasattr(v, "__int__") and not isinstance(v, str) else v
    return columns, sorted(str([clean(v) for v in r]) for r in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.ORACLE))
def test_query_matches_sql(spark, duck, name):
    got, want = _rows(entry.queries()[name](spark, DATA).toPandas()), _rows(duck.execute(entry.oracle_sql()[name]).df())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 380
