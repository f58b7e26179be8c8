"""Every catalogue query that SQL can express, against DuckDB on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from skein.plans import catalogue  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(str, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, str(DATA)).toPandas()
    if sql := catalogue.oracle_sql().get(name):
        want = duck.execute(sql).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns)


def test_entry(spark):
    assert catalogue.entry(spark, str(DATA)).count() > 0
