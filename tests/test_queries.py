"""Every query with SQL must give the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
HERE = {k: v for k, v in entry.catalog.QUERIES.items()}


def rows(names, data):
    return sorted((tuple(str(round(v, 9) if isinstance(v, float) else v) for v in r) for r in data))


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        at = p if os.path.isfile(p) else f"{p}/*.parquet"
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{at}'")
    return c


@pytest.mark.parametrize("name", sorted(HERE))
def test_query(spark, duck, name):
    df = HERE[name](spark, DATA)
    got = df.collect()
    if name not in entry.catalog.ORACLES:
        assert got
        return
    want = duck.execute(entry.catalog.ORACLES[name])
    columns = [x[0] for x in want.description]
    assert sorted(columns) == sorted(df.columns)
    want = want.fetchall()
    assert rows(columns, [tuple(r[c] for c in columns) for r in got]) == rows(columns, want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
