"""Every query of the catalogue against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from palisade.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    out = QUERIES[name](spark, DATA)
    cols = sorted(out.columns)
    got = sorted((tuple(r[c] for c in cols) for r in out.collect()), key=str)
    sql = duck.sql(ORACLES[name])
    assert sorted(sql.columns) == cols
    places = [sql.columns.index(c) for c in cols]
    assert got == sorted((tuple(r[i] for i in places) for r in sql.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
