"""Every query against its SQL, run by DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

from sylvaframe import catalogue


def _rows(df):
    names = sorted(df.columns)
    return names, sorted(map(repr, df[names].astype(object).where(df[names].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, name):
    got = catalogue.QUERIES[name](spark, sf).toPandas()
    if name not in catalogue.SQL:
        assert len(got) > 0
        return
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.sql(catalogue.SQL[name]).df()
    assert _rows(got) == _rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
