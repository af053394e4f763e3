"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from prosescan.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, tables, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = tables.execute(f"select {', '.join(f'"{c}"' for c in columns)} from ({catalog.ORACLE_SQL[name]})").fetchall()
    got = [tuple(r) for r in df.select(*(f"`{c}`" for c in columns)).collect()]
    assert got and sorted(map(repr, got)) == sorted(map(repr, want))


def test_entry(spark):
    import __spark_entry__

    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 42
