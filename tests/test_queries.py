"""Every registered query beside its SQL on the small tables."""

import os
import sys

import duckdb
import pytest

from gridloom.plans.registry import load

DATA = os.environ.get("GRIDLOOM_TEST_DATA", "/root/testdata/sf0.001")
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)].astype(object).where(frame.notna(), None)
    return sorted((tuple(round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row) for row in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_subpackage(monkeypatch):
    """Whatever keeps llm or the pipeline from being imported, the other queries stay."""
    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "gridloom.llm.queries", None)
    assert e.queries().keys() == QUERIES.keys() and e.oracle_sql() == ORACLES


def test_default_rect_keeps_every_key(spark, tmp_path):
    """Keys of null and keys with null values alone have a row, as in SQL (F5)."""
    lines = [(1, 2.0, 10.0), (1, 3.0, None), (1, None, 11.0), (2, None, 5.0), (2, None, 8.0), (None, 4.0, 1.0), (None, 7.0, 2.0), (3, None, None), (4, 0.5, 1.5)]
    spark.createDataFrame(lines, "l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    got = QUERIES["default_rect"](spark, str(tmp_path)).toPandas()
    assert plain(got) == plain(con.execute(ORACLES["default_rect"]).df()) and len(got) == 5
