import os

import duckdb
import pytest

from leafpress.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, sf, name):
    got = catalog.queries()[name](spark, sf)
    cols = sorted(got.columns)
    mine = sorted(tuple(map(str, r)) for r in got.select(cols).toPandas().itertuples(index=False))
    want = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(want.columns) == cols
    assert mine == sorted(tuple(map(str, r)) for r in want[cols].itertuples(index=False))


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.queries()["preprocess_pixels"](spark, "/root/testdata/sf0.001").where("error IS NOT NULL").count() == 0


def test_lookup_is_pushed_down(spark, sf):
    plan = catalog.get_by_id(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,17)" in plan and "o_orderdate" not in plan
