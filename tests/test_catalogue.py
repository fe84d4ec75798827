"""Every query against its SQL."""

import math
import os
from glob import glob

import duckdb
import pytest

from terrafold import catalogue


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for path in glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path if os.path.isfile(path) else path + '/*'}')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(float(value), 6) if isinstance(value, (int, float)) else str(value)


def rows_of(frame):
    frame = frame.astype(object).where(frame.notna(), None)
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, duck, data, name):
    found = catalogue.queries()[name](spark, data)
    columns = sorted(found.columns)
    expected = duck.execute(catalogue.oracle_sql()[name]).fetchdf()
    assert sorted(expected.columns) == columns
    assert rows_of(found.select(*columns).toPandas()) == rows_of(expected[columns])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs_without_sql(spark, data, name):
    assert catalogue.queries()[name](spark, data).count() > 0


def test_layers_of_shapes_are_distinct_before_the_join(spark, data):
    """No task of the join holds the shapes of a layer."""
    plan = catalogue.queries()["layer_semi"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [layer_id" in plan or "Aggregate [id" in plan or "Aggregate [c_nationkey" in plan, plan
