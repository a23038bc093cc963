"""Every registered query against its SQL counterpart on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
# Bounded frames that training needs are larger than the smallest data set gives.
NEEDS_MORE_DATA = {"model_selection", "model_evaluation", "model_importance", "forecast_model", "scenario_model_segment"}
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return connection


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def sortable(row):
    return tuple((v is not None, f"{v:.6f}" if isinstance(v, float) else str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    mine = [tuple(r) for r in df.select(*names).collect()]
    result = db.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    theirs = [tuple(r[i] for i in order) for r in result.fetchall()]
    assert len(mine) == len(theirs)
    for a, b in zip(sorted(mine, key=sortable), sorted(theirs, key=sortable)):
        assert all(same(x, y) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - NEEDS_MORE_DATA))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_window_filters_reach_the_reader(spark, sf):
    plan = QUERIES["kpi_summary"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_shipdate" in plan
    assert "l_tax" not in plan and "l_partkey" not in plan
