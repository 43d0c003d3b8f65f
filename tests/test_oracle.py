"""Every registered query with an SQL form gives the SQL's answer."""

import oracle
import pytest

import __spark_entry__ as entry
from conftest import SF

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    oracle.compare(df, con, SQL[name])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 24


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(entry.queries())


def test_sketch_is_close(spark, sf):
    q = entry.queries()
    exact = {r["column"]: r["n_distinct"] for r in q["cardinality"](spark, sf).collect()}
    near = {r["column"]: r["n_distinct"] for r in q["cardinality_approx"](spark, sf).collect()}
    assert set(exact) == set(near)
    for c, n in exact.items():
        assert abs(near[c] - n) <= max(1, 0.06 * n)
