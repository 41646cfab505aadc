"""Every SQL-checked query equals its DuckDB oracle on the small tables;
every rows-only query runs and returns rows."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from oracle_check import digest, duck

from adlens.plans.catalog import REGISTRY

# the training-data queries are an optional part with tests of their own
SQL = {name: sql for name, sql in E.oracle_sql().items() if name in REGISTRY}
ROWS_ONLY = sorted(set(REGISTRY) - set(SQL))


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_registered_with_matching_names():
    assert set(SQL) <= set(E.queries())
    assert len(SQL) >= 30


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in sdf.collect()]
    res = con.execute(SQL[name])
    cols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(cols)
    assert len(rows) == len(drows)
    assert digest(sdf.columns, rows)[0] == digest(cols, drows)[0]


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_query_runs(spark, name):
    assert E.queries()[name](spark, SF_SMALL).count() > 0


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns[:5] == ["client_id", "account_id", "label", "impression", "max_cpc"]
    assert len(df.columns) == 5 + 36
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_no_python_in_plan(spark, name):
    plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "PythonUDF" not in plan and "MapInPandas" not in plan
