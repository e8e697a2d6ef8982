"""The driver contract and plan shapes."""

import inspect

import pytest

import __spark_entry__ as contract
from postwatch.plans.views import Views

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_every_check_has_a_query():
    queries, oracles = contract.queries(), contract.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(queries) > 100


def test_entry_runs(spark):
    rows = contract.entry(spark).collect()
    assert {r.facet for r in rows} == {"work_mode", "job_type", "company", "department"}


@pytest.mark.parametrize("name", ["live_jobs", "job_filter_multi", "applications_open",
                                  "strike_round", "company_job_counts"])
def test_no_cross_joins(spark, name):
    text = plan(contract.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark):
    from postwatch.operators.filters import lookup

    text = plan(lookup(Views(spark, SMALL).company(), "industry", "BUILDING").select("name"))
    assert "EqualTo(c_mktsegment,BUILDING)" in text
    assert "ReadSchema: struct<c_name:string,c_mktsegment:string>" in text


def test_operators_never_collect():
    import postwatch.operators as package
    from importlib import import_module
    from pkgutil import iter_modules

    for module in iter_modules(package.__path__):
        source = inspect.getsource(import_module(f"{package.__name__}.{module.name}"))
        assert ".collect()" not in source
        assert "toPandas" not in source
        assert "localCheckpoint" not in source
        assert "crossJoin" not in source
