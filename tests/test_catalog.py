"""Every registered query against its SQL on the driver's tables."""

import pytest

import __spark_entry__ as entry
from gatelake.plans import catalog, oracles
from tests.compare import differences, duck

SQL = oracles.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalog.REGISTRY))
def test_query_equals_sql(spark, sf_dir, name):
    result = catalog.REGISTRY[name](spark, sf_dir)
    assert name in SQL
    plan = result._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert unwanted not in plan
    assert differences(result, duck(sf_dir), SQL[name]) == []


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0
