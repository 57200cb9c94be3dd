"""Physical plans, with broadcasts by size switched off as for large tables."""

import pytest

from ligatable.plans.catalog import all_queries

TRAINED = {"als_recommendations", "metrics_record", "score_pairs", "train_als"}

#: Products of factor blocks are the one place where rows pass through numpy.
WITH_NUMPY = {"bounded_recommendations", "bounded_reach"}


@pytest.fixture()
def large(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", sorted(set(all_queries()) - TRAINED - WITH_NUMPY))
def test_joins_are_equi_joins_without_python(large, sf_dir, name):
    plan = all_queries()[name](large, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas"):
        assert operator not in plan


@pytest.mark.parametrize("name", sorted(WITH_NUMPY))
def test_numpy_queries_join_by_equality(large, sf_dir, name):
    plan = all_queries()[name](large, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
