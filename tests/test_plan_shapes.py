"""Plan properties that matter at scale, checked on the physical plans."""

import pytest

import __spark_entry__  # noqa: F401  (registers the streaming queries)
from featshare.plans.registry import QUERIES
from featshare.operators import readiness
from featshare.operators.registry import latest_model_version
from featshare.sources.fixtures import Fixtures

from conftest import SF_SMALL

def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_s1_pushdown_and_pruning(spark):
    p = plan(QUERIES["s1_read_feature_table"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(c_acctbal), GreaterThan(c_acctbal,0.0)]" in p
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double,c_mktsegment:string>" in p


def test_lookup_reads_only_key_and_features(spark):
    p = plan(QUERIES["j1_feature_lookup"](spark, SF_SMALL))
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey:int,c_acctbal:double>" in p
    assert "c_mktsegment" not in p


def test_readiness_is_one_hash_aggregation(spark):
    p = plan(readiness(Fixtures(spark, SF_SMALL).status_events, 600))
    assert "HashAggregate" in p and "SortAggregate" not in p
    assert p.count("Exchange hashpartitioning") == 1


def test_latest_version_heavy_step_is_hash_based(spark):
    p = plan(latest_model_version(Fixtures(spark, SF_SMALL).model_versions))
    assert "partial_max(_vnum" in p  # the pass over all versions is a hash aggregate


def test_top_k_per_model_uses_window_group_limit(spark):
    p = plan(QUERIES["l2_versions_desc"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_cross_or_nested_loop_joins(spark, key):
    """The returned plan of every query; what a query wrote or streamed before is not in it."""
    p = plan(QUERIES[key](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "BatchEvalPython" not in p  # no row-at-a-time Python UDF in any registered query
