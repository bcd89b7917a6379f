"""Physical-plan checks: pushdown, pruning, join strategy, exchanges."""

import os

import pytest

import __spark_entry__ as E
from salesmatch.operators import joins, ranking
from salesmatch.plans import bindings as B

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver tables not present")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_projection_reach_the_scan(spark):
    p = plan(E.queries()["optional_filter"](spark, SF))
    assert "PushedFilters: [IsNotNull(p_type), IsNotNull(p_retailprice), EqualTo(p_type,SMALL)" in p
    assert "ReadSchema: struct<p_partkey:bigint,p_type:string,p_retailprice:double>" in p


def test_bucketed_range_join_has_no_nested_loop(spark):
    c = B.customers(spark, SF).select("customer_id", "budget_min", "budget_max")
    v = B.vehicles(spark, SF).select("vehicle_id", "price")
    for force in ("broadcast", "shuffle"):
        p = plan(joins.range_join(c, v, "budget_min", "budget_max", "price", force=force))
        assert "NestedLoopJoin" not in p and "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" in plan(joins.naive_range_join(c, v, "budget_min", "budget_max", "price"))


def test_latest_per_key_is_one_partial_aggregate_exchange(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        i = B.interactions(spark, SF).select("customer_id", "interaction_id", "interaction_date")
        p = plan(ranking.latest_per_key(i, ["customer_id"], ["interaction_date", "interaction_id"]))
        assert p.count("Exchange hashpartitioning") == 1
        assert "partial_max_by" in p
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_flagship_pairs_are_not_shuffled_before_top_k(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = plan(E.queries()["recommend_top3"](spark, SF))
        assert "WindowGroupLimit" in p and "NestedLoopJoin" not in p
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
