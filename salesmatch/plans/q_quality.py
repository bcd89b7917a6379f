"""Data-quality queries: nulls, duplicate keys, value bounds, intake."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesmatch.operators import quality
from salesmatch.plans import bindings as B
from salesmatch.plans.registry import query

_NULL_COLS = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"],
    "customer": ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"],
    "conversations": ["conv_id", "turn", "role", "text"],
}

_KEYS = {
    "part": ["p_partkey"], "customer": ["c_custkey"], "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"],
    "conversations": ["conv_id", "turn"],
}


@query("null_check", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM {t}"
    for t, cols in _NULL_COLS.items() for c in cols))
def null_check(spark, sf_dir):
    """Q1: NOT NULL columns checked in one pass per table."""
    return quality.union_all([quality.null_counts(B.table(spark, sf_dir, t).select(*cols), cols, t)
                              for t, cols in _NULL_COLS.items()])


@query("key_check", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_duplicate_keys, "
    f"CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows_in_duplicates FROM "
    f"(SELECT count(*) AS n FROM {t} GROUP BY {', '.join(k)} HAVING count(*) > 1)"
    for t, k in _KEYS.items()))
def key_check(spark, sf_dir):
    """Q2: primary-key uniqueness per table."""
    return quality.union_all([quality.duplicate_keys(B.table(spark, sf_dir, t).select(*k), k, t)
                              for t, k in _KEYS.items()])


@query("bound_check", B.with_ctes("evaluations", "rec_items", "chat_turns", "vehicles") + """
SELECT 'rating_1_to_5' AS check_name,
       count(*) FILTER (WHERE NOT coalesce(rating BETWEEN 1 AND 5, false)) AS n_violations FROM evaluations
UNION ALL
SELECT 'score_0_to_100', count(*) FILTER (WHERE NOT coalesce(match_score BETWEEN 0 AND 100, false))
FROM rec_items
UNION ALL
SELECT 'role_known', count(*) FILTER (WHERE NOT coalesce(role IN ('user', 'assistant', 'system'), false))
FROM chat_turns
UNION ALL
SELECT 'price_positive', count(*) FILTER (WHERE NOT coalesce(price > 0, false)) FROM vehicles
""")
def bound_check(spark, sf_dir):
    """Q4: value bounds of ratings, scores, roles and prices."""
    return quality.union_all([
        quality.bound_violations(B.evaluations(spark, sf_dir),
                                 {"rating_1_to_5": F.col("rating").between(1, 5)}),
        quality.bound_violations(B.recommendation_items(spark, sf_dir),
                                 {"score_0_to_100": F.col("match_score").between(0, 100)}),
        quality.bound_violations(B.chat_turns(spark, sf_dir),
                                 {"role_known": F.col("role").isin("user", "assistant", "system")}),
        quality.bound_violations(B.vehicles(spark, sf_dir), {"price_positive": F.col("price") > 0}),
    ])


INTAKE_TIME = "2024-01-01 00:00:00"


@query("evaluation_intake", B.with_ctes("evaluations") + f"""
SELECT sha256(concat_ws('|', CAST(trace_id AS VARCHAR), CAST(rating AS VARCHAR), ground_truth))
         AS evaluation_id,
       trace_id, rating, ground_truth, TIMESTAMP '{INTAKE_TIME}' AS evaluated_at,
       'orders-feedback' AS model_used,
       CASE WHEN coalesce(rating BETWEEN 1 AND 5, false) THEN 'accepted' ELSE 'rejected' END AS status
FROM evaluations
""")
def evaluation_intake(spark, sf_dir):
    """New evaluation records with a key-derived id and a fixed
    intake time; out-of-range ratings are kept as rejected rows."""
    e = B.evaluations(spark, sf_dir).select("trace_id", "rating", "ground_truth")
    out = quality.intake(e, F.col("rating").between(1, 5), ["trace_id", "rating", "ground_truth"],
                         "evaluation_id", "orders-feedback", at=INTAKE_TIME)
    return out.select("evaluation_id", "trace_id", "rating", "ground_truth", "evaluated_at",
                      "model_used", "status")
