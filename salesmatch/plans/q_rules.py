"""Rule reports and a checked intake over tables that break every rule.

The given tables break none, so their projections here are damaged by key: twins,
orphans, nulls and values out of bounds, in both the query and its SQL twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmatch.operators import rules as R
from salesmatch.plans import bindings as B
from salesmatch.plans.registry import query
from salesmatch.session import scratch_path
from salesmatch.sources import io

_DAMAGED_SQL = """
WITH e AS (SELECT o_orderkey - CASE WHEN o_orderkey % 97 = 1 THEN 1 ELSE 0 END AS trace_id,
    CASE WHEN o_orderkey % 89 = 0 THEN -1 WHEN o_orderkey % 83 = 0 THEN NULL ELSE o_custkey END AS customer_id,
    CASE WHEN o_orderkey % 50 = 0 THEN 0 WHEN o_orderkey % 51 = 0 THEN 6 WHEN o_orderkey % 53 = 0 THEN NULL
         ELSE CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END AS rating,
    CASE WHEN o_orderkey % 41 <> 0 THEN o_orderstatus END AS feedback FROM orders),
r AS (SELECT l_orderkey AS list_id, l_linenumber AS pos, CASE WHEN l_partkey % 101 = 0 THEN -l_partkey ELSE l_partkey END AS vehicle_id,
    CASE WHEN l_partkey % 100 = 0 THEN 101 ELSE CAST(round(100.0 - l_discount * 100) AS INTEGER) END AS match_score FROM lineitem),
t AS (SELECT CASE WHEN turn % 6 = 5 THEN NULL ELSE conv_id END AS session_id, CASE WHEN turn % 5 = 4 THEN turn - 1 ELSE turn END AS turn,
    CASE WHEN turn % 5 >= 3 THEN 'user' WHEN conv_id % 7 = 3 AND role = 'assistant' THEN 'bot' ELSE role END AS role FROM conversations)"""


def damaged(spark, sf_dir) -> dict[str, DataFrame]:
    o, k = B.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    li, p = B.table(spark, sf_dir, "lineitem"), F.col("l_partkey")
    turn = F.col("turn")
    return {
        "evaluations": o.select(
            (k - F.when(k % 97 == 1, 1).otherwise(0)).alias("trace_id"),
            F.when(k % 89 == 0, F.lit(-1)).when(k % 83 != 0, F.col("o_custkey")).alias("customer_id"),
            F.when(k % 50 == 0, 0).when(k % 51 == 0, 6).when(k % 53 != 0, F.substring("o_orderpriority", 1, 1).cast("int")).alias("rating"),
            F.when(k % 41 != 0, F.col("o_orderstatus")).alias("feedback")),
        "items": li.select(
            F.col("l_orderkey").alias("list_id"), F.col("l_linenumber").alias("pos"),
            F.when(p % 101 == 0, -p).otherwise(p).alias("vehicle_id"),
            F.when(p % 100 == 0, 101).otherwise(F.round(F.lit(100.0) - F.col("l_discount") * 100).cast("int")).alias("match_score")),
        "turns": B.table(spark, sf_dir, "conversations").select(
            F.when(turn % 6 != 5, F.col("conv_id")).alias("session_id"), F.when(turn % 5 == 4, turn - 1).otherwise(turn).alias("turn"),
            F.when(turn % 5 >= 3, "user").when((F.col("conv_id") % 7 == 3) & (F.col("role") == "assistant"), "bot").otherwise(
                F.col("role")).alias("role"))}


RULES = {
    "evaluations": [R.Unique(("trace_id",)), R.NotNull("customer_id"), R.References("customer_id", "customers", "customer_id"),
                    R.NotNull("feedback"), R.Holds("rating 1 to 5", "rating between 1 and 5")],
    "items": [R.References("vehicle_id", "vehicles", "vehicle_id"), R.Holds("score 0 to 100", "match_score between 0 and 100")],
    "turns": [R.NotNull("session_id"), R.Unique(("session_id", "turn")), R.Unique(("session_id", "turn", "role")),
              R.Holds("role known", "role in ('user', 'assistant', 'system')")],
}


def _rule_sql(table: str, source: str, rule: R.Rule) -> str:
    if isinstance(rule, R.NotNull):
        n = f"(SELECT count(*) FROM {source} WHERE {rule.column} IS NULL)"
    elif isinstance(rule, R.Holds):
        n = f"(SELECT count(*) FROM {source} WHERE NOT coalesce({rule.condition}, false))"
    elif isinstance(rule, R.Unique):
        n = f"(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM {source} GROUP BY {', '.join(rule.columns)}) WHERE n > 1)"
    else:
        parent = {"customers": "SELECT c_custkey FROM customer", "vehicles": "SELECT p_partkey FROM part"}[rule.parent]
        n = f"(SELECT count(*) FROM {source} WHERE {rule.column} IS NOT NULL AND {rule.column} NOT IN ({parent}))"
    return (f"SELECT '{table}' AS table_name, '{rule.name}' AS rule, (SELECT count(*) FROM {source}) AS n_rows, "
            f"CAST({n} AS BIGINT) AS n_violations")


@query("rule_report", _DAMAGED_SQL + "\n" + "\nUNION ALL\n".join(
    _rule_sql(t, t[0] if t != "items" else "r", r) for t, rules in RULES.items() for r in rules))
def rule_report(spark, sf_dir):
    """Every rule of three damaged tables, each table in one scan."""
    tables = damaged(spark, sf_dir)
    parents = {"customers": B.customers(spark, sf_dir), "vehicles": B.vehicles(spark, sf_dir)}
    return R.report_all({t: (tables[t], RULES[t]) for t in RULES}, parents)


CHECKED_AT = "2026-01-01 00:00:00"
INTAKE_RULES = [R.NotNull("feedback"), R.Holds("rating 1 to 5", "rating between 1 and 5")]


@query("checked_intake", _DAMAGED_SQL + f""",
b AS (SELECT *, concat_ws(', ', CASE WHEN feedback IS NULL THEN 'feedback not null' END,
                          CASE WHEN NOT coalesce(rating BETWEEN 1 AND 5, false) THEN 'rating 1 to 5' END) AS broken FROM e)
SELECT CASE WHEN broken = '' THEN 'accepted' ELSE 'rejected' END AS outcome, broken, rating, count(*) AS n_records,
  TIMESTAMP '{CHECKED_AT}' AS evaluated_at, (SELECT count(*) FROM b) AS observed_rows, (SELECT count(*) FROM b WHERE broken <> '') AS observed_rejected,
  (SELECT count(*) FROM b WHERE contains(broken, 'feedback')) AS observed_feedback, (SELECT count(*) FROM b WHERE contains(broken, 'rating')) AS observed_rating
FROM b GROUP BY ALL
""")
def checked_intake(spark, sf_dir):
    """Stamped evaluation records written in one job, rejects with the rules they break; the counts of that
    job are observed while it writes and stand beside what was read back."""
    e = io.stamp(damaged(spark, sf_dir)["evaluations"], "evaluation_id", "order-feedback", ["trace_id", "customer_id", "rating"], CHECKED_AT,
                 time_col="evaluated_at")
    good, bad, seen = R.checked_write(e, INTAKE_RULES, scratch_path(spark, "intake"))
    both = good.select(F.lit("accepted").alias("outcome"), F.lit("").alias("broken"), "rating", "evaluated_at").unionByName(
        bad.select(F.lit("rejected").alias("outcome"), F.array_join("broken", ", ").alias("broken"), "rating", "evaluated_at"))
    return both.groupBy("outcome", "broken", "rating", "evaluated_at").agg(F.count("*").alias("n_records")).select(
        "*", F.lit(seen["rows"]).alias("observed_rows"), F.lit(seen["rejected"]).alias("observed_rejected"),
        F.lit(seen["feedback not null"]).alias("observed_feedback"), F.lit(seen["rating 1 to 5"]).alias("observed_rating"))
