"""Replies routed by their outcome: good rows, rejects with a reason, and a constant record in place of a reject."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmatch import schemas
from salesmatch.functions import jsonparse
from salesmatch.plans import bindings as B
from salesmatch.plans.q_requests import _PAYLOAD, _RAW_SQL, _raw_responses
from salesmatch.plans.registry import query
from salesmatch.session import scratch_path

# What each form of reply comes to (by line number), for the three cuts.
_OUTCOMES = {
    "brace": {3: "not_strict", 6: "empty", 7: "empty"},
    "fenced_braced": {3: "not_strict", 6: "empty", 7: "empty"},
    "fenced": {2: "not_object", 3: "not_strict", 6: "broken", 7: "not_object"},
}


def _outcome_sql(variant: str) -> str:
    return "CASE least(l_linenumber, 7) " + " ".join(f"WHEN {n} THEN '{r}'" for n, r in _OUTCOMES[variant].items()) + " END"


@query("replies_good", f"""
SELECT l_orderkey, l_linenumber, l_partkey AS part, l_quantity AS qty FROM lineitem WHERE {_outcome_sql('brace')} IS NULL
""")
def replies_good(spark, sf_dir):
    """The typed rows of the replies that parse."""
    good, _ = jsonparse.route(_raw_responses(spark, sf_dir), "text", _PAYLOAD, "brace", scratch_path(spark, "replies"))
    return good.select("l_orderkey", "l_linenumber", "parsed.part", "parsed.qty")


@query("replies_rejected", "WITH " + _RAW_SQL.strip() + f"""
SELECT l_orderkey, l_linenumber, {_outcome_sql('fenced')} AS reason, left(text, 40) AS excerpt
FROM raw WHERE {_outcome_sql('fenced')} IS NOT NULL
""")
def replies_rejected(spark, sf_dir):
    """The replies that do not parse, with the class of the failure."""
    _, rejects = jsonparse.route(_raw_responses(spark, sf_dir), "text", _PAYLOAD, "fenced", scratch_path(spark, "replies"))
    return rejects.select("l_orderkey", "l_linenumber", "reason", F.substring("text", 1, 40).alias("excerpt"))


@query("reply_outcomes", "\nUNION ALL\n".join(
    f"SELECT '{v}' AS variant, coalesce({_outcome_sql(v)}, 'good') AS outcome, count(*) AS replies, "
    f"CAST(sum(count(*)) OVER () AS BIGINT) AS of_replies FROM lineitem GROUP BY 2" for v in _OUTCOMES))
def reply_outcomes(spark, sf_dir):
    """Good and rejected replies by cut and reason; the counts of both parts add up to the replies."""

    def counts(variant: str) -> DataFrame:
        good, rejects = jsonparse.route(_raw_responses(spark, sf_dir), "text", _PAYLOAD, variant, scratch_path(spark, "replies"))
        both = good.agg(F.lit("good").alias("outcome"), F.count("*").alias("replies")).unionByName(
            rejects.groupBy(F.col("reason").alias("outcome")).agg(F.count("*").alias("replies")))
        # A row for each reason.
        total = F.broadcast(both.agg(F.sum("replies").alias("of_replies")))
        return both.crossJoin(total).where("replies > 0").select(F.lit(variant).alias("variant"), "outcome", "replies", "of_replies")

    return reduce(DataFrame.unionByName, [counts(v) for v in _OUTCOMES])


# Own constant record for a customer whose reply cannot be read.
DEFAULT_INSIGHT = {
    "needs": ["room for the family", "low running costs"], "priorities": ["safety", "price"], "avoid": ["two seats"],
    "purchase_intent": "unknown", "key_insight": "Ask again at the next visit.", "detected_keywords": [],
}


@query("insight_or_default", """
WITH t AS (SELECT c_custkey AS customer_id, c_mktsegment AS s, c_custkey % 6 AS form FROM customer)
SELECT customer_id, form IN (2, 3, 5) AS is_default, r.* FROM t,
LATERAL (SELECT CASE WHEN form IN (2, 3, 5) THEN 'room for the family,low running costs' ELSE s || ',parking' END AS needs,
  CASE WHEN form IN (2, 3, 5) THEN 'safety,price' ELSE 'price' END AS priorities,
  CASE WHEN form IN (2, 3, 5) THEN 'two seats' WHEN form = 4 THEN '-' ELSE 'noise' END AS avoid,
  CASE WHEN form IN (2, 3, 5) THEN 'unknown' ELSE 'high' END AS purchase_intent,
  CASE WHEN form IN (2, 3, 5) THEN 'Ask again at the next visit.' WHEN form = 4 THEN NULL ELSE 'Buys for ' || s END AS key_insight,
  CAST(CASE WHEN form IN (2, 3, 5) THEN 0 WHEN form = 4 THEN NULL ELSE 1 END AS INTEGER) AS n_keywords) r
""")
def insight_or_default(spark, sf_dir):
    """Insight replies in six forms (bare, fenced, prose, cut off, with missing fields, two objects); a reply
    that does not parse is replaced by the whole constant record, a missing field of a good one stays missing."""
    c = B.table(spark, sf_dir, "customer")
    s, form = F.col("c_mktsegment"), F.col("c_custkey") % 6
    known = [F.array(s, F.lit("parking")).alias("needs"), F.array(F.lit("price")).alias("priorities")]
    full = F.to_json(F.struct(*known, F.array(F.lit("noise")).alias("avoid"), F.lit("high").alias("purchase_intent"),
                              F.concat(F.lit("Buys for "), s).alias("key_insight"), F.array(s).alias("detected_keywords")))
    part = F.to_json(F.struct(*known, F.lit("high").alias("purchase_intent")))
    reply = (F.when(form == 0, full).when(form == 1, F.concat(F.lit("Here it is:\n```json\n"), full, F.lit("\n```\nBye")))
             .when(form == 2, F.concat(F.lit("I think "), full)).when(form == 3, F.substring(full, F.lit(1), F.length(full) - 3))
             .when(form == 4, part).otherwise(F.concat(full, full)))
    done = jsonparse.with_outcome(c.select(F.col("c_custkey").alias("customer_id"), reply.alias("reply")), "reply", schemas.INSIGHT, "fenced")
    done = done.withColumn("r", F.coalesce("parsed", jsonparse.record(DEFAULT_INSIGHT, schemas.INSIGHT)))
    text = lambda c: F.coalesce(F.array_join(f"r.{c}", ","), F.lit("-")).alias(c)
    return done.select("customer_id", F.col("reason").isNotNull().alias("is_default"), text("needs"), text("priorities"), text("avoid"),
                       "r.purchase_intent", "r.key_insight", F.when(F.col("r.detected_keywords").isNotNull(), F.size(
                           "r.detected_keywords")).alias("n_keywords"))
