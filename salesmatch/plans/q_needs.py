"""Structured needs of every customer, from dialogue that is derived from the customer table.

Which slot a dialogue fills, in which words and language and with which change of
mind follows from the customer's key, so every slot, budget form and conflict
occurs. The SQL twin states the slots directly; it does not read the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmatch.operators import needs
from salesmatch.plans import bindings as B
from salesmatch.plans.registry import query

# Customers whose dialogue a task writes and reads.
CUSTOMERS_PER_TASK = 10_000

_BODIES = ["minivan", "suv", "sedan", "station wagon", "compact", "pickup"]


def _said(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def dialogue(spark, sf_dir) -> DataFrame:
    """session_id, turn, role, content: up to six turns for each customer, some of them null or empty."""
    c = B.spread(B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal")),
                 CUSTOMERS_PER_TASK)
    k = F.col("k")
    man = (F.lit(100) + F.floor(F.abs("bal")) % 400).cast("string")  # units of 10,000 yen
    more = (F.lit(150) + F.floor(F.abs("bal")) % 400).cast("string")
    yen = F.format_number((F.lit(100) + F.floor(F.abs("bal")) % 400) * 10_000, 0)
    body = lambda n: F.element_at(F.lit(_BODIES), (n % 6 + 1).cast("int"))
    size = (k % 6 + 2).cast("string")
    opening = F.when(k % 2 == 0, _said("We look for a ", body(k), " for a family of ", size, ".")).otherwise(
        _said(size, "人家族です。週末に乗る ", body(k), " を探しています。"))
    money = (F.when(k % 6 == 0, _said("We can spend up to ", yen, " yen."))
             .when(k % 6 == 1, _said(man, "万円から", more, "万円くらいまで考えています。"))
             .when(k % 6 == 2, _said("Something in the ", (k % 4 + 1).cast("string"), " million yen range, please."))
             .when(k % 6 == 3, _said("だいたい", man, "万円です。"))
             .when(k % 6 == 4, _said("Between ", (k % 3 + 1).cast("string"), ".5 and ", (k % 3 + 3).cast("string"), " million yen.")))
    wishes = (F.when(k % 9 == 0, F.lit("")).when(k % 3 == 0, F.lit("自動ブレーキは絶対欲しいです。トヨタかホンダで。"))
              .when(k % 3 == 1, F.lit("Good mileage, sliding doors; not too expensive. I commute. Just looking."))
              .otherwise(F.lit("No diesel! A Lexus would be too large.")))
    change = F.when(k % 4 == 0, _said("Actually, rather a ", body(k + 1), " and no sliding doors."))
    raised = F.when(k % 5 == 0, _said("For the right car at most ", F.format_number((F.lit(600) + k % 50) * 10_000, 0), " yen."))
    turn = lambda n, role, text: F.struct(F.lit(n).alias("turn"), F.lit(role).alias("role"), text.alias("content"))
    return c.select(k.alias("session_id"), F.explode(F.array(
        turn(0, "user", opening), turn(1, "user", money), turn(2, "user", wishes), turn(3, "user", change),
        turn(4, "assistant", F.lit("How about a sedan with auto brake, up to 900万円, for a family of 9?")),
        turn(5, "user", raised))).alias("t")).select("session_id", "t.*")


_BODY_SQL = ("CASE ({n}) % 6 WHEN 0 THEN 'minivan' WHEN 1 THEN 'suv' WHEN 2 THEN 'sedan' WHEN 3 THEN 'wagon' "
             "WHEN 4 THEN 'compact' ELSE 'pickup' END")


@query("structured_needs", f"""
WITH c AS (SELECT c_custkey AS k, CAST(100 + CAST(floor(abs(c_acctbal)) AS BIGINT) % 400 AS BIGINT) * 10000 AS amount FROM customer),
b AS (SELECT k,
  CASE k % 6 WHEN 1 THEN amount WHEN 2 THEN (k % 4 + 1) * 1000000 WHEN 4 THEN (k % 3 + 1) * 1000000 + 500000 END AS low,
  CASE k % 6 WHEN 0 THEN amount WHEN 1 THEN amount + 500000 WHEN 4 THEN (k % 3 + 3) * 1000000 END AS high,
  CASE k % 6 WHEN 2 THEN (k % 4 + 2) * 1000000 - 1 END AS band_high,
  CASE k % 6 WHEN 3 THEN amount END AS about,
  CASE WHEN k % 5 = 0 THEN (600 + k % 50) * 10000 END AS raised FROM c),
w AS (SELECT k,
  CASE WHEN k % 9 = 0 THEN '' WHEN k % 3 = 0 THEN 'auto brake' WHEN k % 12 = 4 THEN 'low fuel use'
       WHEN k % 3 = 1 THEN 'low fuel use,sliding doors' ELSE '' END AS must,
  CASE WHEN k % 9 = 0 THEN '' WHEN k % 3 = 0 THEN 'honda,toyota' WHEN k % 3 = 2 THEN 'lexus' ELSE '' END AS brands,
  concat_ws(',', CASE WHEN k % 3 = 2 THEN 'diesel' END, CASE WHEN k % 4 = 0 THEN 'sliding doors' END) AS breakers,
  CASE WHEN k % 3 = 1 THEN 'price' WHEN k % 3 = 2 THEN 'hard to drive if too large' ELSE '' END AS worries FROM c)
SELECT k AS session_id, CASE WHEN k % 4 = 0 THEN {_BODY_SQL.format(n='k + 1')} ELSE {_BODY_SQL.format(n='k')} END AS body_type,
       CAST(low AS BIGINT) AS budget_min, CAST(coalesce(raised, high, band_high, about) AS BIGINT) AS budget_max,
       CAST(k % 6 + 2 AS INTEGER) AS family_size,
       CASE WHEN k % 3 = 1 THEN 'commuting' WHEN k % 2 = 1 THEN 'leisure' END AS primary_use,
       CASE WHEN k % 3 = 1 THEN 'low' WHEN k % 3 = 0 AND k % 9 <> 0 THEN 'high' END AS sentiment,
       must AS must_have_features, brands AS preferred_brands, breakers AS deal_breakers, worries AS concerns
FROM b JOIN w USING (k)
""")
def structured_needs(spark, sf_dir):
    """Typed needs of every customer from the user turns of its dialogue; the last mention holds."""
    turns = dialogue(spark, sf_dir).where("role = 'user'")
    out = needs.structured_needs(turns, "session_id", "turn", "content")
    return out.select("session_id", "body_type", "budget_min", "budget_max", "family_size", "primary_use", "sentiment",
                      *[F.array_join(c, ",").alias(c) for c in needs.LISTS])
