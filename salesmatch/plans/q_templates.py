"""The five request templates over customer profiles, and the profiles they read.

Profiles are customers with what the given tables lack derived from the key: an
age, a family, preferences, and budgets that are null or 0 for some. The
transcript of a customer's latest interaction is the document with its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmatch.functions.text import or_default, price_label
from salesmatch.operators import ranking, templates
from salesmatch.operators.templates import Line, Ranked, Template
from salesmatch.plans import bindings as B
from salesmatch.plans.q_metrics import CANDIDATE_TEXT_SQL, candidate_text_df
from salesmatch.plans.registry import query

TRANSCRIPT_CHARS = 2000

INSIGHT = Template("insight", "You read sales talks for what customers do not say.", (
    Line("Describe the customer behind this talk."), Line("Talk:"), Line("", "transcript", "(no talk was recorded)"),
    Line('Reply with JSON only: {"customer_persona": {...}, "deep_needs": {...}, "key_quotes": [...]}')))
NEEDS = Template("needs", "You take the requirements for a vehicle search from sales talks.", (
    Line("Talk:"), Line("", "transcript", "(no talk was recorded)"),
    Line('Reply with JSON only: {"body_type": "...", "budget_min": 0, "budget_max": 0, "family_size": 0, "primary_use": "...", '
         '"must_have_features": [], "preferred_brands": [], "deal_breakers": []}')))
RECOMMENDATION = Template("recommendation", "You sell cars and give reasons that fit the customer.", (
    Line("Recommend three vehicles for this customer."), Line("Customer: ", "name"), Line("Age: ", "age"),
    Line("Occupation: ", "occupation"), Line("Family: ", "family"), Line("Budget from: ", "low", tail=" yen"),
    Line("Budget to: ", "high", tail=" yen"), Line("Cares about: ", "preferences"), Line("Talk:\n", "transcript", None),
    Line("Vehicles:\n", "candidate_text"),
    Line('Reply with JSON only: {"recommendations": [{"vehicle_id": 0, "match_score": 0, "reason": "..."}]}')))
TALK_SCRIPT = Template("talk_script", "You sell cars and find the words that convince a customer.", (
    Line("Write what to say to this customer."), Line("Customer: ", "name"), Line("Age: ", "age"), Line("Occupation: ", "occupation"),
    Line("Family: ", "family"), Line("Current vehicle: ", "current_vehicle"), Line("Budget from: ", "low", tail=" yen"),
    Line("Budget to: ", "high", tail=" yen"), Line("Cares about: ", "preferences"),
    Line("The customer said: ", "key_quotes", None, sep=" / "), Line("Talk:\n", "transcript", None, cut=TRANSCRIPT_CHARS),
    Line("Vehicles by rank:"), Ranked("ranked", ("", "make", " ", "model", " (", "price", "): ", "reason"), 3),
    Line("Reply in Markdown: an opening, a section for each rank, a closing.")))
APP_INSIGHT = Template("app_insight", "You know why people buy cars and read it from their data.", (
    Line("Describe what this customer needs."), Line("Name: ", "name"), Line("Age: ", "age", "unknown"),
    Line("Occupation: ", "occupation", "unknown"), Line("Family: ", "family", "unknown"),
    Line("Budget from: ", "low", tail=" yen"), Line("Budget to: ", "budget_max", "0", tail=" yen"), Line("Likes: ", "preferences", "none"),
    Line("Talk:\n", "transcript", None),
    Line('Reply with JSON only: {"needs": [], "priorities": [], "avoid": [], "purchase_intent": "...", "key_insight": "..."}')))
TEMPLATES = {t.name: t for t in (INSIGHT, NEEDS, RECOMMENDATION, TALK_SCRIPT, APP_INSIGHT)}

PROFILE_SQL = """
latest AS (SELECT o_custkey AS customer_id, o_orderkey AS interaction_id FROM orders
           QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
profiles AS (SELECT c_custkey AS customer_id, c_name AS name,
  CASE WHEN c_custkey % 13 <> 0 THEN CAST(20 + c_custkey % 60 AS INTEGER) END AS age,
  CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END AS occupation,
  CASE c_custkey % 4 WHEN 1 THEN 'single' WHEN 2 THEN 'couple' WHEN 3 THEN 'family of ' || (3 + c_custkey % 3) END AS family,
  CASE WHEN c_custkey % 3 <> 0 THEN 'model ' || (c_custkey % 50) END AS current_vehicle,
  CASE c_custkey % 5 WHEN 1 THEN ['safety'] WHEN 2 THEN ['space', NULL, 'price'] WHEN 3 THEN [''] WHEN 4 THEN ['comfort', 'fuel', 'brand']
  END AS preferences,
  CASE c_custkey % 10 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE CAST(trunc(c_acctbal * 0.8) AS BIGINT) END AS budget_min,
  CASE c_custkey % 10 WHEN 1 THEN 0 WHEN 2 THEN NULL ELSE CAST(trunc(c_acctbal * 1.3) AS BIGINT) END AS budget_max,
  text AS transcript
  FROM customer LEFT JOIN latest ON c_custkey = latest.customer_id LEFT JOIN documents ON doc_id = interaction_id),
p AS (SELECT *, coalesce(nullif(budget_min, 0), 0) AS low, coalesce(nullif(budget_max, 0), 99999999) AS high,
  coalesce(nullif(array_to_string(list_filter(preferences, lambda x: x <> ''), ', '), ''), NULL) AS likes FROM profiles)"""


def profiles(spark, sf_dir) -> DataFrame:
    """One row for each customer, with the transcript of its latest interaction where there is one."""
    latest = ranking.latest_per_key(B.interactions(spark, sf_dir).select("customer_id", "interaction_date", "interaction_id"),
                                    ["customer_id"], ["interaction_date", "interaction_id"]).select("customer_id", "interaction_id")
    docs = B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("interaction_id"), F.col("text").alias("transcript"))
    k = F.col("customer_id")
    strings = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    c = B.customers(spark, sf_dir).select(
        "customer_id", "name", F.when(k % 13 != 0, (k % 60 + 20).cast("int")).alias("age"),
        F.when(k % 6 != 0, F.col("occupation")).alias("occupation"),
        F.when(k % 4 == 1, "single").when(k % 4 == 2, "couple").when(
            k % 4 == 3, F.concat(F.lit("family of "), (k % 3 + 3).cast("string"))).alias("family"),
        F.when(k % 3 != 0, F.concat(F.lit("model "), (k % 50).cast("string"))).alias("current_vehicle"),
        F.when(k % 5 == 1, strings("safety")).when(k % 5 == 2, strings("space", None, "price")).when(k % 5 == 3, strings(""))
        .when(k % 5 == 4, strings("comfort", "fuel", "brand")).alias("preferences"),
        F.when(k % 10 == 0, F.lit(0)).when(k % 10 != 1, F.col("budget_min")).cast("long").alias("budget_min"),
        F.when(k % 10 == 1, F.lit(0)).when(k % 10 != 2, F.col("budget_max")).cast("long").alias("budget_max"))
    c = c.withColumn("low", or_default("budget_min", 0).cast("long")).withColumn("high", or_default("budget_max", 99_999_999).cast("long"))
    return c.join(latest, "customer_id", "left").join(docs, "interaction_id", "left")


def _sql_line(label: str, value: str, missing: str | None = "-", tail: str = "") -> str:
    text = f"nullif({value}, '')"
    text = text if missing is None else f"coalesce({text}, '{missing}')"
    return f"'{label}' || {text} || '{tail}'"


def _sql_request(name: str, lines: list[str], source: str = "p", extra: str = "") -> str:
    system = TEMPLATES[name].system
    return (f"WITH {extra}{PROFILE_SQL}\nSELECT customer_id, '{name}' AS template, '{system}' AS system, concat_ws(chr(10), "
            + ", ".join(lines) + f") AS request FROM {source}")


def _last(name: str) -> str:
    return "'" + TEMPLATES[name].lines[-1].label + "'"


_MONEY = "format('{{:,}}', {c})"
_NO_TALK = "coalesce(nullif(transcript, ''), '(no talk was recorded)')"
_TALK = "'Talk:' || chr(10) || nullif(transcript, '')"
_PERSON = [_sql_line("Customer: ", "name"), _sql_line("Age: ", "CAST(age AS VARCHAR)"), _sql_line("Occupation: ", "occupation"),
           _sql_line("Family: ", "family")]
_BUDGET = [_sql_line("Budget from: ", _MONEY.format(c="low"), tail=" yen"), _sql_line("Budget to: ", _MONEY.format(c="high"), tail=" yen")]


@query("request_insight", _sql_request("insight", ["'Describe the customer behind this talk.'", "'Talk:'", _NO_TALK, _last("insight")]))
def request_insight(spark, sf_dir):
    """Insight request from the transcript of the latest interaction."""
    return templates.requests_of(profiles(spark, sf_dir), INSIGHT, "customer_id")


@query("request_needs", _sql_request("needs", ["'Talk:'", _NO_TALK, _last("needs")]))
def request_needs(spark, sf_dir):
    """Request for the fields of a vehicle search."""
    return templates.requests_of(profiles(spark, sf_dir), NEEDS, "customer_id")


@query("request_app_insight", _sql_request("app_insight", [
    "'Describe what this customer needs.'", _sql_line("Name: ", "name"), _sql_line("Age: ", "CAST(age AS VARCHAR)", "unknown"),
    _sql_line("Occupation: ", "occupation", "unknown"), _sql_line("Family: ", "family", "unknown"), _BUDGET[0],
    _sql_line("Budget to: ", _MONEY.format(c="budget_max"), "0", " yen"), _sql_line("Likes: ", "likes", "none"), _TALK, _last("app_insight")]))
def request_app_insight(spark, sf_dir):
    """Insight request from the stored customer, with words for what is unknown."""
    return templates.requests_of(profiles(spark, sf_dir), APP_INSIGHT, "customer_id")


@query("request_recommendation", _sql_request("recommendation", [
    "'Recommend three vehicles for this customer.'", *_PERSON, *_BUDGET, _sql_line("Cares about: ", "likes"), _TALK,
    "'Vehicles:' || chr(10) || coalesce(candidate_text, '-')", _last("recommendation")], "p LEFT JOIN candidate_text USING (customer_id)",
    B.with_ctes("customers", "vehicles")[5:] + "," + CANDIDATE_TEXT_SQL + ","))
def request_recommendation(spark, sf_dir):
    """Recommendation request with profile, transcript and up to 20 candidates of the customer's budget."""
    rows = profiles(spark, sf_dir).join(candidate_text_df(spark, sf_dir).select("customer_id", "candidate_text"), "customer_id", "left")
    return templates.requests_of(rows, RECOMMENDATION, "customer_id")


@query("request_talk_script", _sql_request("talk_script", [
    "'Write what to say to this customer.'", *_PERSON, _sql_line("Current vehicle: ", "current_vehicle"), *_BUDGET,
    _sql_line("Cares about: ", "likes"), "'The customer said: ' || quotes",
    f"'Talk:' || chr(10) || left(nullif(transcript, ''), {TRANSCRIPT_CHARS})", "'Vehicles by rank:'", "coalesce(ranked, '-')",
    _last("talk_script")], "p LEFT JOIN ranked USING (customer_id) LEFT JOIN quotes USING (customer_id)", """
vr AS (SELECT o_custkey AS customer_id, l_linenumber, l_partkey, l_discount, p_brand, p_name,
    CASE WHEN p_partkey % 2 = 0 THEN p_retailprice * 10000 ELSE p_retailprice END AS price,
    row_number() OVER (PARTITION BY o_custkey ORDER BY l_linenumber, l_partkey) AS rn
  FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
  JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey QUALIFY rn <= 3),
ranked AS (SELECT customer_id, string_agg(rn || '. ' || p_brand || ' ' || p_name || ' ('
    || CASE WHEN price >= 10000 THEN format('{:,}', CAST(floor(price / 10000) AS BIGINT)) || '万円' ELSE CAST(price AS VARCHAR) || '円' END
    || '): ' || CASE WHEN l_partkey % 5 = 0 THEN '-' ELSE 'line ' || l_linenumber END, chr(10) ORDER BY rn) AS ranked
  FROM vr GROUP BY customer_id),
quotes AS (SELECT conv_id AS customer_id, string_agg(left(text, 40), ' / ' ORDER BY turn, text) AS quotes
  FROM (SELECT * FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) <= 3)
  WHERE text <> '' GROUP BY conv_id),"""))
def request_talk_script(spark, sf_dir):
    """Talk-script request with the first three vehicles of the latest list, quotes and 2,000 characters of talk."""
    people = profiles(spark, sf_dir)
    v = B.vehicles(spark, sf_dir)
    price = F.when(F.col("vehicle_id") % 2 == 0, F.col("price") * 10_000).otherwise(F.col("price"))
    items = people.select("customer_id", F.col("interaction_id").alias("list_id")).join(
        B.recommendation_items(spark, sf_dir), "list_id").join(
        v.select("vehicle_id", "make", "model", price_label(price).alias("price")), "vehicle_id")
    first = ranking.top_k(items, ["customer_id"], [F.col("pos").asc(), F.col("vehicle_id").asc()], 3)
    reason = F.when(F.col("vehicle_id") % 5 != 0, F.concat(F.lit("line "), F.col("pos").cast("string")))
    ranked = first.groupBy("customer_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "make", "model", "price", reason.alias("reason")))).alias("ranked"))  # three for each customer
    turns = B.chat_turns(spark, sf_dir).where("role = 'user'")
    said = ranking.top_k(turns, ["session_id"], [F.col("turn").asc(), F.col("content").asc()], 3).groupBy(
        F.col("session_id").alias("customer_id")).agg(F.array_sort(F.collect_list(F.struct(
            "rank", F.substring("content", 1, 40).alias("quote")))).alias("q")).select("customer_id", F.col("q.quote").alias("key_quotes"))
    rows = people.join(ranked, "customer_id", "left").join(said, "customer_id", "left")
    return templates.requests_of(rows, TALK_SCRIPT, "customer_id")
