"""Request/response tables: request building, batch scoring, strict parsing,
rule routing, insight flattening and agent-output folding."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmatch import schemas
from salesmatch.functions import jsonparse
from salesmatch.functions.text import budget_label
from salesmatch.operators import matching, ranking, requests, sessions
from salesmatch.plans import bindings as B
from salesmatch.plans.q_matching import _NEEDS_SQL
from salesmatch.plans.q_metrics import CANDIDATE_TEXT_SQL, candidate_text_df
from salesmatch.plans.registry import query
from salesmatch.session import scratch_path, shared_dir
from salesmatch.sources import io

REPLY_FORMAT = ('Reply with JSON only: {"recommendations": [{"vehicle_id": <id>, '
                '"match_score": <0-100>, "reason": "<text>"}]}')

DEFAULT_CONTEXT = "You help the sales staff with questions about customers and vehicles."


def _context_df(spark, sf_dir):
    cust = B.customers(spark, sf_dir)
    latest = ranking.latest_per_key(
        B.interactions(spark, sf_dir).select("customer_id", "interaction_date", "interaction_type",
                                             "interaction_id"),
        ["customer_id"], ["interaction_date", "interaction_id"])
    cands = candidate_text_df(spark, sf_dir).select("customer_id", "candidate_text")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Customer: "), F.coalesce("name", F.lit("-")), F.lit(" ("),
                 F.coalesce("occupation", F.lit("-")), F.lit(")")),
        F.concat(F.lit("Budget: "), budget_label("budget_min", "budget_max")),
        F.concat(F.lit("Latest interaction: "), F.coalesce(
            F.concat(F.date_format("interaction_date", "yyyy-MM-dd"), F.lit(" "), F.col("interaction_type")),
            F.lit("none"))),
        F.lit("Candidates:"), F.coalesce(F.col("candidate_text"), F.lit("-")),
        F.lit(REPLY_FORMAT))
    return (cust.join(latest, "customer_id", "left").join(cands, "customer_id", "left")
            .select(F.col("customer_id").alias("session_id"), text.alias("context")))


_CONTEXT_SQL = f"""ctx AS (SELECT c.customer_id AS session_id,
   'Customer: ' || c.name || ' (' || c.occupation || ')' || chr(10)
   || 'Budget: ' || CASE WHEN c.budget_min IS NOT NULL AND c.budget_max IS NOT NULL AND c.budget_min <> 0
                              AND c.budget_max <> 0
                         THEN '¥' || format('{{:,}}', c.budget_min) || ' 〜 ¥' || format('{{:,}}', c.budget_max)
                         ELSE '-' END || chr(10)
   || 'Latest interaction: ' || coalesce(strftime(l.interaction_date, '%Y-%m-%d') || ' ' || l.interaction_type,
                                         'none') || chr(10)
   || 'Candidates:' || chr(10) || coalesce(t.candidate_text, '-') || chr(10)
   || '{REPLY_FORMAT}' AS content
   FROM customers c LEFT JOIN latest l USING (customer_id) LEFT JOIN candidate_text t USING (customer_id))"""


@query("request_table", B.with_ctes("customers", "vehicles", "interactions", "chat_turns") + ","
       + CANDIDATE_TEXT_SQL + f""",
latest AS (SELECT customer_id, interaction_date, interaction_type FROM interactions
           QUALIFY row_number() OVER (PARTITION BY customer_id
                                      ORDER BY interaction_date DESC, interaction_id DESC) = 1),
{_CONTEXT_SQL}
SELECT session_id, CAST(-1 AS BIGINT) AS turn, 'system' AS role, content FROM ctx
UNION ALL
SELECT DISTINCT session_id, CAST(-1 AS BIGINT), 'system', '{DEFAULT_CONTEXT}' FROM chat_turns
WHERE session_id NOT IN (SELECT customer_id FROM customers)
UNION ALL
SELECT session_id, turn, role, content FROM chat_turns
""")
def request_table(spark, sf_dir):
    """One request per customer: a system context row (profile, budget,
    latest interaction, candidate block, reply format) followed by the
    customer's conversation turns. Sessions without a customer keep their turns behind a default context."""
    turns = B.chat_turns(spark, sf_dir)
    return sessions.with_context(turns, sessions.default_contexts(turns, _context_df(spark, sf_dir), DEFAULT_CONTEXT), "context")


@query("session_requests", B.with_ctes("customers", "chat_turns") + f""",
s AS (SELECT DISTINCT session_id, session_id * 31 AS customer_id FROM chat_turns)
SELECT s.session_id, CAST(-1 AS BIGINT) AS turn, 'system' AS role,
       '{DEFAULT_CONTEXT}' || coalesce(chr(10) || 'Customer in view: ' || c.customer_id || ' (' || c.name || ')', '') AS content
FROM s LEFT JOIN customers c USING (customer_id)
UNION ALL SELECT session_id, turn, role, content FROM chat_turns WHERE role <> 'system'
""")
def session_requests(spark, sf_dir):
    """Every session's request: the assistant's context, the customer in view if the session has one (here
    the customer of 31 times its number, which many sessions lack), and the visible turns."""
    turns = B.chat_turns(spark, sf_dir).where("role <> 'system'")
    every = B.chat_turns(spark, sf_dir).select("session_id").distinct()
    seen = every.withColumn("customer_id", F.col("session_id") * 31).join(
        B.customers(spark, sf_dir).select("customer_id", "name"), "customer_id", "left")
    line = F.concat(F.lit("\nCustomer in view: "), F.col("customer_id").cast("string"), F.lit(" ("), F.col("name"), F.lit(")"))
    return sessions.with_context(turns, seen.select("session_id", F.concat(
        F.lit(DEFAULT_CONTEXT), F.coalesce(line, F.lit(""))).alias("context")), "context")


SCORED_AT = "2026-01-01 00:00:00"


def scoring_requests(spark, sf_dir):
    """One row for each customer: its request text, up to 20 candidates as arrays in price order (the first of the
    inventory where its budget holds none), the exact budget, and the wishes taken from its purchases."""
    v, c = B.vehicles(spark, sf_dir), B.customers(spark, sf_dir)
    needs = matching.needs_from_history(B.purchases(spark, sf_dir), v).select(
        "customer_id", F.col("desired_body_type").alias("body_type"), F.get("must_have_features", F.lit(0)).alias("word"))
    low, high = matching.exact_bounds()
    found = matching.exact_candidates(c, v).join(v.select("vehicle_id", "price", F.col("body_type").alias("body"), "features"), "vehicle_id")
    entry = F.struct("rank", "vehicle_id", "price", "body", F.when(F.col("word").isNotNull(), F.array_contains("features", F.col("word"))).alias("has"))
    listed = found.join(needs, "customer_id", "left").groupBy("customer_id").agg(F.array_sort(F.collect_list(entry)).alias("i"))  # 20 at most
    return c.select("customer_id", low.alias("low"), high.alias("high")).join(needs, "customer_id", "left").join(listed, "customer_id", "left").join(
        _context_df(spark, sf_dir).select(F.col("session_id").alias("customer_id"), F.col("context").alias("request")), "customer_id").select(
        "customer_id", "request", "low", "high", "body_type", F.col("i.vehicle_id").alias("vehicle_ids"), F.col("i.price").alias("prices"),
        F.col("i.body").alias("body_types"), F.col("i.has").alias("has_feature"))


@query("batch_score", B.with_ctes("customers", "vehicles", "purchases", "interactions") + "," + CANDIDATE_TEXT_SQL + "," + _NEEDS_SQL + f""",
latest AS (SELECT customer_id, interaction_date, interaction_type FROM interactions
           QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY interaction_date DESC, interaction_id DESC) = 1),
{_CONTEXT_SQL},
b AS (SELECT customer_id, CAST(coalesce(nullif(budget_min, 0), 0) AS BIGINT) AS low, CAST(coalesce(nullif(budget_max, 0), 99999999) AS BIGINT) AS high
      FROM customers),
m AS (SELECT b.*, v.vehicle_id, v.price, v.body_type, v.features FROM b JOIN vehicles v ON v.price BETWEEN b.low AND b.high
      QUALIFY row_number() OVER (PARTITION BY b.customer_id ORDER BY v.price, v.vehicle_id) <= 20),
f AS (SELECT * FROM m UNION ALL SELECT b.*, v.vehicle_id, v.price, v.body_type, v.features
      FROM b, (SELECT * FROM vehicles ORDER BY price, vehicle_id LIMIT 20) v WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.customer_id = b.customer_id)),
s AS (SELECT f.*, CAST(CASE WHEN price BETWEEN low AND high THEN 40 ELSE 20 END
        + CASE WHEN desired_body_type IS NULL THEN 15 WHEN body_type = desired_body_type THEN 30 ELSE 0 END
        + CASE WHEN must_have_features IS NULL THEN 15 WHEN list_contains(features, must_have_features[1]) THEN 30 ELSE 0 END AS INTEGER) AS match_score,
        desired_body_type FROM f LEFT JOIN needs USING (customer_id)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY match_score DESC, price, vehicle_id) AS INTEGER) AS position FROM s)
SELECT sha256(customer_id || '|' || position) AS recommendation_id, customer_id, position, vehicle_id, match_score,
       CASE WHEN price BETWEEN low AND high THEN 'in budget' ELSE 'over budget' END
       || CASE WHEN body_type = desired_body_type THEN ', wanted body type' ELSE '' END AS reason,
       CAST(length(ctx.content) AS INTEGER) AS request_chars, TIMESTAMP '{SCORED_AT}' AS generated_at, 'rule-ranker' AS model_used
FROM r JOIN ctx ON ctx.session_id = customer_id WHERE position <= 3
""")
def batch_score(spark, sf_dir):
    """Every customer's request is scored in Arrow batches by a pluggable scorer, here one that ranks the
    request's candidates; typed responses are stamped (key-derived id, fixed time, model). Responses are checkpointed
    to the shared folder so a lost executor never re-runs the scorer for finished partitions."""
    shared_dir(spark)
    schema = T.StructType([*requests.RESPONSE_SCHEMA.fields, T.StructField("request_chars", T.IntegerType())])
    resp = requests.score_batch(scoring_requests(spark, sf_dir), _rank_and_measure, schema=schema).checkpoint()
    stamped = io.stamp(resp, "recommendation_id", "rule-ranker", ["customer_id", "position"], SCORED_AT)
    return stamped.select("recommendation_id", "customer_id", "position", "vehicle_id", "match_score", "reason", "request_chars",
                          "generated_at", "model_used")


def _rank_and_measure(batch):
    """The default ranking, and the length of the request text that it belongs to."""
    out = requests.rank_candidates(batch)
    return out.assign(request_chars=batch["request"].str.len().loc[out.index].astype("int32"))


SAVED_AT, RESAVED_AT = "2026-01-01 00:00:00", "2026-02-01 00:00:00"


def _saved_lists(spark, sf_dir, orders, at):
    """One stamped row per customer: the vehicles of its order ``list_id`` as JSON text,
    by line, then vehicle id as text, then score."""
    items = orders.join(B.recommendation_items(spark, sf_dir), "list_id").join(
        B.vehicles(spark, sf_dir).select("vehicle_id", "make", "model", "image_path"), "vehicle_id")
    entry = F.struct("pos", F.struct(
        F.struct(F.col("vehicle_id").cast("string").alias("vehicle_id"), "make", "model", "image_path").alias("vehicle"),
        "match_score", F.concat(F.lit("line "), F.col("pos").cast("string")).alias("reason")).alias("item"))
    lists = items.groupBy("customer_id", "list_id").agg(F.array_sort(F.collect_list(entry)).alias("_items")).select(
        "customer_id", "list_id", F.to_json(F.col("_items.item")).alias("recommendations_json"),
        F.concat(F.lit("List "), F.col("list_id").cast("string")).alias("talk_script"))
    return io.stamp(lists, "recommendation_id", "list-writer", ["customer_id", "list_id"], at)


@query("save_cycle", B.with_ctes("interactions", "rec_items", "vehicles") + """,
lists AS (SELECT customer_id, max(interaction_id) AS last_list, min(interaction_id) AS first_list
          FROM interactions
          WHERE interaction_id IN (SELECT list_id FROM rec_items JOIN vehicles USING (vehicle_id))
          GROUP BY customer_id),
stored AS (SELECT customer_id, CASE WHEN customer_id % 3 = 0 THEN first_list ELSE last_list END AS list_id
           FROM lists)
SELECT s.customer_id,
       CAST(row_number() OVER (PARTITION BY s.customer_id ORDER BY r.pos, CAST(v.vehicle_id AS VARCHAR), r.match_score) AS INTEGER) AS position,
       'List ' || CAST(s.list_id AS VARCHAR) AS talk_script, CAST(v.vehicle_id AS VARCHAR) AS vehicle_id,
       v.make, v.image_path AS image_url, r.match_score, 'line ' || CAST(r.pos AS VARCHAR) AS reason
FROM stored s JOIN rec_items r USING (list_id) JOIN vehicles v USING (vehicle_id)
""")
def save_cycle(spark, sf_dir):
    """Stamped lists of every customer's newest order are
    stored in the shared folder; every third customer's list is regenerated (its
    oldest order) and replaces the stored one by key; the stored table is read
    back, latest list per customer, one row per item."""
    listed = B.recommendation_items(spark, sf_dir).join(
        B.vehicles(spark, sf_dir).select("vehicle_id"), "vehicle_id", "left_semi")
    ends = B.interactions(spark, sf_dir).join(
        listed, F.col("interaction_id") == F.col("list_id"), "left_semi").groupBy("customer_id").agg(
        F.max("interaction_id").alias("last_list"), F.min("interaction_id").alias("first_list"))
    first, second = scratch_path(spark, "saved"), scratch_path(spark, "saved")
    io.overwrite(_saved_lists(spark, sf_dir, ends.select("customer_id", F.col("last_list").alias("list_id")), SAVED_AT),
                 first)
    again = ends.where("customer_id % 3 = 0").select("customer_id", F.col("first_list").alias("list_id"))
    io.write_replacing(spark, first, _saved_lists(spark, sf_dir, again, RESAVED_AT), ["customer_id"], second)
    return requests.read_cached(io.read_table(spark, second)).select(
        "customer_id", "position", "talk_script", F.col("vehicle.vehicle_id").alias("vehicle_id"),
        F.col("vehicle.make").alias("make"), F.col("vehicle.image_url").alias("image_url"), "match_score", "reason")


_RAW_SQL = """
src AS (SELECT l_orderkey, l_linenumber, l_partkey,
          '{"order":' || CAST(l_orderkey AS VARCHAR) || ',"part":' || CAST(l_partkey AS VARCHAR)
          || ',"qty":' || CAST(l_quantity AS VARCHAR) || '}' AS j
        FROM lineitem),
raw AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber
          WHEN 1 THEN j
          WHEN 2 THEN 'Sure! ' || j || ' Hope this helps.'
          WHEN 3 THEN j || ' and ' || j
          WHEN 4 THEN '```json' || chr(10) || j || chr(10) || '```'
          WHEN 5 THEN '```' || chr(10) || j || chr(10) || '``` done'
          WHEN 6 THEN left(j, length(j) - 1)
          ELSE 'I cannot answer that.' END AS text
        FROM src)"""

_PAYLOAD = T.StructType([T.StructField("order", T.LongType()), T.StructField("part", T.LongType()),
                         T.StructField("qty", T.DoubleType())])


def _raw_responses(spark, sf_dir):
    """Model-like reply texts built from line items: the reply shape depends on
    the line number (bare, prose around, two objects, fenced, bare fence,
    broken, no JSON), so every parse branch sees real rows."""
    li = B.table(spark, sf_dir, "lineitem")
    j = F.concat(F.lit('{"order":'), F.col("l_orderkey").cast("string"), F.lit(',"part":'),
                 F.col("l_partkey").cast("string"), F.lit(',"qty":'), F.col("l_quantity").cast("string"),
                 F.lit("}"))
    n = F.col("l_linenumber")
    text = (F.when(n == 1, j)
            .when(n == 2, F.concat(F.lit("Sure! "), j, F.lit(" Hope this helps.")))
            .when(n == 3, F.concat(j, F.lit(" and "), j))
            .when(n == 4, F.concat(F.lit("```json\n"), j, F.lit("\n```")))
            .when(n == 5, F.concat(F.lit("```\n"), j, F.lit("\n``` done")))
            .when(n == 6, F.substring(j, F.lit(1), F.length(j) - 1))
            .otherwise(F.lit("I cannot answer that.")))
    return li.select("l_orderkey", "l_linenumber", text.alias("text"))


def _strict_sql(x: str) -> str:
    return f"(CASE WHEN coalesce(json_valid({x}), false) THEN json_type({x}) = 'OBJECT' ELSE false END)"


_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_FENCE = ("CASE WHEN contains(text, '```json') THEN split_part(split_part(text, '```json', 2), '```', 1) "
          "WHEN contains(text, '```') THEN split_part(text, '```', 2) ELSE text END")


@query("parse_brace", "WITH " + _RAW_SQL.strip() + """,
cut AS (SELECT *, regexp_extract(text, '\\{.*\\}', 0, 's') AS c FROM raw)
SELECT l_orderkey, l_linenumber, """ + _strict_sql("c") + """ AS ok,
       CASE WHEN """ + _strict_sql("c") + """ THEN CAST(json_extract(c, '$.part') AS BIGINT) END AS part,
       CASE WHEN """ + _strict_sql("c") + """ THEN CAST(json_extract(c, '$.qty') AS DOUBLE) END AS qty
FROM cut
""")
def parse_brace(spark, sf_dir):
    """Brace cut + strict parse of every reply."""
    parsed = jsonparse.with_parsed(_raw_responses(spark, sf_dir), "text", _PAYLOAD, "brace")
    return parsed.select("l_orderkey", "l_linenumber", "ok", F.col("parsed.part").alias("part"),
                         F.col("parsed.qty").alias("qty"))


@query("parse_fence", "WITH " + _RAW_SQL.strip() + f""",
f AS (SELECT *, {_FENCE} AS fenced FROM raw),
g AS (SELECT *, regexp_extract(fenced, '\\{{.*\\}}', 0, 's') AS rec_cut,
             {_STRIP.format(x="fenced")} AS ins_cut FROM f)
SELECT l_orderkey, l_linenumber,
       {_strict_sql("rec_cut")} AS ok_rec,
       CASE WHEN {_strict_sql("rec_cut")} THEN CAST(json_extract(rec_cut, '$.part') AS BIGINT) END AS rec_part,
       {_strict_sql("ins_cut")} AS ok_insight,
       coalesce(CASE WHEN {_strict_sql("ins_cut")} THEN CAST(json_extract(ins_cut, '$.part') AS BIGINT) END,
                -1) AS insight_part
FROM g
""")
def parse_fence(spark, sf_dir):
    """Fence cut; the recommendation variant then cuts to
    braces, the insight variant parses the stripped block as is and falls back
    to a constant record (part -1) when that fails."""
    raw = _raw_responses(spark, sf_dir)
    both = jsonparse.with_parses(raw, "text", _PAYLOAD, [("fenced_braced", "ok_rec", "rec"), ("fenced", "ok_insight", "ins")])
    return both.select("l_orderkey", "l_linenumber", "ok_rec", F.col("rec.part").alias("rec_part"),
                       "ok_insight", F.coalesce(F.col("ins.part"), F.lit(-1).cast("bigint"))
                       .alias("insight_part"))


# What the odd turns of a session end with, by its number; the fourth holds two keywords.
_ASKED = ["Please give an INSIGHT.", "レコメンドして", "Write a talk Script", "インサイトとレコメンド"]


@query("rule_route", B.with_ctes("chat_turns") + """,
asked AS (SELECT session_id, turn, content || CASE WHEN turn % 2 = 0 THEN '' ELSE CASE session_id % 5 """
       + " ".join(f"WHEN {i} THEN ' {t}'" for i, t in enumerate(_ASKED)) + """ ELSE '' END END AS content FROM chat_turns),
l AS (SELECT session_id, max(turn) AS last_turn, coalesce(arg_max(content, turn), '') AS t FROM asked GROUP BY session_id)
SELECT session_id, last_turn, CASE WHEN contains(t, 'インサイト') OR contains(lower(t), 'insight') THEN 'insight'
            WHEN contains(t, 'レコメンド') OR contains(lower(t), 'recommend') THEN 'recommendation'
            WHEN contains(t, 'トーク') OR contains(lower(t), 'script') THEN 'talk_script' ELSE 'default' END AS route
FROM l
""")
def rule_route(spark, sf_dir):
    """Canned-answer class of each session's last message; the keywords are added to odd turns by session."""
    t = B.chat_turns(spark, sf_dir)
    asked = F.lit("")
    for i, words in enumerate(_ASKED):
        asked = F.when(F.col("session_id") % 5 == i, F.lit(f" {words}")).otherwise(asked)
    return requests.last_message_route(t.withColumn("content", F.concat("content", F.when(F.col("turn") % 2 == 0, "").otherwise(asked))))


@query("insight_rows", B.with_ctes("chat_turns") + """
SELECT session_id, turn, role AS life_stage, '-' AS "values",
       concat_ws(' | ', nullif(split_part(content, ' ', 1), ''),
                 nullif(CASE WHEN length(content) > 20 THEN left(content, 20) || '...' ELSE content END, ''))
         AS persona_tags,
       coalesce(nullif(array_to_string(string_split(content, chr(10)), ', '), ''), '-') AS unstated_needs,
       '-' AS emotional_drivers,
       coalesce(nullif(array_to_string(list_slice(string_split(content, '. '), 1, 3), ' | '), ''), '-')
         AS key_quotes,
       CAST(len(list_slice(string_split(content, '. '), 1, 3)) AS INTEGER) AS n_quotes
FROM chat_turns
""")
def insight_rows(spark, sf_dir):
    """A nested insight per turn is written as JSON text, read back
    with the insight schema, and flattened into display columns."""
    t = B.chat_turns(spark, sf_dir)
    insight = F.struct(
        F.struct(F.col("role").alias("life_stage"), F.lit(None).cast("string").alias("values"),
                 F.element_at(F.split("content", " "), 1).alias("personality"),
                 F.col("content").alias("lifestyle")).alias("customer_persona"),
        F.struct(F.split("content", "\n").alias("unstated_needs"),
                 F.array().cast("array<string>").alias("emotional_drivers")).alias("deep_needs"),
        F.split("content", r"\. ").alias("key_quotes"))
    as_text = t.select("session_id", "turn", F.to_json(insight).alias("insight_json"))
    parsed = as_text.select("session_id", "turn",
                            F.from_json("insight_json", schemas.CUSTOMER_INSIGHT).alias("insight"))
    return parsed.select("session_id", "turn", *requests.insight_display("insight"))


# Own tags and wording: the rules are a parameter of the fold.
OUTPUT_RULES = [
    requests.OutputRule("prefix", "<name>manuals</name>", "Reading the manuals..."),
    requests.OutputRule("anywhere", "SalesBook", "Reading the sales records..."),
    requests.OutputRule("anywhere_any_case", "<name>websearch", "Searching the web..."),
    requests.OutputRule("prefix", "<name>", "Asking another agent..."),
]


def _rule_sql(rule: requests.OutputRule, text: str) -> str:
    return {"prefix": f"starts_with({text}, '{rule.pattern}')", "anywhere": f"contains({text}, '{rule.pattern}')",
            "anywhere_any_case": f"contains(lower({text}), '{rule.pattern.lower()}')"}[rule.how]


def _kind_sql(rules: list[requests.OutputRule]) -> str:
    """CASE of each item's message, '' for an answer and NULL for what is skipped, from the rule table."""
    tests = " ".join(f"WHEN {_rule_sql(r, 'text')} THEN '{r.message}'" for r in rules)
    return (f"CASE WHEN type = 'function_call' THEN '{requests.TOOL_MESSAGE}' WHEN type <> 'message' OR role <> 'assistant' "
            f"OR coalesce(text, '') = '' THEN NULL {tests} WHEN length(text) < {requests.ROUTING_MAX_LEN} "
            "AND regexp_matches(text, '^\\s*<') THEN NULL ELSE '' END")


@query("agent_fold", B.with_ctes("chat_turns") + f""",
items AS (SELECT session_id, turn AS pos, CASE WHEN role = 'system' THEN 'function_call' ELSE 'message' END AS type,
                 role, content AS text, CASE WHEN role = 'assistant' THEN content END AS alt FROM chat_turns),
k AS (SELECT *, {_kind_sql(OUTPUT_RULES)} AS msg FROM items)
SELECT session_id, count(*) FILTER (WHERE msg <> '') AS n_progress,
       arg_max(msg, pos) FILTER (WHERE msg <> '') AS last_progress,
       coalesce(arg_max(text, pos) FILTER (WHERE msg = ''), arg_min(alt, pos) FILTER (WHERE alt IS NOT NULL), '') AS final_answer
FROM k GROUP BY session_id
""")
def agent_fold(spark, sf_dir):
    """Each conversation read as an agent output list (system
    turns = tool calls): progress lines and the final answer, with the first
    assistant text as the alternative path."""
    t = B.chat_turns(spark, sf_dir)
    items = t.select("session_id", F.col("turn").alias("pos"),
                     F.when(F.col("role") == "system", F.lit("function_call")).otherwise(F.lit("message"))
                     .alias("type"), "role", F.col("content").alias("text"),
                     F.when(F.col("role") == "assistant", F.col("content")).alias("alt"))
    return requests.agent_fold(items, OUTPUT_RULES, "session_id", "pos", alt="alt")


@query("agent_responses", """
WITH items AS (SELECT l_orderkey AS response_id, l_linenumber AS n, l_partkey AS p, CASE l_partkey % 10
  WHEN 0 THEN 'Calling a tool...' WHEN 2 THEN 'Reading the manuals...' WHEN 4 THEN 'Reading the sales records...'
  WHEN 5 THEN 'Searching the web...' WHEN 6 THEN 'Asking another agent...' END AS message,
  CASE l_partkey % 10 WHEN 3 THEN 'Take part ' || l_partkey || '.' WHEN 8 THEN '<b>' || repeat('long ', 20) || '</b>' END AS answer
  FROM lineitem),
f AS (SELECT response_id, count(message) AS n_progress,
  string_agg(message, ' / ' ORDER BY n, p) FILTER (WHERE message IS NOT NULL) AS progress,
  arg_max(message, (n, p)) FILTER (WHERE message IS NOT NULL) AS last_progress,
  arg_max(answer, (n, p)) FILTER (WHERE answer IS NOT NULL) AS answer FROM items GROUP BY response_id)
SELECT response_id, response_id % 11 <> 0 AS ok,
  CAST(CASE WHEN response_id % 11 = 0 THEN 0 ELSE n_progress END AS INTEGER) AS n_progress,
  CASE WHEN response_id % 11 = 0 THEN '' ELSE coalesce(progress, '') END AS progress,
  CASE WHEN response_id % 11 <> 0 THEN last_progress END AS last_progress,
  CASE WHEN response_id % 11 = 0 THEN '' ELSE coalesce(answer, CASE WHEN response_id % 3 = 0 THEN 'Other path.' END, '') END AS final_answer
FROM f
""")
def agent_responses(spark, sf_dir):
    """One response for each order, its lines as output items with no, one or three contents; every third
    has the alternative path and every eleventh is cut off. Every rule, noise, tool calls and other roles occur."""
    li = B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("response_id"), "l_linenumber", F.col("l_partkey").alias("p"))

    def item(role, *contents, kind="message"):
        return F.struct(F.lit(kind).alias("type"), F.lit(role).alias("role"), F.array(*[
            F.struct(F.lit(t).alias("type"), x.alias("text")) for t, x in contents]).cast(schemas.CONTENT).alias("content"))

    def says(x, role="assistant"):
        return item(role, ("output_text", x if not isinstance(x, str) else F.lit(x)))

    forms = [item(None, kind="function_call"), item("assistant"), says("<name>manuals</name>"),
             item("assistant", ("reasoning", F.lit("Hidden.")), ("output_text", F.lit("")),
                  ("output_text", F.concat(F.lit("Take part "), F.col("p").cast("string"), F.lit(".")))),
             says("Opening SalesBook now"), says("see <NAME>WebSearch</NAME>"), says("<name>other</name>"),
             says("  <think>"), says("<b>" + "long " * 20 + "</b>"), says("What about it?", "user")]
    case = F.when(F.lit(False), forms[0])
    for n, form in enumerate(forms):
        case = case.when(F.col("p") % 10 == n, form)
    entry = F.struct("l_linenumber", "p", case.alias("item"))
    lists = li.groupBy("response_id").agg(F.array_sort(F.collect_list(entry)).alias("i"))  # the lines of one order
    other = F.when(F.col("response_id") % 3 == 0, F.array(F.struct(F.struct(F.lit("Other path.").alias("content")).alias("message"))))
    text = F.to_json(F.struct(F.col("i.item").alias("output"), other.alias("choices")))
    cut = F.when(F.col("response_id") % 11 == 0, F.substring(text, F.lit(1), F.lit(9))).otherwise(text)
    out = requests.fold_responses(lists.select("response_id", cut.alias("response")), "response", OUTPUT_RULES)
    return out.withColumn("progress", F.array_join("progress", " / "))
