"""Bindings of the data model's concepts onto the driver's parquet tables.

Each binding is a projection of one driver table (so column pruning and
filter pushdown reach the scan) and has a SQL twin in ``SQL`` that the DuckDB
oracle uses with the same meaning.

customer -> customers   budget band [trunc(bal*0.8), trunc(bal*1.3)], open for some keys
part     -> vehicles    price=p_retailprice, make=p_brand, body=p_type,
                        features=split(p_name, ' '), every seventh sold
orders   -> interactions (dated, per customer) and evaluations
                        (rating = first digit of o_orderpriority, trace_id = o_orderkey)
lineitem -> recommendation items (list = order, pos = line number,
                        score = 100 - discount*100)
events   -> traces      status ERROR for event_type 'error', latency = value,
                        tokens = props.k (ok traces only), name = event_type
conversations -> chat turns (session = conv_id)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(rows: DataFrame, per_task: int) -> DataFrame:
    """``rows`` dealt to tasks of about ``per_task``: a table whose file is one row group is else read by one task,
    which then does all that follows up to the next shuffle. For narrow rows that much is made of."""
    tasks = -(-rows.count() // per_task)
    return rows.repartition(tasks) if tasks > 1 else rows


def customers(spark: SparkSession, sf_dir: str, scaled: bool = False) -> DataFrame:
    """Customers with a budget band. ``scaled`` maps balances onto the
    inventory's price range (lo = 900 + floor(max(bal,0)/10000*80), hi = lo+20)
    so that nearly every customer has candidates (used by the flagship); other
    budgets are open (0 or null) at one end or both for three in ten customers."""
    c = table(spark, sf_dir, "customer")
    if scaled:
        lo = (F.lit(900) + F.floor(F.greatest(F.col("c_acctbal"), F.lit(0.0)) / 10000 * 80)).cast("bigint")
        hi = lo + 20
    else:
        k = F.col("c_custkey") % 10
        lo = F.when(k == 0, F.lit(0)).when(k != 1, (F.col("c_acctbal") * 0.8).cast("bigint"))
        hi = F.when(k == 1, F.lit(0)).when(k != 2, (F.col("c_acctbal") * 1.3).cast("bigint"))
    return c.select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("occupation"), F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"), lo.alias("budget_min"), hi.alias("budget_max"))


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("vehicle_id"), F.col("p_brand").alias("make"),
        F.col("p_name").alias("model"), F.col("p_type").alias("body_type"),
        F.col("p_size").alias("seating_capacity"), F.col("p_retailprice").alias("price"),
        F.split(F.col("p_name"), " ").alias("features"),
        F.when(F.col("p_partkey") % 7 == 3, F.lit("sold")).otherwise(F.lit("in_stock")).alias("stock_status"),
        F.concat(F.lit("images/"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("image_path"))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("interaction_id"), F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("interaction_date"),
        F.col("o_orderpriority").alias("interaction_type"),
        F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"))


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("evaluation_id"), F.col("o_orderkey").alias("trace_id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("rating"),
        F.when(F.col("o_orderstatus") == "F", F.lit("reviewed")).alias("ground_truth"),
        F.col("o_orderdate").alias("evaluated_at"))


def recommendation_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("list_id"), F.col("l_linenumber").alias("pos"),
        F.col("l_partkey").alias("vehicle_id"),
        F.round(F.lit(100.0) - F.col("l_discount") * 100).cast("int").alias("match_score"))


def traces(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Traces of the events table, or of ``events``, rows of it that the caller has chosen."""
    e = table(spark, sf_dir, "events") if events is None else events
    ok = F.col("event_type") != "error"
    return e.select(
        F.col("event_id").alias("trace_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id"), F.col("event_type").alias("trace_name"),
        F.when(ok, F.lit("OK")).otherwise(F.lit("ERROR")).alias("status"),
        F.col("value").alias("execution_time_ms"),
        F.when(ok, F.get_json_object("props", "$.k").cast("int")).alias("total_tokens"),
        F.col("props"))


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("session_id"), "turn", "role",
                    F.col("text").alias("content"))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase history: (customer_id, vehicle_id) per line item, through orders."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("list_id"),
                                              F.col("o_custkey").alias("customer_id"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("list_id"),
                                                 F.col("l_partkey").alias("vehicle_id"))
    return li.join(o, "list_id").select("customer_id", "vehicle_id")


# SQL twins (DuckDB) of the bindings above, used as CTEs by the oracle.
SQL = {
    "customers": """
        SELECT c_custkey AS customer_id, c_name AS name, c_mktsegment AS occupation,
               c_mktsegment AS segment, c_acctbal AS balance,
               CASE c_custkey % 10 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE CAST(trunc(c_acctbal * 0.8) AS BIGINT) END AS budget_min,
               CASE c_custkey % 10 WHEN 1 THEN 0 WHEN 2 THEN NULL ELSE CAST(trunc(c_acctbal * 1.3) AS BIGINT) END AS budget_max
        FROM customer""",
    "customers_scaled": """
        SELECT c_custkey AS customer_id, c_name AS name, c_mktsegment AS occupation,
               c_mktsegment AS segment, c_acctbal AS balance,
               CAST(900 + floor(greatest(c_acctbal, 0.0) / 10000 * 80) AS BIGINT) AS budget_min,
               CAST(900 + floor(greatest(c_acctbal, 0.0) / 10000 * 80) AS BIGINT) + 20 AS budget_max
        FROM customer""",
    "vehicles": """
        SELECT p_partkey AS vehicle_id, p_brand AS make, p_name AS model, p_type AS body_type,
               p_size AS seating_capacity, p_retailprice AS price,
               string_split(p_name, ' ') AS features, CASE WHEN p_partkey % 7 = 3 THEN 'sold' ELSE 'in_stock' END AS stock_status,
               'images/' || CAST(p_partkey AS VARCHAR) || '.png' AS image_path
        FROM part""",
    "interactions": """
        SELECT o_orderkey AS interaction_id, o_custkey AS customer_id,
               o_orderdate AS interaction_date, o_orderpriority AS interaction_type,
               o_orderstatus AS status, o_totalprice AS amount
        FROM orders""",
    "evaluations": """
        SELECT o_orderkey AS evaluation_id, o_orderkey AS trace_id,
               CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS rating,
               CASE WHEN o_orderstatus = 'F' THEN 'reviewed' END AS ground_truth,
               o_orderdate AS evaluated_at
        FROM orders""",
    "rec_items": """
        SELECT l_orderkey AS list_id, l_linenumber AS pos, l_partkey AS vehicle_id,
               CAST(round(100.0 - l_discount * 100) AS INTEGER) AS match_score
        FROM lineitem""",
    "traces": """
        SELECT event_id AS trace_id, ts, user_id, event_type AS trace_name,
               CASE WHEN event_type <> 'error' THEN 'OK' ELSE 'ERROR' END AS status,
               value AS execution_time_ms,
               CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS total_tokens,
               props
        FROM events""",
    "chat_turns": """
        SELECT conv_id AS session_id, turn, role, text AS content FROM conversations""",
    "purchases": """
        SELECT o_custkey AS customer_id, l_partkey AS vehicle_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
}


def with_ctes(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` for the named bindings."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + "\n"
