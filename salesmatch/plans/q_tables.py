"""Table-level queries: scans, previews, profiles, key replacement, filters,
search, paging, joins and per-key selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmatch.functions.text import prefix, thousands
from salesmatch.operators import filters, joins, ranking
from salesmatch.plans import bindings as B
from salesmatch.plans.registry import query
from salesmatch.sources import io

_PROFILE_COLS = {
    "region": "r_regionkey,r_name",
    "nation": "n_nationkey,n_name,n_regionkey",
    "customer": "c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment",
    "supplier": "s_suppkey,s_name,s_nationkey,s_acctbal",
    "part": "p_partkey,p_name,p_brand,p_type,p_size,p_retailprice",
    "orders": "o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority",
    "lineitem": "l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,"
                "l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate",
    "events": "event_id,ts,user_id,event_type,value,props",
    "documents": "doc_id,text,lang,source,n_chars",
    "embeddings": "vec_id,embedding,label",
    "pages": "page_id,url,html",
    "benchmark": "item_id,text",
    "labels": "doc_id,quality,toxic",
    "conversations": "conv_id,turn,role,text",
}

_PROFILE_SQL = "WITH p AS (\n" + "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count, CAST({len(c.split(','))} AS BIGINT) "
    f"AS column_count, '{c}' AS columns FROM {t}" for t, c in _PROFILE_COLS.items()
) + "\n)\nSELECT *, CAST(sum(row_count) OVER () AS BIGINT) AS total_rows FROM p"


@query("load_project_preview", """
SELECT p_partkey AS vehicle_id, p_brand AS make, p_name AS model, p_retailprice AS price
FROM part ORDER BY price, vehicle_id LIMIT 100
""")
def load_project_preview(spark, sf_dir):
    """Projected scan, first 100 by price then id."""
    v = B.vehicles(spark, sf_dir).select("vehicle_id", "make", "model", "price")
    return io.preview(v, 100, [F.col("price"), F.col("vehicle_id")])


@query("table_profile", _PROFILE_SQL)
def table_profile(spark, sf_dir):
    """Row and column counts of every table, plus the total."""
    return io.profile_tables({t: B.table(spark, sf_dir, t) for t in _PROFILE_COLS})


@query("replace_by_key", B.with_ctes("interactions") + """
SELECT interaction_id, customer_id, status, amount FROM interactions o
WHERE status = 'O' AND NOT EXISTS (SELECT 1 FROM interactions n
                                   WHERE n.status = 'F' AND n.customer_id = o.customer_id)
UNION ALL
SELECT interaction_id, customer_id, status, amount FROM interactions WHERE status = 'F'
""")
def replace_by_key(spark, sf_dir):
    """The 'O' rows as the stored table, the 'F' rows as the new batch;
    a customer in the batch loses all stored rows and gets the new ones."""
    i = B.interactions(spark, sf_dir).select("interaction_id", "customer_id", "status", "amount")
    old, new = i.where(F.col("status") == "O"), i.where(F.col("status") == "F")
    return io.replace_by_key(old, new, ["customer_id"])


@query("delete_by_key", B.with_ctes("chat_turns") + """
SELECT session_id, turn, role FROM chat_turns t
WHERE NOT EXISTS (SELECT 1 FROM chat_turns s WHERE s.role = 'system' AND s.session_id = t.session_id)
""")
def delete_by_key(spark, sf_dir):
    """Clear every session that holds a system turn."""
    t = B.chat_turns(spark, sf_dir).select("session_id", "turn", "role")
    cleared = t.where(F.col("role") == "system").select("session_id")
    return io.delete_by_key(t, cleared, ["session_id"])


@query("optional_filter", """
SELECT p_partkey AS vehicle_id, p_type AS body_type, p_retailprice AS price
FROM part WHERE p_type = 'SMALL' AND p_retailprice <= 950
""")
def optional_filter(spark, sf_dir):
    """Body type = SMALL, min price 0 (= no filter), max price 950."""
    v = B.vehicles(spark, sf_dir).select("vehicle_id", "body_type", "price")
    return filters.optional_filter(v, body_type="SMALL", min_price=0, max_price=950)


@query("lookup_many", """
SELECT p_partkey AS vehicle_id, p_brand AS make, p_retailprice AS price FROM part
WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')
""")
def lookup_many(spark, sf_dir):
    """Bulk key lookup as a semi join (vehicles returned on some line)."""
    keys = B.table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R").select("l_partkey")
    v = B.vehicles(spark, sf_dir).select("vehicle_id", "make", "price")
    return filters.lookup(v, "vehicle_id", keys)


@query("status_filter", B.with_ctes("traces") + """
SELECT trace_id, ts, trace_name, execution_time_ms FROM traces WHERE status = 'ERROR'
""")
def status_filter(spark, sf_dir):
    """Traces with status ERROR."""
    return B.traces(spark, sf_dir).where(F.col("status") == "ERROR").select(
        "trace_id", "ts", "trace_name", "execution_time_ms")


@query("search_literal", B.with_ctes("customers") + """
SELECT customer_id, name, occupation FROM customers
WHERE contains(lower(name), 'ure') OR contains(lower(occupation), 'ure')
""")
def search_literal(spark, sf_dir):
    """P7/F9: 'Ure' case-insensitively in name or occupation."""
    c = B.customers(spark, sf_dir).select("customer_id", "name", "occupation")
    return filters.search_literal(c, "Ure", ["name", "occupation"])


@query("search_like", B.with_ctes("customers") + """
SELECT customer_id, name, occupation FROM customers
WHERE name LIKE '%1_5%' OR occupation LIKE '%1_5%'
""")
def search_like(spark, sf_dir):
    """LIKE with the wildcard '_' live ('1_5' matches 105, 115, ...)."""
    c = B.customers(spark, sf_dir).select("customer_id", "name", "occupation")
    return filters.search_like(c, "1_5", ["name", "occupation"])


@query("page", B.with_ctes("interactions") + """
SELECT interaction_id, customer_id, interaction_date FROM interactions
ORDER BY interaction_date DESC, interaction_id DESC LIMIT 20 OFFSET 40
""")
def page(spark, sf_dir):
    """O2/O3: third page of 20, newest first, id as tie-break."""
    i = B.interactions(spark, sf_dir).select("interaction_id", "customer_id", "interaction_date")
    return filters.page(i, [F.col("interaction_date").desc(), F.col("interaction_id").desc()],
                        limit=20, offset=40)


@query("interactions_join", B.with_ctes("interactions", "customers") + """
SELECT i.interaction_id, c.name AS customer_name, i.interaction_date,
       format('{:,}', CAST(trunc(i.amount) AS BIGINT)) AS amount_label,
       left(c.name || ' ' || c.occupation, 12) AS summary
FROM interactions i JOIN customers c USING (customer_id)
""")
def interactions_join(spark, sf_dir):
    """Interactions with their customer, a thousands label and a prefix."""
    i = B.interactions(spark, sf_dir).select("interaction_id", "customer_id", "interaction_date", "amount")
    c = B.customers(spark, sf_dir).select("customer_id", "name", "occupation")
    return i.join(c, "customer_id").select(
        "interaction_id", F.col("name").alias("customer_name"), "interaction_date",
        thousands("amount").alias("amount_label"),
        prefix(F.concat_ws(" ", "name", "occupation"), 12).alias("summary"))


@query("evaluation_with_trace", B.with_ctes("evaluations", "traces") + """
SELECT e.evaluation_id, e.rating, t.status AS trace_status, t.execution_time_ms
FROM evaluations e LEFT JOIN traces t USING (trace_id)
""")
def evaluation_with_trace(spark, sf_dir):
    """Each evaluation with its trace (null when the trace is unknown)."""
    e = B.evaluations(spark, sf_dir).select("evaluation_id", "trace_id", "rating")
    t = B.traces(spark, sf_dir).select("trace_id", F.col("status").alias("trace_status"),
                                       "execution_time_ms")
    return e.join(t, "trace_id", "left").drop("trace_id")


@query("enrich_recommendations", B.with_ctes("rec_items", "vehicles") + """
SELECT r.list_id, r.pos, r.vehicle_id, r.match_score, v.make, v.price,
       v.image_path AS image_url
FROM (SELECT * FROM rec_items
      QUALIFY row_number() OVER (PARTITION BY list_id ORDER BY pos, vehicle_id, match_score DESC) <= 3) r
JOIN vehicles v USING (vehicle_id)
""")
def enrich_recommendations(spark, sf_dir):
    """First three items per list joined to the inventory; image_url
    aliased from image_path."""
    items = B.recommendation_items(spark, sf_dir)
    v = filters.alias_missing(B.vehicles(spark, sf_dir).select("vehicle_id", "make", "price", "image_path"),
                              "image_url", "image_path").drop("image_path")
    return joins.enrich(items, v, top_n=3, tie=[F.col("match_score").desc()]).select(
        "list_id", "pos", "vehicle_id", "match_score", "make", "price", "image_url")


@query("latest_per_key", B.with_ctes("interactions") + """
SELECT customer_id, interaction_id, interaction_date FROM interactions
QUALIFY row_number() OVER (PARTITION BY customer_id
                           ORDER BY interaction_date DESC, interaction_id DESC) = 1
""")
def latest_per_key(spark, sf_dir):
    """Latest interaction per customer, ties -> larger id."""
    i = B.interactions(spark, sf_dir).select("customer_id", "interaction_id", "interaction_date")
    return ranking.latest_per_key(i, ["customer_id"], ["interaction_date", "interaction_id"])


@query("rerank_by_score", B.with_ctes("rec_items") + """
SELECT list_id, pos, vehicle_id, match_score,
       CAST(row_number() OVER (PARTITION BY list_id ORDER BY match_score DESC, vehicle_id, pos) AS INTEGER)
         AS score_rank
FROM rec_items
""")
def rerank_by_score(spark, sf_dir):
    """Score rank next to the list position."""
    return ranking.rerank(B.recommendation_items(spark, sf_dir), ["list_id"], "match_score", "vehicle_id",
                          pos="pos")


@query("last_n", B.with_ctes("traces") + """
SELECT trace_name, trace_id, ts,
       CAST(row_number() OVER (PARTITION BY trace_name ORDER BY ts DESC, trace_id DESC) AS INTEGER) AS recency
FROM traces QUALIFY recency <= 5
""")
def last_n(spark, sf_dir):
    """Last five traces of each trace name."""
    t = B.traces(spark, sf_dir).select("trace_name", "trace_id", "ts")
    return ranking.last_n(t, ["trace_name"], "ts", "trace_id", 5)


_ORPHAN_CHECKS = [
    ("lineitem.l_partkey->part", "lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem.l_orderkey->orders", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem.l_suppkey->supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("orders.o_custkey->customer", "orders", "o_custkey", "customer", "c_custkey"),
    ("events.user_id->customer", "events", "user_id", "customer", "c_custkey"),
    ("labels.doc_id->documents", "labels", "doc_id", "documents", "doc_id"),
]


# The given tables hold no orphans: some child keys are made negative and some null, by key.
_DAMAGED = "CASE WHEN {k} % 59 = 3 THEN NULL WHEN {k} % 53 = 7 THEN -{k} - 1 ELSE {k} END"


@query("orphans", "\nUNION ALL\n".join(
    f"SELECT '{n}' AS relation, count(*) AS n_orphans FROM (SELECT {_DAMAGED.format(k=ck)} AS k FROM {c}) x WHERE x.k IS NOT NULL AND "
    f"NOT EXISTS (SELECT 1 FROM {p} y WHERE y.{pk} = x.k)" for n, c, ck, p, pk in _ORPHAN_CHECKS))
def orphans(spark, sf_dir):
    """Foreign keys without a parent, counted per relation; null keys are none."""
    parts: list[DataFrame] = []
    for name, child, ck, parent, pk in _ORPHAN_CHECKS:
        key = F.when(F.col(ck) % 59 == 3, F.lit(None)).when(F.col(ck) % 53 == 7, -F.col(ck) - 1).otherwise(F.col(ck))
        o = joins.orphans(B.table(spark, sf_dir, child).select(key.alias(ck)), B.table(spark, sf_dir, parent).select(pk), ck, pk)
        parts.append(o.agg(F.count(F.lit(1)).alias("n_orphans")).select(
            F.lit(name).alias("relation"), "n_orphans"))
    return reduce(DataFrame.unionByName, parts)
