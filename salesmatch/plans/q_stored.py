"""Queries on stored tables: append, replace and delete by key, versions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from salesmatch import schemas
from salesmatch.operators import filters, paging
from salesmatch.plans import bindings as B
from salesmatch.plans.registry import query
from salesmatch.session import scratch_path
from salesmatch.sources import io
from salesmatch.sources.keyed import KeyedTable
from salesmatch.streaming import session_store

STORED_AT, CHANGED_AT = "2026-01-01 00:00:00", "2026-02-01 00:00:00"


@query("keyed_versions", B.with_ctes("interactions") + f"""
, stored AS (
  SELECT customer_id, interaction_id, amount, 'first' AS origin FROM interactions
  UNION ALL SELECT customer_id, interaction_id, -amount, 'appended' FROM interactions WHERE interaction_id % 5 = 0),
v3 AS (
  SELECT * FROM stored WHERE customer_id % 7 <> 0
  UNION ALL SELECT customer_id, max(interaction_id), max(amount), 'replaced' FROM interactions
            WHERE customer_id % 7 = 0 GROUP BY customer_id),
v4 AS (SELECT * FROM v3 WHERE customer_id % 11 <> 0),
every AS (SELECT 1 AS version, * FROM (SELECT * FROM stored WHERE origin = 'first') UNION ALL SELECT 2, * FROM stored
          UNION ALL SELECT 3, * FROM v3 UNION ALL SELECT 4, * FROM v4)
SELECT CAST(version AS INTEGER) AS version, customer_id, count(*) AS n_rows, max(interaction_id) AS last_interaction,
       CAST(sum(CAST(amount AS DECIMAL(18, 2))) AS DOUBLE) AS amount, string_agg(DISTINCT origin, ',' ORDER BY origin) AS origins,
       CASE WHEN customer_id % 7 = 0 AND version >= 3 THEN TIMESTAMP '{CHANGED_AT}'
            WHEN version >= 2 AND string_agg(DISTINCT origin, ',') LIKE '%appended%' THEN TIMESTAMP '{CHANGED_AT}'
            ELSE TIMESTAMP '{STORED_AT}' END AS last_change
FROM every GROUP BY version, customer_id
""")
def keyed_versions(spark, sf_dir):
    """Stamped interactions are stored by customer bucket; every fifth is appended again with the
    opposite amount, every seventh customer's rows are replaced by one, every eleventh customer is deleted. The
    result describes each customer in each of the four versions, read back from the stored files."""
    i = B.interactions(spark, sf_dir).select("customer_id", "interaction_id", F.col("amount").cast("decimal(18,2)").alias("amount"))

    def record(rows, origin, at):
        return io.stamp(rows.withColumn("origin", F.lit(origin)), "record_id", "order-intake",
                        ["customer_id", "interaction_id", "origin"], at)

    t = KeyedTable.create(spark, scratch_path(spark, "keyed"), record(i, "first", STORED_AT), ["customer_id"], 16)
    versions = [t]
    t = t.append(record(i.where("interaction_id % 5 = 0").withColumn("amount", (-F.col("amount")).cast("decimal(18,2)")),
                        "appended", CHANGED_AT))
    versions.append(t)
    newest = i.where("customer_id % 7 = 0").groupBy("customer_id").agg(F.max("interaction_id").alias("interaction_id"),
                                                                     F.max("amount").alias("amount"))
    t = t.replace(record(newest, "replaced", CHANGED_AT))
    versions.append(t)
    versions.append(t.delete(i.select("customer_id").where("customer_id % 11 = 0").distinct()))
    out = None
    for v in versions:
        rows = v.read().withColumn("version", F.lit(v.version))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("version", "customer_id").agg(
        F.count("*").alias("n_rows"), F.max("interaction_id").alias("last_interaction"),
        F.sum("amount").cast("double").alias("amount"), F.array_join(F.array_sort(F.collect_set("origin")), ",").alias("origins"),
        F.max("generated_at").alias("last_change"))


PAGE_ROWS = 100


@query("page_directory", f"""
SELECT CAST(rn // {PAGE_ROWS} AS BIGINT) AS page, o_orderdate, o_orderkey, least({PAGE_ROWS}, n - rn) AS n_rows
FROM (SELECT o_orderdate, o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS rn, count(*) OVER () AS n FROM orders)
WHERE rn % {PAGE_ROWS} = 0
""")
def page_directory(spark, sf_dir):
    """O2/O3: the first key and the size of every page of the orders by date and number."""
    return paging.page_directory(B.table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], PAGE_ROWS)


@query("seek_page", f"""
SELECT o_orderkey, o_custkey, o_orderdate FROM (
  SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS rn, count(*) OVER () AS n FROM orders)
WHERE rn // {PAGE_ROWS} = n // {PAGE_ROWS} // 2
""")
def seek_page(spark, sf_dir):
    """O3: the page in the middle of all, read by its key range."""
    o, keys = B.table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"]
    directory = paging.page_directory(o, keys, PAGE_ROWS)
    middle = directory.agg(F.floor((F.sum("n_rows") / PAGE_ROWS).cast("long") / 2).cast("long")).first()[0]
    return paging.read_page(o.select("o_orderkey", "o_custkey", "o_orderdate"), directory, keys, middle or 0)


VEHICLE_COMMENTS = {"vehicle_id": "Key of the vehicle", "make": "Maker's name", "price": "Price, 10 percent off"}


@query("catalogue_lifecycle", """
SELECT 'rows' AS section, 'first load' AS name, CAST(count(*) AS VARCHAR) AS value FROM part
UNION ALL SELECT 'rows', 'second load', CAST(count(*) AS VARCHAR) FROM part WHERE p_size <= 25
UNION ALL SELECT 'rows', 'by parameter', CAST(count(*) AS VARCHAR) FROM part WHERE p_size <= 25 AND p_brand = 'Brand#12'
UNION ALL SELECT 'rows', 'by hostile parameter', '0'
UNION ALL SELECT * FROM (VALUES ('first columns', 'vehicle_id', 'bigint'), ('first columns', 'make', 'string'),
  ('first columns', 'model', 'string'), ('first columns', 'price', 'double'), ('columns', 'vehicle_id', 'bigint: Key of the vehicle'),
  ('columns', 'make', 'string: Maker''s name'), ('columns', 'price', 'decimal(10,2): Price, 10 percent off'),
  ('columns', 'seats', 'int: '), ('table', 'Comment', 'The dealer''s vehicles'), ('table', 'certified', 'true'), ('table', 'unknown table tagged', 'false'))
""")
def catalogue_lifecycle(spark, sf_dir):
    """A namespace is made, vehicles are loaded with declared types, loaded again with another
    schema, commented and tagged; rows, columns and described metadata come back, then the namespace goes."""
    name = f"salesmatch_{uuid.uuid4().hex}"
    table = f"{name}.vehicles"
    io.ensure_namespace(spark, name, use=False, location=scratch_path(spark, name))
    try:
        v = B.vehicles(spark, sf_dir)
        io.overwrite(v.select("vehicle_id", "make", "model", "price"), table=table)
        rows = [("rows", "first load", str(spark.table(table).count()))]
        rows += [("first columns", f.name, f.dataType.simpleString()) for f in spark.table(table).schema.fields]
        io.overwrite(v.where("seating_capacity <= 25").select(
            "vehicle_id", "make", (F.col("price") * 0.9).cast("decimal(10,2)").alias("price"), F.col("seating_capacity").alias("seats")), table=table)
        rows.append(("rows", "second load", str(spark.table(table).count())))
        io.comment_table(spark, table, "The dealer's vehicles", VEHICLE_COMMENTS)
        tagged = [io.tag_table(spark, table, {"certified": "true"}), io.tag_table(spark, f"{name}.nothing", {"certified": "true"})]
        for label, make in (("by parameter", "Brand#12"), ("by hostile parameter", "Brand#12' OR '1' = '1")):
            rows.append(("rows", label, str(filters.lookup_param(spark.table(table), "make", make).count())))
        rows += [("columns", c.name, f"{c.dataType}: {c.description or ''}") for c in spark.catalog.listColumns(table)]
        described = {r.col_name: r.data_type for r in io.describe_rows(spark, table, ["Comment", "Table Properties"]).collect()}
        rows += [("table", "Comment", described["Comment"]),
                 ("table", "certified", str(tagged[0] and "certified=true" in described["Table Properties"]).lower()),
                 ("table", "unknown table tagged", str(tagged[1]).lower())]
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS `{name}` CASCADE")
    return spark.createDataFrame(rows, "section string, name string, value string")


@query("session_store", B.with_ctes("chat_turns") + """,
kept AS (SELECT * FROM chat_turns WHERE session_id % 4 <> 1)
SELECT session_id, turn, role, content, count(*) OVER (PARTITION BY session_id) AS n_visible FROM kept WHERE role <> 'system'
""")
def session_store_query(spark, sf_dir):
    """The conversations arrive as a stream, twice; repeated turns are dropped by the stream's state; every fourth
    session is cleared; the history is read back."""
    base = scratch_path(spark, "sessions")
    arrived = f"{base}/arrived"
    turns = B.chat_turns(spark, sf_dir).select(*[F.col(f.name).cast(f.dataType) for f in session_store.TURNS.fields])
    turns.where("turn % 2 = 0").write.parquet(arrived)
    stream = spark.readStream.schema(session_store.TURNS).parquet(arrived)
    session_store.append_available(spark, stream, f"{base}/store", f"{base}/checkpoint")
    turns.write.mode("append").parquet(arrived)  # all turns, half of them for the second time
    store = session_store.append_available(spark, spark.readStream.schema(session_store.TURNS).parquet(arrived),
                                           f"{base}/store", f"{base}/checkpoint")
    store = session_store.clear(store, turns.select("session_id").where("session_id % 4 = 1").distinct())
    rows = session_store.history(store)
    n = rows.groupBy("session_id").agg(F.count("*").alias("n_visible"))
    return rows.join(n, "session_id").select("session_id", "turn", "role", "content", "n_visible")


def _declared(spark, sf_dir) -> dict:
    """Source rows and declared schema of the model's tables; the sources' types and orders differ from the declared."""
    i, t, e = B.interactions(spark, sf_dir), B.traces(spark, sf_dir), B.evaluations(spark, sf_dir)
    return {
        "customers": (B.customers(spark, sf_dir), schemas.CUSTOMERS),
        "vehicles": (B.vehicles(spark, sf_dir).withColumn("year", F.lit("20x4")), schemas.VEHICLES),
        "interactions": (i.withColumn("duration_minutes", F.floor("amount").cast("string")), schemas.INTERACTIONS),
        "evaluations": (e.withColumnRenamed("evaluated_at", "timestamp"), schemas.EVALUATIONS),
        "traces": (t.withColumn("timestamp_ms", F.unix_millis("ts")).withColumn("tags", F.create_map(F.lit("name"), "trace_name")), schemas.TRACES),
        "chat_turns": (B.chat_turns(spark, sf_dir), schemas.CHAT_TURNS)}


# Columns that the sources fill in every row, and those with nulls (SQL of their number).
_FILLED = {
    "customers": ("customer", "customer_id name occupation", {"budget_min": "count(*) FILTER (WHERE c_custkey % 10 = 1)",
                                                            "budget_max": "count(*) FILTER (WHERE c_custkey % 10 = 2)"}),
    "vehicles": ("part", "vehicle_id make model price body_type seating_capacity features stock_status image_path", {}),
    "interactions": ("orders", "interaction_id customer_id interaction_type interaction_date duration_minutes", {}),
    "evaluations": ("orders", "evaluation_id trace_id timestamp rating", {"ground_truth": "count(*) FILTER (WHERE o_orderstatus <> 'F')"}),
    "traces": ("events", "trace_id status timestamp_ms execution_time_ms tags", {}),
    "chat_turns": ("conversations", "session_id turn role content", {}),
}


def _typed_sql() -> str:
    out = []
    kinds = {"customers": schemas.CUSTOMERS, "vehicles": schemas.VEHICLES, "interactions": schemas.INTERACTIONS,
             "evaluations": schemas.EVALUATIONS, "traces": schemas.TRACES, "chat_turns": schemas.CHAT_TURNS}
    for name, (source, filled, some) in _FILLED.items():
        for f in kinds[name].fields:
            nulls = "0" if f.name in filled.split() else some.get(f.name, "count(*)")
            out.append(f"SELECT '{name}' AS table_name, '{f.name}' AS column_name, '{f.dataType.simpleString()}' AS type, "
                       f"count(*) AS n_rows, CAST({nulls} AS BIGINT) AS n_null FROM {source}")
    return " UNION ALL ".join(out)


@query("typed_load", _typed_sql())
def typed_load(spark, sf_dir):
    """Every table of the model is loaded under its declared schema, stored, read back with it and
    described: type, rows and nulls of each column. Sources lack columns and have other types and one unreadable value."""
    out = None
    for name, (rows, schema) in _declared(spark, sf_dir).items():
        path = scratch_path(spark, name)
        io.overwrite(io.conform(rows, schema), path)
        back = io.read_table(spark, path, schema)
        kinds = {f.name: f.dataType.simpleString() for f in back.schema.fields}
        counted = back.agg(F.count("*").alias("n"), F.array(*[F.struct(
            F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("type"), F.count_if(F.col(c).isNull()).alias("n_null"))
            for c in back.columns]).alias("c"))
        part = counted.select(F.lit(name).alias("table_name"), F.col("n").alias("n_rows"), F.explode("c").alias("x")).select(
            "table_name", "x.column_name", "x.type", "n_rows", "x.n_null")
        out = part if out is None else out.unionByName(part)
    return out
