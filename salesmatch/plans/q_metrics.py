"""Dashboard queries over traces (events), evaluations (orders) and
recommendation items (lineitem)."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesmatch.functions.text import list_text, price_label
from salesmatch.operators import joins, metrics, ranking
from salesmatch.plans import bindings as B
from salesmatch.plans.registry import query
from salesmatch.session import scratch_path

USAGE_CLASSES = {"purchase_or_click": "c", "view": "view", "signup_or_purchase": "u"}

_MINUTE_SQL = """
series AS (SELECT date_trunc('minute', ts) AS minute, count(*) AS requests,
         round(avg(execution_time_ms), 6) AS avg_latency_ms,
         round(quantile_cont(execution_time_ms, 0.5), 6) AS p50_latency_ms,
         round(quantile_cont(execution_time_ms, 0.95), 6) AS p95_latency_ms,
         round(quantile_cont(execution_time_ms, 0.99), 6) AS p99_latency_ms,
         count(*) FILTER (WHERE status = 'ERROR') AS error_count,
         CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS tokens
       FROM traces GROUP BY 1)"""


def _series(spark, sf_dir):
    return metrics.minute_series(B.traces(spark, sf_dir))


@query("trace_dashboard", B.with_ctes("traces") + """
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'OK') AS ok,
       count(*) FILTER (WHERE status = 'ERROR') AS error,
       round(coalesce(CAST(count(*) FILTER (WHERE status = 'ERROR') AS DOUBLE) / nullif(count(*), 0), 0.0), 6)
         AS error_rate,
       round(coalesce(avg(CASE WHEN status = 'OK' THEN execution_time_ms END), 0.0), 6) AS avg_latency_ms,
       CAST(coalesce(sum(CASE WHEN status = 'OK' THEN total_tokens END), 0) AS BIGINT) AS total_tokens,
       round(CAST(coalesce(sum(CASE WHEN status = 'OK' THEN total_tokens END), 0) AS BIGINT)
             * CAST(0.000015 AS DOUBLE), 6) AS estimated_cost_usd,
       coalesce(CAST(count(*) FILTER (WHERE status = 'ERROR') AS DOUBLE) / nullif(count(*), 0), 0.0) > 0.05
         AS alert
FROM traces
""")
def trace_dashboard(spark, sf_dir):
    """Trace statistics of the dashboard."""
    return metrics.trace_dashboard(B.traces(spark, sf_dir))


@query("usage_by_type", B.with_ctes("traces") + """
SELECT count(*) FILTER (WHERE contains(trace_name, 'c')) AS purchase_or_click,
       count(*) FILTER (WHERE contains(trace_name, 'view')) AS view,
       count(*) FILTER (WHERE contains(trace_name, 'u')) AS signup_or_purchase
FROM traces
""")
def usage_by_type(spark, sf_dir):
    """Overlapping substring classes of trace names."""
    return metrics.usage_by_type(B.traces(spark, sf_dir), USAGE_CLASSES)


@query("alert_flag", B.with_ctes("traces") + """
SELECT date_trunc('hour', ts) AS hour, count(*) AS requests,
       count(*) FILTER (WHERE status = 'ERROR') AS errors,
       round(coalesce(CAST(count(*) FILTER (WHERE status = 'ERROR') AS DOUBLE) / nullif(count(*), 0), 0.0), 6)
         AS error_rate,
       coalesce(CAST(count(*) FILTER (WHERE status = 'ERROR') AS DOUBLE) / nullif(count(*), 0), 0.0) > 0.05
         AS alert
FROM traces GROUP BY 1
""")
def alert_flag(spark, sf_dir):
    """Hourly error rate and alert flag."""
    return metrics.alert_by_hour(B.traces(spark, sf_dir))


@query("rating_summary", B.with_ctes("evaluations") + """
SELECT count(*) AS total_evaluations, round(coalesce(avg(CAST(rating AS DOUBLE)), 0.0), 6) AS avg_rating,
       count(*) FILTER (WHERE rating = 5) AS rating_5, count(*) FILTER (WHERE rating = 4) AS rating_4,
       count(*) FILTER (WHERE rating = 3) AS rating_3, count(*) FILTER (WHERE rating = 2) AS rating_2,
       count(*) FILTER (WHERE rating = 1) AS rating_1,
       count(*) FILTER (WHERE ground_truth <> '') AS with_ground_truth
FROM evaluations
""")
def rating_summary(spark, sf_dir):
    """A3: evaluation summary."""
    return metrics.rating_summary(B.evaluations(spark, sf_dir))


@query("minute_metrics", B.with_ctes("traces") + "," + _MINUTE_SQL + "\nSELECT * FROM series")
def minute_metrics(spark, sf_dir):
    """Per-minute request count, latency mean and exact percentiles."""
    return _series(spark, sf_dir)


@query("recent_mean", B.with_ctes("traces") + "," + _MINUTE_SQL + """,
last AS (SELECT * FROM series ORDER BY minute DESC LIMIT 5)
SELECT round(avg(requests), 6) AS requests_per_minute, round(avg(avg_latency_ms), 6) AS avg_latency_ms,
       round(avg(p50_latency_ms), 6) AS p50_latency_ms, round(avg(p95_latency_ms), 6) AS p95_latency_ms,
       round(avg(p99_latency_ms), 6) AS p99_latency_ms,
       round(coalesce(CAST(sum(error_count) AS DOUBLE) / nullif(sum(requests), 0), 0.0), 6) AS error_rate
FROM last
""")
def recent_mean(spark, sf_dir):
    """Mean of the last five minute points."""
    newest = metrics.newest_minutes(B.table(spark, sf_dir, "events"))
    return metrics.recent_mean(metrics.minute_series(B.traces(spark, sf_dir, newest)))


@query("hour_totals", B.with_ctes("traces") + "," + _MINUTE_SQL + """
SELECT date_trunc('hour', minute) AS hour, CAST(sum(requests) AS BIGINT) AS total_requests,
       CAST(sum(tokens) AS BIGINT) AS total_tokens,
       round(CAST(sum(tokens) AS BIGINT) * CAST(0.000015 AS DOUBLE), 6) AS estimated_cost_usd
FROM series GROUP BY 1
""")
def hour_totals(spark, sf_dir):
    """Hourly totals, counted from the traces."""
    return metrics.hour_totals(B.traces(spark, sf_dir), "ts", None, "total_tokens")


@query("sketch_metrics", B.with_ctes("traces") + """
SELECT coalesce(strftime(date_trunc('hour', ts), '%Y-%m-%d %H'), 'no time') AS span, count(*) AS requests,
       count(*) FILTER (WHERE status = 'ERROR') AS error_count, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS tokens,
       round(avg(execution_time_ms), 6) AS avg_latency_ms, true AS p50_within, true AS p95_within, true AS p99_within
FROM traces GROUP BY 1
UNION ALL
SELECT 'all', count(*), count(*) FILTER (WHERE status = 'ERROR'), CAST(coalesce(sum(total_tokens), 0) AS BIGINT),
       round(avg(execution_time_ms), 6), true, true, true
FROM traces
""")
def sketch_metrics(spark, sf_dir):
    """A7 (scale option)/A6: minute sketches are stored once and merged to hours and to the whole time; the percentiles'
    ranks are compared with the traces: within twice the sketch's rank error."""
    traces = B.traces(spark, sf_dir)
    path = scratch_path(spark, "sketches")
    metrics.minute_sketches(traces).write.parquet(path)
    stored = spark.read.parquet(path)
    hour = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH"), F.lit("no time"))
    out = None
    for name, merged in ((hour("ts"), hour("minute")), (F.lit("all"), F.lit("all"))):
        series = metrics.sketch_series(metrics.merge_sketches(stored, [merged.alias("span")]))
        errors = metrics.rank_errors(traces, series, "span", name)
        bound = 2 * metrics.sketch_rank_error()
        rows = series.join(errors, "span", "left").select(
            "span", "requests", "error_count", "tokens", "avg_latency_ms",
            *[(F.coalesce(p, F.lit(0.0)) <= bound).alias(f"{p}_within") for p in ("p50", "p95", "p99")])
        out = rows if out is None else out.unionByName(rows)
    return out


@query("top_makes", B.with_ctes("rec_items", "vehicles") + """
SELECT make, count(*) AS recommendations FROM rec_items JOIN vehicles USING (vehicle_id)
GROUP BY make ORDER BY recommendations DESC, make LIMIT 5
""")
def top_makes(spark, sf_dir):
    """The five makes recommended most often."""
    items = B.recommendation_items(spark, sf_dir).join(
        B.vehicles(spark, sf_dir).select("vehicle_id", "make"), "vehicle_id")
    return metrics.top_counts(items, "make", 5, "recommendations")


@query("scale_to_max", B.with_ctes("traces") + """
SELECT trace_name, n, round(coalesce(CAST(n AS DOUBLE) / nullif(max(n) OVER (), 0), 0.0) * 100.0, 6)
         AS pct_of_max
FROM (SELECT trace_name, count(*) AS n FROM traces GROUP BY 1)
""")
def scale_to_max(spark, sf_dir):
    """A10: bar heights relative to the largest count."""
    counts = B.traces(spark, sf_dir).groupBy("trace_name").agg(F.count(F.lit(1)).alias("n"))
    return metrics.scale_to_max(counts, "n")


@query("down_sample", B.with_ctes("traces") + """
SELECT trace_name, minute, requests, point_index FROM (
  SELECT trace_name, minute, requests,
         CAST(row_number() OVER (PARTITION BY trace_name ORDER BY minute) - 1 AS INTEGER) AS point_index,
         count(*) OVER (PARTITION BY trace_name) AS n
  FROM (SELECT trace_name, date_trunc('minute', ts) AS minute, count(*) AS requests
        FROM traces GROUP BY 1, 2))
WHERE point_index % 10 = 0 OR point_index = n - 1
""")
def down_sample(spark, sf_dir):
    """Every tenth point of each per-name minute series plus its last point."""
    s = B.traces(spark, sf_dir).groupBy("trace_name", F.date_trunc("minute", "ts").alias("minute")).agg(
        F.count(F.lit(1)).alias("requests"))
    return ranking.down_sample(s, ["trace_name"], "minute", 10).select(
        "trace_name", "minute", "requests", "point_index")


CANDIDATE_TEXT_SQL = """
cand AS (SELECT c.customer_id, v.*,
                row_number() OVER (PARTITION BY c.customer_id ORDER BY v.price, v.vehicle_id) AS rn
         FROM customers c JOIN vehicles v ON v.price BETWEEN c.budget_min AND c.budget_max
         QUALIFY rn <= 20),
lines AS (SELECT customer_id, rn,
   '- ' || CAST(vehicle_id AS VARCHAR) || ': ' || make || ' ' || model || ' '
   || CASE WHEN price >= 10000 THEN format('{:,}', CAST(floor(price / 10000) AS BIGINT)) || '万円'
           ELSE CAST(price AS VARCHAR) || '円' END
   || ' ' || body_type || ' features: '
   || coalesce(nullif(array_to_string(features, ', '), ''), '-') AS line
   FROM cand),
candidate_text AS (SELECT customer_id, string_agg(line, chr(10) ORDER BY rn) AS candidate_text,
                          count(*) AS lines
                   FROM lines GROUP BY customer_id)"""


def candidate_text_df(spark, sf_dir):
    """The first 20 in-budget vehicles of each customer folded
    into one text block, one line per vehicle in price order."""
    c = B.customers(spark, sf_dir).select("customer_id", "budget_min", "budget_max")
    v = B.vehicles(spark, sf_dir)
    cand = joins.first_k_in_range(c, v.select("vehicle_id", "price"), "budget_min", "budget_max", "price",
                                  "vehicle_id", "customer_id", 20, rank_col="rn")
    cand = cand.join(v.drop("price"), "vehicle_id")
    known = [F.coalesce(c, F.lit("-")) for c in (
        F.col("make"), F.col("model"), price_label("price"), F.col("body_type"))]
    line = F.concat(F.lit("- "), F.col("vehicle_id").cast("string"), F.lit(": "), F.concat_ws(" ", *known),
                    F.lit(" features: "), F.coalesce(list_text("features"), F.lit("-")))
    return metrics.fold_lines(cand.withColumn("line", line), ["customer_id"], "rn", "line",
                              out="candidate_text")


@query("candidate_text", B.with_ctes("customers", "vehicles") + "," + CANDIDATE_TEXT_SQL
       + "\nSELECT * FROM candidate_text")
def candidate_text(spark, sf_dir):
    """Candidate text block per customer."""
    return candidate_text_df(spark, sf_dir)
