"""Operations dashboards (A1-A13): trace statistics, rating summaries,
per-minute latency series and their reductions.

Every statistic is a single aggregation pass with partial (map-side)
aggregation; the reductions over a series (last N, totals, down-sampling,
scaling) run on the aggregated series, whose size is bounded by the time
range and not by the raw event volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values from the reference: price per token in USD, alert threshold
# on the error rate, and the default number of recent points.
COST_PER_TOKEN = 0.000015
ERROR_RATE_ALERT = 0.05
RECENT_POINTS = 5
DIGITS = 6  # doubles are reported rounded to 6 places (stable across engines)

PERCENTILES = (0.5, 0.95, 0.99)


def _r(c: Column) -> Column:
    return F.round(c, DIGITS)


def ratio(num: Column, den: Column) -> Column:
    """Num / den, 0 when den is 0 or null."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def trace_dashboard(traces: DataFrame, status: str = "status", latency: str = "execution_time_ms",
                    tokens: str = "total_tokens") -> DataFrame:
    """Totals, error rate, mean latency and token sum over OK
    traces only, cost = tokens x 0.000015, alert when error rate > 0.05."""
    ok = F.col(status) == "OK"
    agg = traces.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("ok"),
        F.count_if(F.col(status) == "ERROR").alias("error"),
        F.avg(F.when(ok, F.col(latency))).alias("_lat"),
        F.sum(F.when(ok, F.col(tokens))).alias("_tok"),
    )
    tok = F.coalesce(F.col("_tok"), F.lit(0)).cast("bigint")
    rate = ratio(F.col("error"), F.col("total"))
    return agg.select(
        "total", "ok", "error", _r(rate).alias("error_rate"),
        _r(F.coalesce(F.col("_lat"), F.lit(0.0))).alias("avg_latency_ms"),
        tok.alias("total_tokens"), _r(tok * F.lit(COST_PER_TOKEN)).alias("estimated_cost_usd"),
        (rate > ERROR_RATE_ALERT).alias("alert"))


def usage_by_type(traces: DataFrame, classes: dict[str, str], name: str = "trace_name") -> DataFrame:
    """One count per class, by substring test on the trace name, so
    classes may overlap (a name can count in several)."""
    return traces.agg(*[F.count_if(F.coalesce(F.contains(F.col(name), F.lit(sub)), F.lit(False)))
                        .alias(label) for label, sub in classes.items()])


def rating_summary(evals: DataFrame, rating: str = "rating", truth: str = "ground_truth") -> DataFrame:
    """A3: count, mean rating (0 when empty), distribution over 5..1 with
    zeros, and how many carry a non-empty ground truth."""
    return evals.agg(
        F.count(F.lit(1)).alias("total_evaluations"),
        _r(F.coalesce(F.avg(F.col(rating).cast("double")), F.lit(0.0))).alias("avg_rating"),
        *[F.count_if(F.col(rating) == k).alias(f"rating_{k}") for k in (5, 4, 3, 2, 1)],
        F.count_if(F.coalesce(F.col(truth) != "", F.lit(False))).alias("with_ground_truth"))


def value_counts(traces: DataFrame, keys: list, latency: str = "execution_time_ms", status: str = "status",
                 tokens: str = "total_tokens") -> DataFrame:
    """Per group and latency value (``_v``): rows ``_n``, errors ``_e``, token sum ``_t``.
    Partial aggregates of fixed size; a group's values are spread over tasks."""
    return traces.groupBy(*keys, F.col(latency).alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col(status) == "ERROR").alias("_e"),
        F.sum(F.col(tokens)).cast("bigint").alias("_t"))


def series_from_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The series of ``minute_series`` from ``value_counts``. Exact percentiles
    come from cumulative counts: a sorted, spilling window over the distinct
    values of a group, and no map of values in memory."""
    # Both sums have one order, so they share one sort and one window; a group's values are distinct.
    group = Window.partitionBy(*keys).orderBy("_v")
    valued = F.when(F.col("_v").isNotNull(), F.col("_n")).otherwise(F.lit(0))
    run = counts.select("*", F.sum(valued).over(group.rowsBetween(Window.unboundedPreceding, 0)).alias("_cum"),
                        F.sum(valued).over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"))
    ranks = []
    for i, p in enumerate(PERCENTILES):
        at = (F.col("_total") - 1) * F.lit(p)
        for end, edge in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            ranks.append(F.min(F.when(F.col("_cum") > edge, F.col("_v"))).alias(f"_{end}{i}"))
    agg = run.groupBy(*keys).agg(
        F.sum("_n").alias("requests"), F.max("_total").alias("_total"),
        F.sum(F.col("_v") * F.col("_n")).alias("_sum"), F.sum("_e").alias("error_count"),
        F.coalesce(F.sum("_t"), F.lit(0)).cast("bigint").alias("tokens"), *ranks)

    def percentile(i: int) -> Column:
        at = (F.col("_total") - 1) * F.lit(PERCENTILES[i])
        return F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (at - F.floor(at))

    return agg.select(*keys, "requests", _r(F.try_divide("_sum", "_total")).alias("avg_latency_ms"),
                      *[_r(percentile(i)).alias(f"p{round(p * 100)}_latency_ms") for i, p in enumerate(PERCENTILES)],
                      "error_count", "tokens")


def minute_series(traces: DataFrame, keys: list[str] | None = None, ts: str = "ts",
                  latency: str = "execution_time_ms", status: str = "status",
                  tokens: str = "total_tokens") -> DataFrame:
    """One row per minute (and key): requests, mean and exact p50/p95/p99
    latency, errors, tokens. Rows are counted by value first, so that a minute
    with most of the rows is summed by all tasks."""
    keys = keys or []
    counts = value_counts(traces, [*keys, F.date_trunc("minute", F.col(ts)).alias("minute")], latency, status, tokens)
    return series_from_counts(counts, [*keys, "minute"])


def newest_minutes(traces: DataFrame, n: int = RECENT_POINTS, ts: str = "ts") -> DataFrame:
    """The rows of the ``n`` newest minutes that have rows. Their first minute is fetched (one value) and stands in
    the filter as a literal, so that files and row groups before it are not read."""
    minute = F.date_trunc("minute", F.col(ts))
    last = traces.where(F.col(ts).isNotNull()).select(minute.alias("_m")).distinct().orderBy(F.desc("_m")).limit(n)
    first = last.agg(F.date_format(F.min("_m"), "yyyy-MM-dd HH:mm:ss")).first()[0]
    if first is None:
        return traces.limit(0)
    return traces.where(F.col(ts) >= F.lit(first).cast(traces.schema[ts].dataType))


def recent_mean(series: DataFrame, n: int = RECENT_POINTS, ts: str = "minute") -> DataFrame:
    """A4/A5: mean of the last ``n`` points of each metric, and the error rate
    of those points (errors / requests, 0 without requests)."""
    last = series.orderBy(F.col(ts).desc()).limit(n)
    return last.agg(
        _r(F.avg("requests").cast("double")).alias("requests_per_minute"),
        _r(F.avg("avg_latency_ms")).alias("avg_latency_ms"),
        _r(F.avg("p50_latency_ms")).alias("p50_latency_ms"),
        _r(F.avg("p95_latency_ms")).alias("p95_latency_ms"),
        _r(F.avg("p99_latency_ms")).alias("p99_latency_ms"),
        _r(ratio(F.sum("error_count"), F.sum("requests"))).alias("error_rate"))


def hour_totals(series: DataFrame, ts: str = "minute", requests: str | None = "requests", tokens: str = "tokens") -> DataFrame:
    """Per hour: requests, tokens and their cost; of a series, or of the traces themselves (``requests=None``:
    each row is one request), which needs no series and no percentile."""
    asked = F.count(F.lit(1)) if requests is None else F.sum(requests)
    return series.groupBy(F.date_trunc("hour", F.col(ts)).alias("hour")).agg(
        asked.cast("bigint").alias("total_requests"),
        F.coalesce(F.sum(tokens), F.lit(0)).cast("bigint").alias("total_tokens"),
    ).withColumn("estimated_cost_usd", _r(F.col("total_tokens") * F.lit(COST_PER_TOKEN)))


def alert_by_hour(traces: DataFrame, ts: str = "ts", status: str = "status") -> DataFrame:
    """A5/A13 per hour: error rate with zero guard and the alert flag."""
    agg = traces.groupBy(F.date_trunc("hour", F.col(ts)).alias("hour")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col(status) == "ERROR").alias("errors"))
    rate = ratio(F.col("errors"), F.col("requests"))
    return agg.select("hour", "requests", "errors", _r(rate).alias("error_rate"),
                      (rate > ERROR_RATE_ALERT).alias("alert"))


def top_counts(items: DataFrame, label: str, k: int = 5, count_name: str = "n") -> DataFrame:
    """The ``k`` most frequent labels (ties -> label); a global top-k over
    an aggregate, planned as TakeOrderedAndProject."""
    return (items.groupBy(label).agg(F.count(F.lit(1)).alias(count_name))
            .orderBy(F.col(count_name).desc(), F.col(label).asc()).limit(k))


def scale_to_max(df: DataFrame, value: str, out: str = "pct_of_max", scale: float = 100.0) -> DataFrame:
    """A10: value / max(value) x scale, 0 when the maximum is 0. Meant for an
    aggregated result (bar chart rows), so the unpartitioned window is small."""
    mx = F.max(F.col(value)).over(Window.partitionBy())
    return df.withColumn(out, _r(ratio(F.col(value), mx) * F.lit(scale)))


def fold_lines(df: DataFrame, keys: list[str], order: str, line: str, sep: str = "\n",
               out: str = "text") -> DataFrame:
    """Lines of each key joined in ``order``; a null line is printed empty, so
    that ``lines`` counts what stands there. Only for bounded groups (the callers
    fold a top-k, never a raw history)."""
    folded = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.coalesce(F.col(line), F.lit("")).alias(line)))),
                                      lambda x: x[line]), sep)
    return df.groupBy(*keys).agg(folded.alias(out), F.count(F.lit(1)).alias("lines"))


# --- A7 at scale: mergeable sketches --------------------------------------------

#: Size parameter of the quantile sketches.
SKETCH_K = 800


def sketch_rank_error(k: int = SKETCH_K) -> float:
    """The rank error that a sketch of size ``k`` exceeds with a probability below one in a hundred for each answer."""
    return 2.296 / k ** 0.9021


def minute_sketches(traces: DataFrame, keys: list[str] | None = None, ts: str = "ts", latency: str = "execution_time_ms",
                    status: str = "status", tokens: str = "total_tokens", k: int = SKETCH_K) -> DataFrame:
    """A7's scale option: per minute (and key) the requests, errors, tokens, latency sum and a quantile sketch of
    bounded size. Partial aggregates merge sketches, so a minute with most of the rows costs a sketch a task; the
    table, once written, answers for hours, days and the newest minutes without the events."""
    return traces.groupBy(*(keys or []), F.date_trunc("minute", F.col(ts)).alias("minute")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col(status) == "ERROR").alias("error_count"),
        F.coalesce(F.sum(tokens), F.lit(0)).cast("bigint").alias("tokens"), F.sum(latency).alias("latency_sum"),
        F.count(latency).alias("latency_n"), F.kll_sketch_agg_double(F.col(latency).cast("double"), F.lit(k)).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: list[Column | str], k: int = SKETCH_K) -> DataFrame:
    """Rows of ``minute_sketches`` merged by other groups: same columns, sums added and sketches merged."""
    return sketches.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("requests", "error_count", "tokens", "latency_sum", "latency_n")],
        F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def sketch_series(sketches: DataFrame) -> DataFrame:
    """The columns of ``minute_series`` from sketches; percentiles are values whose rank is within
    ``sketch_rank_error`` (groups of up to about k values are exact)."""
    held = F.col("latency_n") > 0
    quantiles = [F.when(held, F.kll_sketch_get_quantile_double("sketch", F.lit(p))).alias(f"p{round(p * 100)}_latency_ms")
                 for p in PERCENTILES]
    others = [c for c in sketches.columns if c not in ("requests", "error_count", "tokens", "latency_sum", "latency_n", "sketch")]
    return sketches.select(*others, "requests", _r(F.try_divide("latency_sum", "latency_n")).alias("avg_latency_ms"), *quantiles,
                           "error_count", "tokens")


def rank_errors(traces: DataFrame, series: DataFrame, key: str, group: Column, latency: str = "execution_time_ms") -> DataFrame:
    """key and, for each percentile of ``series``, how far the share of values at and below it is from its own, 0 where the
    value covers it. Reads the traces once more: for checks."""
    names = [f"p{round(p * 100)}_latency_ms" for p in PERCENTILES]
    rows = traces.where(F.col(latency).isNotNull()).select(group.alias(key), F.col(latency).alias("_v"))
    both = rows.join(F.broadcast(series.select(key, *names)), key)  # a row for each group
    shares = both.groupBy(key).agg(*[f for n in names for f in (
        F.avg((F.col("_v") < F.col(n)).cast("double")).alias(f"_lt_{n}"), F.avg((F.col("_v") <= F.col(n)).cast("double")).alias(f"_le_{n}"))])
    return shares.select(key, *[F.greatest(F.lit(0.0), F.lit(p) - F.col(f"_le_{n}"), F.col(f"_lt_{n}") - F.lit(p)).alias(n[:3])
                                for p, n in zip(PERCENTILES, names)])
