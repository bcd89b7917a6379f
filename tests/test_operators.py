"""Operators on hand-made rows: semantic traps, golden values, and brute-force
checks of the custom joins."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmatch.functions import text as TX
from salesmatch.operators import filters, joins, matching, metrics, ranking, requests, sessions
from salesmatch.sources import io


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# --- budget rules (P5, P6, P10, T4, T24) ---------------------------------------

def test_widened_bounds_golden(spark):
    df = spark.createDataFrame([(2_000_000, 3_000_000), (0, None), (None, 0)], "budget_min long, budget_max long")
    lo, hi = matching.widened_bounds()
    got = [tuple(r) for r in df.select(lo, hi).collect()]
    assert got == [(1_600_000, 3_900_000), (0, 13_000_000), (0, 13_000_000)]


def test_exact_bounds_defaults(spark):
    df = spark.createDataFrame([(0, 0), (5, 7)], "budget_min long, budget_max long")
    lo, hi = matching.exact_bounds()
    assert [tuple(r) for r in df.select(lo, hi).collect()] == [(0, 99_999_999), (5, 7)]


def test_truncation_toward_zero(spark):
    df = spark.createDataFrame([(1.6,), (-1.6,)], "x double")
    assert [r[0] for r in df.select(TX.trunc_long("x")).collect()] == [1, -1]


# --- range joins (J3) and first-k --------------------------------------------

def _random_tables(spark, n_left=60, n_right=300, hot=True, seed=7):
    rnd = random.Random(seed)
    left = [(i, rnd.randint(-50, 900), rnd.randint(-50, 1100)) for i in range(n_left)]
    left += [(n_left, 5, 5), (n_left + 1, 10, 3), (n_left + 2, None, 40)]
    right = [(j, float(rnd.randint(0, 1000)) if not (hot and j % 3 == 0) else 500.0) for j in range(n_right)]
    return (spark.createDataFrame(left, "k long, lo long, hi long"),
            spark.createDataFrame(right, "v long, price double"))


@pytest.mark.parametrize("force", ["broadcast", "shuffle"])
def test_range_join_matches_nested_loop(spark, force):
    left, right = _random_tables(spark)
    fast = joins.range_join(left, right, "lo", "hi", "price", force=force, target_buckets=16, rows_per_task=20)
    slow = joins.naive_range_join(left, right, "lo", "hi", "price")
    assert rows(fast, "k", "v") == rows(slow, "k", "v")


@pytest.mark.parametrize("buckets,rows_per_task", [(1, 20), (16, 7), (64, 200_000)])
def test_range_summary_matches_nested_loop(spark, buckets, rows_per_task):
    left, right = _random_tables(spark, n_left=40)
    left = left.unionByName(left.where("k < 15").withColumn("k", F.col("k") + 1000))
    right = right.union(spark.createDataFrame([(900, None), (901, float("nan")), (902, 1e9)], right.schema))
    want = joins.naive_range_join(left, right.where("not isnan(price)"), "lo", "hi", "price").groupBy("k").agg(
        F.count("*").alias("n"), F.min("price").alias("least"), F.max("price").alias("most"), F.sum("v").alias("sum_v"))
    for force in ("broadcast", "shuffle"):
        got = joins.range_summary(left, right, "lo", "hi", "price", "k", ["v"], target_buckets=buckets,
                                  rows_per_task=rows_per_task, force=force)
        assert rows(got, "k", "n", "least", "most", "sum_v") == rows(want, "k", "n", "least", "most", "sum_v")
    assert joins.range_summary(left, right.limit(0), "lo", "hi", "price", "k", ["v"]).count() == 0


def test_an_outlier_does_not_widen_the_buckets(spark):
    rnd = random.Random(3)
    left = spark.createDataFrame([(i, 10 * i, 10 * i + 25) for i in range(100)], "k long, lo long, hi long")
    prices = [(j, rnd.uniform(0, 1000)) for j in range(5000)]
    right = spark.createDataFrame(prices, "v long, price double")
    far = right.union(spark.createDataFrame([(9999, 1e9)], right.schema))
    for edges in (False, True):
        before = joins.tested_pairs(left, right, "lo", "hi", "price", 256, edges)
        after = joins.tested_pairs(left, far, "lo", "hi", "price", 256, edges)
        assert abs(after - before) < 0.01 * before
    pairs = joins.range_join(left, far, "lo", "hi", "price").count()
    assert pairs == joins.naive_range_join(left, far, "lo", "hi", "price").count()
    assert before < 1.5 * pairs  # of 500,000 possible ones


def test_hot_buckets_are_split_on_both_sides(spark):
    left = spark.range(400).select(F.col("id").alias("k"), F.lit(5).alias("lo"), F.lit(5).alias("hi"))
    right = spark.range(300).select(F.col("id").alias("v"), F.lit(5.0).alias("price"))
    index = joins.range_index(right, "price", 8)
    ls, rs, cell = joins._in_cells(joins._pieces(left, index, "lo", "hi"), right.withColumn("_b", index.bucket(F.col("price"))), 100)
    assert rs.groupBy(*cell).count().agg(F.max("count")).first()[0] < 200
    assert ls.groupBy(*cell).count().agg(F.max("count")).first()[0] < 200
    assert ls.join(rs, cell).select("k", "v").distinct().count() == ls.join(rs, cell).count() == 120_000


@pytest.mark.parametrize("force", ["broadcast", "shuffle"])
def test_tasks_of_a_range_join_follow_its_pairs(spark, force):
    left = spark.range(0, 400, 1, 1).select(F.col("id").alias("k"), F.lit(0).alias("lo"), (F.col("id") + 50).alias("hi"))
    right = spark.range(0, 300, 1, 1).select(F.col("id").alias("v"), (F.col("id") % 100).cast("double").alias("price"))
    got = joins.range_join(left, right, "lo", "hi", "price", target_buckets=4, force=force, pairs_per_task=2000)
    each = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(each) > 3 and max(each) < sum(each) / 2
    assert rows(got, "k", "v") == rows(joins.naive_range_join(left, right, "lo", "hi", "price"), "k", "v")
    assert joins.tested_pairs(left, right, "lo", "hi", "price", 1) == 120_000


def test_cells_hold_a_bounded_number_of_pairs(spark):
    for n, m in ((400, 300), (1000, 3), (2, 900)):
        left = spark.range(n).select(F.col("id").alias("k"), F.lit(1).alias("_b"))
        right = spark.range(m).select(F.col("id").alias("v"), F.lit(1).alias("_b"))
        ls, rs, cell = joins._in_cells(left, right, 200_000, 400)
        joined = ls.join(rs, cell)
        assert joined.groupBy(*cell).count().agg(F.max("count")).first()[0] < 4 * 400
        assert joined.select("k", "v").distinct().count() == joined.count() == n * m


def test_ranges_beyond_the_values_have_no_pieces(spark):
    nan = float("nan")
    left = spark.createDataFrame([(1, 50.0, 90.0), (2, 0.0, 9.0), (3, 10.0, 10.0), (4, 5.0, 60.0), (5, nan, nan)],
                                 "k long, lo double, hi double")
    right = spark.createDataFrame([(1, 10.0), (2, 40.0), (3, None)], "v long, price double")
    assert joins.tested_pairs(left, right, "lo", "hi", "price", 1) == 4
    for more in ([], [(4, nan)]):
        all_of = right.union(spark.createDataFrame(more, right.schema))
        for force in ("broadcast", "shuffle"):
            assert rows(joins.range_join(left, all_of, "lo", "hi", "price", force=force), "k", "v") == rows(
                joins.naive_range_join(left, all_of, "lo", "hi", "price"), "k", "v")


def test_shelves_and_bays_hold_every_pair_once(spark, monkeypatch):
    """Blocks of several buckets, buckets of several shelves, bays of one block and of many, ends inside all of them."""
    left, right = _random_tables(spark)
    left = left.union(left.where("k < 9")).union(spark.createDataFrame([(99, -10**6, 10**6)], left.schema))
    right = right.union(right.where("v < 9")).union(spark.createDataFrame([(900, None), (901, float("nan"))], right.schema))
    want = rows(joins.naive_range_join(left, right, "lo", "hi", "price"), "k", "v")
    for shelf, bay, buckets, per_task in ((7, 50, 64, 2000), (40, 45, 64, 2000), (1, 1, 16, 10**6), (10**6, 10**6, 8, 2000)):
        monkeypatch.setattr(joins, "SHELF_ROWS", shelf)
        monkeypatch.setattr(joins, "BAY_ROWS", bay)
        got = joins.range_join(left, right, "lo", "hi", "price", buckets, force="broadcast", pairs_per_task=per_task)
        assert rows(got, "k", "v") == want


def test_a_task_sees_the_right_rows_of_one_bay(spark, monkeypatch):
    monkeypatch.setattr(joins, "SHELF_ROWS", 10)
    monkeypatch.setattr(joins, "BAY_ROWS", 100)
    left = spark.range(0, 80, 1, 1).select(F.col("id").alias("k"), F.lit(0).alias("lo"), F.lit(1000).alias("hi"))
    right = spark.range(1000).select(F.col("id").alias("v"), F.col("id").cast("double").alias("price"))
    got = joins.range_join(left, right, "lo", "hi", "price", force="broadcast", pairs_per_task=4000)
    each = got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.countDistinct("v").alias("v")).collect()
    assert sum(r["n"] for r in each) == 80_000 and max(r["v"] for r in each) < 150 and max(r["n"] for r in each) < 3 * 4000


def test_written_pairs_take_few_bytes(spark, tmp_path):
    """The right rows of a shelf follow each other for one left row after the other, so their columns nearly vanish."""
    rnd = random.Random(5)
    left = spark.createDataFrame([(i, i - 150, i + 10**6) for i in range(150)], "k long, lo long, hi long").coalesce(1)
    right = spark.createDataFrame([(rnd.getrandbits(60), rnd.uniform(200, 10**6)) for _ in range(20_000)], "v long, price double")
    joins.range_join(left, right, "lo", "hi", "price", force="broadcast").write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").distinct().count() == 150 * 20_000
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 150 * 20_000


def test_range_join_bucketed_returns_every_pair(spark, tmp_path):
    """A row for each vehicle in a customer's band, copies and equal prices included."""
    from salesmatch.plans import q_matching

    spark.createDataFrame([(3, "a", "x", 1000.0), (13, "b", "x", 1000.0), (10, "c", "x", 700.0), (None, "d", "x", 1.0)],
                          "c_custkey long, c_name string, c_mktsegment string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(j, "m", "n o", "t", 1, p) for j, p in enumerate([800.0, 800.0, 1300.0, 1300.5, 799.9, None])] + [(0, "m", "n o", "t", 1, 800.0)],
                          "p_partkey long, p_brand string, p_name string, p_type string, p_size int, p_retailprice double"
                          ).write.parquet(f"{tmp_path}/part.parquet")
    got = q_matching.range_join_bucketed(spark, str(tmp_path))
    assert got.columns == ["customer_id", "vehicle_id", "price", "budget_min", "budget_max"]
    band = [(0, 800.0), (0, 800.0), (1, 800.0), (2, 1300.0)]
    assert rows(got, *got.columns) == sorted([(k, v, p, 800, 1300) for k in (3, 13) for v, p in band] + [
        (10, v, p, 0, 910) for v, p in [(0, 800.0), (0, 800.0), (1, 800.0), (4, 799.9)]])


def test_range_join_empty_right(spark):
    left, right = _random_tables(spark)
    assert joins.range_join(left, right.limit(0), "lo", "hi", "price").count() == 0


@pytest.mark.parametrize("k,probes", [(1, 200_000), (3, 200_000), (20, 200_000), (2, 3)])
def test_first_k_in_range_matches_brute_force(spark, monkeypatch, k, probes):
    monkeypatch.setattr(joins, "PROBES_PER_TASK", probes)  # 3: hot units are read in salted copies
    left, right = _random_tables(spark)
    got = joins.first_k_in_range(left, right, "lo", "hi", "price", "v", "k", k)
    w = Window.partitionBy("k").orderBy("price", "v")
    expect = (joins.naive_range_join(left, right, "lo", "hi", "price")
              .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))
    assert rows(got, "k", "v", "rank") == rows(expect, "k", "v", "rank")


# --- enrichment, ranking (J2, W1-W5, T8-T10) ----------------------------------

def test_enrich_cuts_before_dropping_unknown(spark):
    items = spark.createDataFrame([(1, 1, 10), (1, 2, 99), (1, 3, 12), (1, 4, 13)],
                                  "list_id long, pos int, vehicle_id long")
    catalog = spark.createDataFrame([(10, "a"), (12, "b"), (13, "c")], "vehicle_id long, make string")
    out = joins.enrich(items, catalog, top_n=3)
    assert rows(out, "pos", "vehicle_id") == [(1, 10), (3, 12)]


def test_latest_per_key_breaks_date_ties_by_id(spark):
    df = spark.createDataFrame([(1, "2024-01-02", 5), (1, "2024-01-02", 9), (1, "2024-01-01", 20),
                                (2, "2023-05-05", 1)], "c long, d string, id long")
    out = ranking.latest_per_key(df, ["c"], ["d", "id"])
    assert rows(out, "c", "id") == [(1, 9), (2, 1)]


def test_rerank_keeps_model_position(spark):
    df = spark.createDataFrame([(1, 1, 10, 93), (1, 2, 11, 95), (1, 3, 12, 80)],
                               "list_id long, pos int, vehicle_id long, match_score int")
    out = ranking.rerank(df, ["list_id"], "match_score", "vehicle_id")
    assert rows(out, "pos", "score_rank") == [(1, 2), (2, 1), (3, 3)]


def test_down_sample_keeps_every_tenth_and_last(spark):
    df = spark.range(60).select(F.lit("s").alias("k"), F.col("id").alias("t"))
    out = ranking.down_sample(df, ["k"], "t", 10)
    assert [r[0] for r in out.orderBy("t").select("point_index").collect()] == [0, 10, 20, 30, 40, 50, 59]


def test_top_k_plan_limits_before_window(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v")).repartition(4)
    plan = ranking.top_k(df, ["k"], [F.col("v").desc()], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


# --- dashboards (A1-A4, A10, T12-T14) -----------------------------------------

TRACES = [  # invented rows: latencies 100 + 300 + 500, tokens 10 + 20 + 30
    ("a", "ERROR", 9000.0, 70, "chat_completion"),
    ("b", "OK", 100.0, 10, "insight_extraction"),
    ("c", "OK", 300.0, 20, "vehicle_recommendation"),
    ("d", "OK", 500.0, None, "chat_completion"),
    ("e", "OK", 700.0, 30, "insight_extraction"),
]


def test_trace_dashboard_golden(spark):
    df = spark.createDataFrame(TRACES, "trace_id string, status string, execution_time_ms double, "
                                       "total_tokens int, trace_name string")
    r = metrics.trace_dashboard(df).first()
    assert (r.total, r.ok, r.error) == (5, 4, 1)
    assert r.error_rate == pytest.approx(0.2)
    assert r.avg_latency_ms == pytest.approx(400.0)
    assert r.total_tokens == 60  # a failed call's tokens do not count
    assert r.estimated_cost_usd == pytest.approx(0.0009)
    assert r.alert is True
    u = metrics.usage_by_type(df, {"rec": "recommendation", "ins": "insight", "chat": "chat"}).first()
    assert (u.rec, u.ins, u.chat) == (1, 2, 2)


def test_trace_dashboard_empty_is_zero(spark):
    df = spark.createDataFrame([], "trace_id string, status string, execution_time_ms double, total_tokens int")
    r = metrics.trace_dashboard(df).first()
    assert (r.total, r.error_rate, r.avg_latency_ms, r.total_tokens) == (0, 0.0, 0.0, 0)


def test_rating_summary_golden(spark):
    df = spark.createDataFrame([(5, None), (5, ""), (4, "ok")], "rating int, ground_truth string")
    r = metrics.rating_summary(df).first()
    assert r.total_evaluations == 3 and r.avg_rating == pytest.approx(4.666667)
    assert (r.rating_5, r.rating_4, r.rating_3, r.rating_2, r.rating_1) == (2, 1, 0, 0, 0)
    assert r.with_ground_truth == 1


def test_recent_mean_zero_requests_guard(spark):
    s = spark.createDataFrame([(i, 0, 1.0, 1.0, 1.0, 1.0, 0, 0) for i in range(7)],
                              "minute long, requests long, avg_latency_ms double, p50_latency_ms double, "
                              "p95_latency_ms double, p99_latency_ms double, error_count long, tokens long")
    assert metrics.recent_mean(s).first().error_rate == 0.0


SERIES = ("minute timestamp, requests long, avg_latency_ms double, p50_latency_ms double, p95_latency_ms double, "
          "p99_latency_ms double, error_count long, tokens long")


def test_recent_mean_golden(spark):
    """The five newest of seven points; the older ones would change every mean."""
    start = datetime(2024, 1, 1, 10, 0)
    newest = [(55, 1250.0, 850.0, 1450.0, 3300.0), (58, 1280.0, 870.0, 1500.0, 3360.0), (61, 1310.0, 890.0, 1550.0, 3420.0),
              (64, 1340.0, 910.0, 1600.0, 3480.0), (67, 1370.0, 930.0, 1650.0, 3540.0)]
    old = [(9000, 1.0, 1.0, 1.0, 1.0)] * 2
    rows_ = [(start + timedelta(minutes=i), *r, 1 if r in old else 0, 0) for i, r in enumerate([*old, *newest])]
    r = metrics.recent_mean(spark.createDataFrame(rows_, SERIES)).first()
    assert (r.requests_per_minute, r.avg_latency_ms, r.p50_latency_ms, r.p95_latency_ms, r.p99_latency_ms, r.error_rate) == (
        61.0, 1310.0, 890.0, 1550.0, 3420.0, 0.0)


def test_hour_totals_golden(spark):
    start = datetime(2024, 1, 1, 10, 0)
    rows_ = [(start + timedelta(minutes=i), 57, 1.0, 1.0, 1.0, 1.0, 0, 82_500) for i in range(60)]
    r = metrics.hour_totals(spark.createDataFrame(rows_, SERIES)).first()
    assert (r.total_requests, r.total_tokens, r.estimated_cost_usd) == (3_420, 4_950_000, 74.25)


def test_newest_minutes_filter_reaches_the_scan(spark, tmp_path):
    start = datetime(2024, 1, 1, 10, 0)
    rows_ = [(start + timedelta(minutes=i // 3), float(i)) for i in range(60)] + [(None, 1.0)]
    spark.createDataFrame(rows_, "ts timestamp_ntz, v double").write.parquet(str(tmp_path / "e"))
    newest = metrics.newest_minutes(spark.read.parquet(str(tmp_path / "e")))
    assert sorted(r.v for r in newest.collect()) == [float(i) for i in range(45, 60)]
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-01T10:15)" in plan and "Join" not in plan
    assert metrics.newest_minutes(spark.read.parquet(str(tmp_path / "e")).limit(0)).count() == 0


def test_series_uses_one_window(spark):
    df = spark.createDataFrame([], "ts timestamp, execution_time_ms double, status string, total_tokens int")
    plan = metrics.minute_series(df)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window ") == 1


def test_sketches_merge_within_their_error(spark):
    rnd = random.Random(2)
    start = datetime(2024, 1, 1, 10, 0)
    rows_ = [(start + timedelta(minutes=int(rnd.random() ** 3 * 90)), rnd.lognormvariate(5, 1), "OK", 1) for _ in range(30_000)]
    rows_ += [(start, None, "ERROR", None)] * 3
    df = spark.createDataFrame(rows_, "ts timestamp, execution_time_ms double, status string, total_tokens int").repartition(7)
    minutes = metrics.minute_sketches(df, k=200)
    hours = metrics.merge_sketches(minutes, [F.date_trunc("hour", "minute").alias("hour")], k=200)
    got = metrics.sketch_series(hours)
    sums = {r.hour: (r.requests, r.error_count, r.tokens) for r in got.collect()}
    assert sum(n for n, _, _ in sums.values()) == 30_003 and sum(e for _, e, _ in sums.values()) == 3
    errors = metrics.rank_errors(df, got, "hour", F.date_trunc("hour", "ts")).collect()
    assert len(errors) == 2 and all(max(r.p50, r.p95, r.p99) <= 2 * metrics.sketch_rank_error(200) for r in errors)
    exact = {r.minute: r for r in metrics.minute_series(df).collect()}
    small = [r for r in metrics.sketch_series(minutes).collect() if r.requests < 100]
    assert all(exact[r.minute].avg_latency_ms == r.avg_latency_ms for r in small)


def test_scale_to_max_zero_guard(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0)], "k string, n long")
    assert [r.pct_of_max for r in metrics.scale_to_max(df, "n").collect()] == [0.0, 0.0]


def test_minute_series_exact_percentiles(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:10", float(v), "OK", 1) for v in range(1, 101)],
                               "ts string, execution_time_ms double, status string, total_tokens int"
                               ).withColumn("ts", F.col("ts").cast("timestamp"))
    r = metrics.minute_series(df).first()
    assert r.requests == 100 and r.p50_latency_ms == pytest.approx(50.5)
    assert r.p95_latency_ms == pytest.approx(95.05) and r.tokens == 100


# --- filters, search, paging (P3, P7, P8, T5-T7) -------------------------------

def test_optional_filter_zero_means_absent(spark):
    df = spark.createDataFrame([(1, "SUV", 100), (2, "SUV", 300), (3, "VAN", 200)],
                               "vehicle_id int, body_type string, price int")
    assert filters.optional_filter(df, "", 0, None).count() == 3
    assert rows(filters.optional_filter(df, "SUV", 0, 200), "vehicle_id") == [(1,)]


def test_search_literal_vs_like(spark):
    df = spark.createDataFrame([("ABC", None), ("a%c", "x"), ("itoh", "IT engineer")], "name string, occupation string")
    assert rows(filters.search_literal(df, "b", ["name", "occupation"]), "name") == [("ABC",)]
    assert filters.search_like(df, "b", ["name", "occupation"]).count() == 0
    assert rows(filters.search_literal(df, "%", ["name"]), "name") == [("a%c",)]
    assert rows(filters.search_like(df, "a_c", ["name"]), "name") == [("a%c",)]


def test_page_and_seek(spark):
    df = spark.range(250).withColumnRenamed("id", "k")
    assert [r.k for r in filters.page(df, [F.col("k")], 20, 40).collect()] == list(range(40, 60))
    assert [r.k for r in filters.page_after(df, "k", 99, 3).collect()] == [100, 101, 102]
    with pytest.raises(ValueError):
        filters.page(df, [F.col("k")], 101, 0)


# --- text helpers (F2-F16) ------------------------------------------------------

def test_text_helpers(spark):
    df = spark.createDataFrame([("x" * 65, ["a", "b", "c", "d"]), ("", []), ("日本語テキスト", None)],
                               "t string, l array<string>")
    out = df.select(F.size(TX.chunks("t", 30)).alias("n"), TX.truncate("t", 3).alias("tr"),
                    TX.list_text("l").alias("lt"), TX.tail_or_all("l", 3).alias("rest"),
                    TX.short_label("t", 2).alias("lab")).collect()
    assert [r.n for r in out] == [3, 0, 1]
    assert out[2].tr == "日本語..." and out[1].tr == ""
    assert [r.lt for r in out] == ["a, b, c, d", "-", "-"]
    assert out[0].rest == ["d"] and out[1].rest == []
    assert out[2].lab == "日本..."


def test_labels(spark):
    df = spark.createDataFrame([(2000000, 3000000, 12345.0), (0, 5, 999.0), (None, 5, None)],
                               "lo long, hi long, price double")
    out = df.select(TX.budget_label("lo", "hi").alias("b"), TX.price_label("price").alias("p")).collect()
    assert out[0].b == "¥2,000,000 〜 ¥3,000,000" and out[1].b == "-" and out[2].b == "-"
    assert out[0].p == "1万円" and out[1].p == "999.0円"


# --- sessions, routing, agent fold (C1-C3, X5, X10, X11, T25) -------------------

def test_sessions(spark):
    turns = spark.createDataFrame([("s1", 0, "system", "ctx"), ("s1", 1, "user", "hi"), ("s2", 0, "user", "yo")],
                                  "session_id string, turn long, role string, content string")
    assert rows(sessions.history(turns), "session_id", "turn") == [("s1", 1), ("s2", 0)]
    assert sessions.clear(turns, turns.where("session_id = 's1'")).count() == 1
    ctx = spark.createDataFrame([("s2", "profile")], "session_id string, context string")
    req = sessions.with_context(turns.where("session_id = 's2'"), ctx)
    assert rows(req, "turn", "role") == [(-1, "system"), (0, "user")]


def test_route_rule_order(spark):
    df = spark.createDataFrame([("Please RECOMMEND and give insight",), ("トークを",), ("hello",)], "t string")
    assert [r[0] for r in df.select(requests.route("t")).collect()] == ["insight", "talk_script", "default"]


def test_agent_fold_branch_order(spark):
    items = spark.createDataFrame([
        ("s", 0, "function_call", None, None),
        ("s", 1, "message", "assistant", "<name>knowledge-bot</name> looking"),
        ("s", 2, "message", "assistant", "A real answer mentioning Genie"),
        ("s", 3, "message", "assistant", "see <NAME>Tavily results"),
        ("s", 4, "message", "assistant", "Final answer text"),
        ("s", 5, "message", "assistant", " <short routing>"),
        ("s", 6, "message", "user", "thanks"),
        ("e", 0, "message", "assistant", ""),
    ], "session_id string, pos int, type string, role string, text string")
    rules = [requests.OutputRule("prefix", "<name>knowledge-bot</name>", "knowledge"),
             requests.OutputRule("anywhere", "Genie", "data"),
             requests.OutputRule("anywhere_any_case", "<name>tavily", "web")]
    out = {r.session_id: r for r in requests.agent_fold(items, rules).collect()}
    assert out["s"].n_progress == 4 and out["s"].final_answer == "Final answer text"
    assert out["s"].last_progress == "web"
    assert out["e"].final_answer == "" and out["e"].n_progress == 0


def test_batch_scorer_is_pluggable(spark):
    req = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "customer_id long, prompt string")
    schema = T.StructType([T.StructField("reply", T.StringType())])

    def shout(batch):  # two replies for the first request of a call, none for a null one
        said = batch["prompt"].dropna().str.upper().to_frame("reply")
        return pd.concat([said, said.iloc[:1]])

    out = requests.score_batch(req.coalesce(1), shout, inputs=["prompt"], schema=schema)
    assert rows(out, "customer_id", "reply") == [(1, "A"), (1, "A"), (2, "B")]

    def sized(batch):
        assert len(batch) <= 7
        return batch[["prompt"]].rename(columns={"prompt": "reply"})

    many = spark.range(25).selectExpr("id AS customer_id", "CAST(id AS STRING) AS prompt").coalesce(1)
    got = requests.score_batch(many, sized, inputs=["prompt"], max_records_per_batch=7, schema=schema)
    assert rows(got, "customer_id", "reply") == [(i, str(i)) for i in range(25)]


def test_default_scorer_ranks_and_takes_nulls(spark):
    req = spark.createDataFrame([
        (1, 0, 200, "suv", [5, 4, 3, 2], [100.0, 100.0, 300.0, 50.0], ["suv", "suv", "suv", None], [True, True, True, False]),
        (2, 0, 200, None, [7], [10.0], ["van"], [None]), (3, 0, 200, "suv", None, None, None, None), (4, 0, 9, "suv", [], [], [], [])],
        "customer_id long, low long, high long, body_type string, vehicle_ids array<long>, prices array<double>, "
        "body_types array<string>, has_feature array<boolean>")
    got = requests.score_batch(req).orderBy("customer_id", "position").collect()
    assert [tuple(r) for r in got] == [
        (1, 1, 4, 100, "in budget, wanted body type"), (1, 2, 5, 100, "in budget, wanted body type"),
        (1, 3, 3, 80, "over budget, wanted body type"), (2, 1, 7, 70, "in budget")]


# --- key replacement and quality (S9, S10, Q1-Q7) ------------------------------

def test_replace_and_delete_by_key(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string")
    new = spark.createDataFrame([(1, "z"), (3, "y")], "k long, v string")
    assert rows(io.replace_by_key(old, new, ["k"]), "k", "v") == [(1, "z"), (2, "c"), (3, "y")]
    assert rows(io.delete_by_key(old, new, ["k"]), "k", "v") == [(2, "c")]


def test_quality_checks(spark):
    from salesmatch.operators import quality

    df = spark.createDataFrame([(1, 5, "user"), (1, 0, None), (2, 6, "bot")], "k long, rating int, role string")
    nulls = rows(quality.null_counts(df, ["k", "role"], "t"), "column_name", "n_null")
    assert nulls == [("k", 0), ("role", 1)]
    d = quality.duplicate_keys(df, ["k"], "t").first()
    assert (d.n_duplicate_keys, d.n_rows_in_duplicates) == (1, 2)
    b = rows(quality.bound_violations(df, {"rating": F.col("rating").between(1, 5),
                                           "role": F.col("role").isin("user", "assistant", "system")}),
             "check_name", "n_violations")
    assert b == [("rating", 2), ("role", 2)]
    out = quality.intake(df, F.col("rating").between(1, 5), ["k", "rating"], "id", "m", at="2024-01-01 00:00:00")
    assert rows(out, "rating", "status") == [(0, "rejected"), (5, "accepted"), (6, "rejected")]


def test_orphans_ignore_null_keys(spark):
    child = spark.createDataFrame([(1,), (2,), (None,)], "fk long")
    parent = spark.createDataFrame([(1,)], "pk long")
    assert rows(joins.orphans(child, parent, "fk", "pk"), "fk") == [(2,)]


# --- needs, scoring, fallback (X6, X7, X9) ---------------------------------------

def test_score_components(spark):
    df = spark.createDataFrame([
        (100.0, "SUV", ["safe", "red"], "SUV", ["safe"], 90, 110),
        (150.0, "VAN", ["red"], "SUV", ["safe"], 90, 110),
        (100.0, "VAN", ["red"], None, None, 90, 110),
        (100.0, "VAN", ["red"], "VAN", [], 90, 110),
    ], "price double, body_type string, features array<string>, desired_body_type string, "
       "must_have_features array<string>, elo long, ehi long")
    got = [r[0] for r in df.select(matching.score(F.col("elo"), F.col("ehi"))).collect()]
    assert got == [100, 20, 70, 100]


def test_needs_lexicon(spark):
    df = spark.createDataFrame([(1, "We have kids and need a SAFE car for 300 yen"), (1, "nothing"), (2, "")],
                               "k long, text string")
    out = {r.k: r for r in matching.needs_lexicon(df, "k", "text").collect()}
    assert out[1].needs == "family,safety" and out[1].amount_mentions == 1 and out[1].texts == 2
    assert out[2].needs == "-"


def test_parameterized_lookup_is_not_spliced(spark):
    df = spark.createDataFrame([("O'Brien", 1), ("x' OR '1'='1", 2), ("z", 3)], "name string, n int")
    assert [r.n for r in filters.lookup_param(df, "name", "O'Brien").collect()] == [1]
    assert filters.lookup_param(df, "name", "' OR '1'='1").count() == 0


def test_alias_missing_in_array(spark):
    df = spark.createDataFrame([([({"vehicle_id": "V1", "image_path": "a.png"}, 90)],)],
                               "recs array<struct<vehicle: struct<vehicle_id: string, image_path: string>, "
                               "match_score: int>>")
    out = filters.alias_missing_in_array(df, "recs", "vehicle", "image_url", "image_path").first()
    assert out.recs[0].vehicle.image_url == "a.png" and out.recs[0].match_score == 90


def test_time_helpers(spark):
    df = spark.createDataFrame([(1704067200123,)], "ms long")
    r = df.select(TX.from_epoch_ms("ms").alias("t")).select(
        "t", TX.epoch_ms("t").alias("back"), TX.iso_text("t").alias("iso"),
        (TX.minutes_ago(5) < F.current_timestamp()).alias("past")).first()
    assert r.back == 1704067200123 and r.iso == "2024-01-01T00:00:00.123000" and r.past


@pytest.mark.parametrize("k", [1, 5])
def test_first_k_in_range_with_part_matches_brute_force(spark, k):
    rnd = random.Random(11)
    left = spark.createDataFrame([(i, rnd.randint(0, 600), rnd.randint(300, 1100), rnd.choice("abcz"))
                                  for i in range(80)], "k long, lo long, hi long, g string")
    right = spark.createDataFrame([(j, 500.0 if j % 3 == 0 else float(rnd.randint(0, 1000)),
                                    "a" if j % 2 == 0 else rnd.choice("bc")) for j in range(400)],
                                  "v long, price double, g string")
    got = joins.first_k_in_range(left, right, "lo", "hi", "price", "v", "k", k, part="g")
    w = Window.partitionBy("k").orderBy("price", "v")
    expect = (left.join(right, "g").where(F.col("price").between(F.col("lo"), F.col("hi")))
              .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))
    assert rows(got, "k", "v", "rank") == rows(expect, "k", "v", "rank")


@pytest.mark.parametrize("seed", [1, 2])
def test_widened_recommender_matches_all_pairs(spark, seed):
    rnd = random.Random(seed)
    types, words = ["SUV", "VAN", "MINI"], ["red", "blue", "safe", "big"]
    vehicles = spark.createDataFrame(
        [(j, rnd.choice("XYZ"), f"m{j}", rnd.choice(types), 500.0 if j % 4 == 0 else float(rnd.randint(100, 900)),
          rnd.sample(words, rnd.randint(1, 2)), "in_stock") for j in range(300)],
        "vehicle_id long, make string, model string, body_type string, price double, "
        "features array<string>, stock_status string")
    cust = []
    for i in range(60):
        lo = rnd.randint(100, 700)
        cust.append((i, lo, lo + rnd.randint(0, 300)))
    customers = spark.createDataFrame(cust, "customer_id long, budget_min long, budget_max long")
    needs = spark.createDataFrame(
        [(i, rnd.choice(types + [None]), rnd.choice([None, [], [rnd.choice(words)], rnd.sample(words, 2)]))
         for i in range(60)], "customer_id long, desired_body_type string, must_have_features array<string>")
    got = matching.recommend(customers, vehicles, needs, k=3, policy="widened")
    lo, hi = matching.widened_bounds()
    elo, ehi = matching.exact_bounds()
    c = customers.join(needs, "customer_id", "left").select(
        "customer_id", "desired_body_type", "must_have_features", lo.alias("lo"), hi.alias("hi"),
        elo.alias("exact_lo"), ehi.alias("exact_hi"))
    allp = joins.naive_range_join(c, vehicles, "lo", "hi", "price").withColumn(
        "match_score", matching.score(F.col("exact_lo"), F.col("exact_hi")))
    expect = ranking.top_k(allp, ["customer_id"], [F.col("match_score").desc(), F.col("price"),
                                                    F.col("vehicle_id")], 3)
    cols = ("customer_id", "rank", "vehicle_id", "match_score")
    assert rows(got, *cols) == rows(expect, *cols)


def test_read_cached_takes_latest_and_aliases_images(spark):
    old = '[{"vehicle": {"vehicle_id": "V9", "image_path": "old.png"}, "match_score": 50, "reason": "x"}]'
    new = ('[{"vehicle": {"vehicle_id": "V1", "image_path": "a.png"}, "match_score": 93, "reason": "r1"},'
           ' {"vehicle": {"vehicle_id": "V2", "image_url": "b.jpg", "image_path": "b.png"}, "match_score": 95,'
           ' "reason": "r2"}]')
    cache = spark.createDataFrame(
        [("r1", "C1", old, "s0", "2024-01-01 00:00:00"), ("r2", "C1", new, "s1", "2024-02-01 00:00:00")],
        "recommendation_id string, customer_id string, recommendations_json string, talk_script string, "
        "generated_at string").withColumn("generated_at", F.col("generated_at").cast("timestamp"))
    out = requests.read_cached(cache).orderBy("position").collect()
    assert [(r.position, r.vehicle.vehicle_id, r.vehicle.image_url, r.match_score) for r in out] == [
        (1, "V1", "a.png", 93), (2, "V2", "b.jpg", 95)]
    assert out[0].talk_script == "s1"


def test_first_k_in_range_empty_right(spark):
    left, right = _random_tables(spark)
    out = joins.first_k_in_range(left, right.limit(0), "lo", "hi", "price", "v", "k", 3)
    assert out.count() == 0 and "rank" in out.columns and "_part" not in out.columns


def test_starts_read_two_units_whatever_the_size_and_outliers(spark):
    left = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("lo"), F.lit(10**12).alias("hi"))
    for n, extra in ((2_000, 0), (50_000, 0), (2_000, 1)):
        right = spark.range(n).select(F.col("id").alias("v"), (F.col("id") % 500).cast("double").alias("price"))
        if extra:
            right = right.union(spark.range(1).select(F.lit(-1).cast("long"), F.lit(1e9)))
        ranked, starts = joins.rank_probes(left, right, "price", "v", "lo", "k")
        assert ranked.agg(F.countDistinct("_rank"), F.max("_rank")).first() == (n + extra, n + extra - 1)
        pairs = joins.take_ranked(starts, ranked, "k", 20)
        assert pairs.groupBy("k").count().where("count > 20").count() == 0 and pairs.count() > 0


def test_count_in_range_matches_brute_force(spark):
    left, right = _random_tables(spark)
    right = right.union(spark.createDataFrame([(10**6, None), (10**6 + 1, 1e9)], right.schema))
    got = joins.count_in_range(left, right, "lo", "hi", "price", "v", "k")
    expect = joins.naive_range_join(left, right, "lo", "hi", "price").groupBy("k").agg(
        F.count("*").alias("n"), F.min("price").alias("least"))
    assert rows(got, "k", "n", "least") == rows(expect, "k", "n", "least")
