"""Loads, sinks, catalog metadata (S1-S4, S11, P12, Q5, Q6) and the streaming
minute metrics (ST1) against the batch version."""

import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmatch import schemas
from salesmatch.operators import metrics
from salesmatch.sources import io
from salesmatch.streaming import minute_metrics as ST


def test_typed_load_keeps_declared_types(spark):
    rows = [{"vehicle_id": "V1", "price": 2_980_000, "features": ["a"], "make": "X"}]
    df = io.typed_load(spark, rows, schemas.VEHICLES)
    assert dict(df.dtypes)["price"] == "int" and df.columns == schemas.VEHICLES.fieldNames()
    assert df.first().features == ["a"]


def test_overwrite_replaces_schema_and_metadata(spark):
    io.ensure_namespace(spark, "sm_test")
    a = spark.createDataFrame([(1, "x")], "id long, v string")
    io.overwrite(a, table="sm_test.cars")
    b = spark.createDataFrame([(2, 3.5, "y")], "id long, w double, z string")
    io.overwrite(b, table="sm_test.cars")
    assert spark.table("sm_test.cars").columns == ["id", "w", "z"]
    io.comment_table(spark, "sm_test.cars", "inventory's cars", {"id": "key"})
    assert io.tag_table(spark, "sm_test.cars", {"certified": "true"})
    desc = {r.col_name: r.data_type for r in io.describe_rows(spark, "sm_test.cars",
                                                                ["Comment", "Table Properties"]).collect()}
    assert desc["Comment"] == "inventory's cars" and "certified=true" in desc["Table Properties"]
    assert not io.tag_table(spark, "sm_test.no_such_table", {"x": "y"})
    spark.catalog.setCurrentDatabase("default")


def test_write_replacing_never_overwrites_source(spark):
    base = tempfile.mkdtemp(prefix="sm-src-")
    old_path, out_path = os.path.join(base, "old"), os.path.join(base, "new")
    spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string").write.parquet(old_path)
    new = spark.createDataFrame([(2, "z")], "k long, v string")
    io.write_replacing(spark, old_path, new, ["k"], out_path)
    got = sorted(tuple(r) for r in spark.read.parquet(out_path).collect())
    assert got == [(1, "a"), (2, "z")]
    try:
        io.write_replacing(spark, old_path, new, ["k"], old_path)
        raise AssertionError("expected refusal")
    except ValueError:
        pass


def test_preview_and_profile(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    assert [r.k for r in io.preview(df, 3, ["k"]).collect()] == [0, 1, 2]
    prof = {r.table_name: r for r in io.profile_tables({"a": df, "b": df.limit(7)}).collect()}
    assert prof["a"].row_count == 500 and prof["b"].row_count == 7 and prof["a"].total_rows == 507


def test_stamp_is_deterministic_with_keys(spark):
    df = spark.createDataFrame([(1, "x")], "k long, v string")
    a = io.stamp(df, "id", "m", key_cols=["k", "v"], at="2024-01-01 00:00:00").first()
    b = io.stamp(df, "id", "m", key_cols=["k", "v"], at="2024-01-01 00:00:00").first()
    assert a.id == b.id and len(a.id) == 64 and a.model_used == "m"
    assert len(io.stamp(df, "id", "m").first().id) == 36


def test_stream_matches_batch_and_resumes(spark):
    src, own = tempfile.mkdtemp(prefix="sm-events-"), tempfile.mkdtemp(prefix="sm-stream-")
    base = pd.Timestamp("2024-01-01 00:00:00")

    def add(part):
        pdf = pd.DataFrame({
            "event_id": range(part * 100, part * 100 + 100),
            "ts": [base + pd.Timedelta(seconds=17 * (part * 100 + i)) for i in range(100)],
            "user_id": [i % 5 for i in range(100)],
            "event_type": ["error" if i % 9 == 0 else "view" for i in range(100)],
            "value": [float((i * 37) % 101) for i in range(100)],
            "props": ['{"k": %d}' % (i % 13) for i in range(100)],
        })
        spark.createDataFrame(pdf, ST.EVENT_SCHEMA).write.mode("append").parquet(src)

    def check():
        streamed = ST.run_available(spark, src, f"{own}/counts", f"{own}/checkpoint")
        batch = metrics.minute_series(ST.trace_stream(spark.read.schema(ST.EVENT_SCHEMA).parquet(src)))
        got, expect = (sorted(tuple(r) for r in d.select(*batch.columns).collect()) for d in (streamed, batch))
        assert got == expect and len(got) > 0
        return spark.read.parquet(f"{own}/counts").select("minute").distinct().count()

    add(0)
    first = check()
    add(1)
    assert check() > first > 0  # only the new file is read; open minutes have closed
    assert check() > 0  # nothing new


def test_minute_series_with_a_hot_minute_and_null_latency(spark):
    rows = spark.range(1_000_000).select(
        F.when(F.col("id") < 999_990, F.timestamp_seconds(F.lit(60))).otherwise(F.timestamp_seconds(F.lit(180))).alias("ts"),
        F.when(F.col("id") % 10 == 3, F.lit(None)).otherwise((F.col("id") * 7919 % 100_003).cast("double"))
        .alias("execution_time_ms"), F.lit("OK").alias("status"), F.lit(1).alias("total_tokens"))
    got = metrics.minute_series(rows).orderBy("minute").collect()
    expect = rows.groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(
        F.count("*").alias("n"), F.percentile("execution_time_ms", [0.5, 0.95, 0.99]).alias("p"),
        F.avg("execution_time_ms").alias("a")).orderBy("minute").collect()
    assert [(r.requests, r.tokens) for r in got] == [(e.n, e.n) for e in expect]
    for r, e in zip(got, expect):
        assert (r.p50_latency_ms, r.p95_latency_ms, r.p99_latency_ms) == tuple(round(x, 6) for x in e.p)
        assert abs(r.avg_latency_ms - e.a) < 1e-5


def test_conform_declares_types(spark):
    df = spark.createDataFrame([("7", "x", 3, ["a"]), ("8", "9", None, None)], "turn string, extra string, session_id int, features array<string>")
    kind = T.StructType([T.StructField("session_id", T.LongType()), T.StructField("turn", T.IntegerType()),
                         T.StructField("role", T.StringType()), T.StructField("features", T.ArrayType(T.StringType()))])
    got = io.conform(df, kind)
    assert got.dtypes == [("session_id", "bigint"), ("turn", "int"), ("role", "string"), ("features", "array<string>")]
    assert [tuple(r) for r in got.collect()] == [(3, 7, None, ["a"]), (None, 8, None, None)]
    bad = spark.createDataFrame([("x",)], "turn string")
    assert io.conform(bad, T.StructType([T.StructField("turn", T.IntegerType())])).first().turn is None
    with pytest.raises(Exception, match="null in turn"):
        io.conform(bad, T.StructType([T.StructField("turn", T.IntegerType(), False)])).collect()
