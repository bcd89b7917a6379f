"""ST1: the per-minute trace metrics (A7) as a Structured Streaming job.

Event files arrive in a folder; the job reads them incrementally, casts the
zone-less event time to a timestamp (watermarks need TIMESTAMP, not
TIMESTAMP_NTZ), keeps a watermark so state for old minutes is dropped, and
appends each minute's value counts once it is closed. Output and checkpoint are
the caller's, in the shared folder, so a restarted job resumes exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmatch.operators.metrics import series_from_counts, value_counts

WATERMARK = "10 minutes"

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])

COUNTS_SCHEMA = "minute timestamp, _v double, _n bigint, _e bigint, _t bigint"


def trace_stream(events: DataFrame) -> DataFrame:
    """Streaming twin of the ``traces`` binding."""
    ok = F.col("event_type") != "error"
    return events.select(
        F.col("event_id").alias("trace_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(ok, F.lit("OK")).otherwise(F.lit("ERROR")).alias("status"),
        F.col("value").alias("execution_time_ms"),
        F.when(ok, F.get_json_object("props", "$.k").cast("int")).alias("total_tokens"))


def minute_counts_stream(traces: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Counts by (minute, latency value) under a watermark; rows appear when a minute
    closes. State is one small row a value, spread over all state partitions."""
    counts = value_counts(traces.withWatermark("ts", watermark), [F.window("ts", "1 minute").alias("w")])
    return counts.select(F.col("w.start").alias("minute"), "_v", "_n", "_e", "_t")


def run_available(spark: SparkSession, source: str, out: str, checkpoint: str, watermark: str = WATERMARK) -> DataFrame:
    """Process the files that are new in ``source`` (trigger availableNow) and return
    the series of all minutes as a batch table.

    Closed minutes are appended to the Parquet sink ``out`` as value counts.
    ``checkpoint`` belongs to the sink: a later call with both goes on after the
    files that were read, and a failed call is resumed. Minutes that the watermark
    still holds open are counted from the source's newest rows, those after the
    sink's last minute; they reach the sink in a later call. Rows later than the
    watermark are left out, as in any such stream.
    """
    reader, batch = spark.readStream.schema(EVENT_SCHEMA), spark.read.schema(EVENT_SCHEMA)
    if source.endswith(".parquet"):
        # a single file: read it through its folder so the source has a directory base
        folder, name = source.rsplit("/", 1)
        reader = reader.option("basePath", folder).option("pathGlobFilter", name)
        batch, source = batch.option("pathGlobFilter", name), folder
    q = (minute_counts_stream(trace_stream(reader.parquet(source)), watermark).writeStream
         .outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(out))
    q.awaitTermination()
    closed = spark.read.schema(COUNTS_SCHEMA).parquet(out)
    events = batch.parquet(source).where(F.col("ts").isNotNull())
    last = closed.agg(F.date_format(F.max("minute") + F.expr("INTERVAL 1 MINUTE"), "yyyy-MM-dd HH:mm:ss")).first()[0]
    if last is not None:  # a literal on the stored column: older files and row groups are skipped
        events = events.where(F.col("ts") >= F.lit(last).cast("timestamp_ntz"))
    newer = trace_stream(events)
    tail = value_counts(newer, [F.date_trunc("minute", "ts").alias("minute")])
    return series_from_counts(closed.unionByName(tail.select(*closed.columns)), ["minute"])
