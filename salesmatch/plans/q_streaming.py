"""Streaming query over the events table."""

from __future__ import annotations

import uuid

from salesmatch.plans import bindings as B
from salesmatch.plans.q_metrics import _MINUTE_SQL
from salesmatch.plans.registry import query
from salesmatch.session import shared_dir
from salesmatch.streaming.minute_metrics import run_available


@query("stream_minute_metrics", B.with_ctes("traces") + "," + _MINUTE_SQL + "\nSELECT * FROM series")
def stream_minute_metrics(spark, sf_dir):
    """ST1: per-minute metrics computed incrementally with a 10-minute watermark;
    the minutes still open at the end of the run are reported too."""
    base = f"{shared_dir(spark)}/stream-minute-metrics-{uuid.uuid4().hex}"
    return run_available(spark, f"{sf_dir.rstrip('/')}/events.parquet", f"{base}/counts", f"{base}/checkpoint")
