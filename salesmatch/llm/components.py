"""Connected components of an edge table, by alternating stars.

Large star: every node hangs its larger neighbours on its smallest neighbour;
small star: its smaller neighbours and itself. Repeated until nothing moves,
every component is a star around its smallest node. Each step is an aggregate
with map-side combine and a join; a node with many edges costs one aggregate row
per task, and its join is an ordinary join that Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmatch.llm.common import written


def _smallest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("low"))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of every node of an
    edge between two different nodes. ``edges`` has two columns of one type; loops,
    repeats, nulls and either direction are allowed. An empty table gives an empty one."""
    a, b = edges.columns
    links = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    links = written(links, "links")
    state = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _smallest(both).select("u", F.least("u", "low").alias("low"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v")) \
            .where(F.col("u") != F.col("v")).distinct()
        large = written(large, "large")
        low = _smallest(large)
        small = large.join(low, "u").where(F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v")) \
            .union(low.select("u", F.col("low").alias("v"))).distinct()
        links = written(small, "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        links.select("v", "v").distinct())
