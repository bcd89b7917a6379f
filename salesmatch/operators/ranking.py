"""Window functions and top-k.

Top-k uses ``row_number() <= k``: Catalyst turns it into a partial
WindowGroupLimit before the exchange and a final one after it, so each map
task ships at most k rows per key and a hot key cannot flood one reducer.
Top-1 uses an aggregate (``max_by`` over a struct key) with map-side combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int,
          rank_col: str = "rank") -> DataFrame:
    """The first ``k`` rows per key in ``order`` (ties must be broken
    by the caller's order list, e.g. with the item id)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def latest_per_key(df: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    """The row with the greatest ``order_cols`` tuple per key (latest date,
    ties broken by the following columns, e.g. id descending -> largest id).

    Aggregate form: partial ``max_by`` per map task, so the shuffle carries one
    row per key per task whatever the key skew."""
    payload = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[F.col(c) for c in order_cols])
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*payload), ordering).alias("_latest"))
    return agg.select(*keys, "_latest.*")


def rerank(df: DataFrame, keys: list[str], score: str, tie: str, pos: str | None = None,
           rank_col: str = "score_rank") -> DataFrame:
    """Rank by score descending, ties by ``tie`` then ``pos`` ascending;
    original position columns are kept (trap T9: model order is not score order)."""
    order = [F.col(score).desc(), F.col(tie).asc()] + ([F.col(pos).asc()] if pos else [])
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w))


def last_n(df: DataFrame, keys: list[str], ts: str, tie: str, n: int,
           rank_col: str = "recency") -> DataFrame:
    """The last ``n`` points of each series (newest first)."""
    return top_k(df, keys, [F.col(ts).desc(), F.col(tie).desc()], n, rank_col)


def down_sample(series: DataFrame, keys: list[str], ts: str, every: int = 10) -> DataFrame:
    """Every ``every``-th point from the first, plus the last point.

    Applied to an aggregated series (one row per key and time bucket), whose
    size is bounded by the time range, not by the raw data volume."""
    w = Window.partitionBy(*keys).orderBy(F.col(ts))
    wall = Window.partitionBy(*keys)
    return (series.withColumn("point_index", F.row_number().over(w) - 1)
            .withColumn("_n", F.count(F.lit(1)).over(wall))
            .where((F.col("point_index") % every == 0) | (F.col("point_index") == F.col("_n") - 1))
            .drop("_n"))


def first_rows(df: DataFrame, order: list[str], k: int, rank_col: str = "rank") -> DataFrame:
    """The first ``k`` rows of the whole table, ranked: a top-k from each task, then a
    window over the k rows that are left."""
    return df.orderBy(*order).limit(k).withColumn(rank_col, F.row_number().over(Window.orderBy(*order)))
