"""Seek paging over a page directory (O3).

One ranked pass over the key columns gives the first key of every page. A page is
then read by its key range: two directory rows become literals in a filter on the
first key column, which reaches the scan, so the cost does not depend on the page's
number, and no row before the page is sorted or skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmatch.session import scratch_path


def page_directory(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """page (from 0), the page's first key, and n_rows of every page, in ascending order of ``keys``, which must be
    a total order (end with the primary key). Null keys come first.

    The keys alone are sorted by range and written; the place of a row is its number in its range plus the rows of
    the ranges before (one row a range)."""
    spark = df.sparkSession
    path = scratch_path(spark, "paged")
    narrow = df.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    narrow.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    total, starts = 0, []
    for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect():  # a row for each range
        starts.append((r["_part"], total))
        total += r["n"]
    offsets = spark.createDataFrame(starts, "_part long, _offset long")
    rank = F.col("_offset") + F.col("_at").bitwiseAND((1 << 33) - 1)
    firsts = placed.join(F.broadcast(offsets), "_part").withColumn("_rank", rank).where(F.col("_rank") % size == 0)
    return firsts.select((F.col("_rank") / size).cast("long").alias("page"), *keys,
                         F.least(F.lit(size), F.lit(total) - F.col("_rank")).cast("long").alias("n_rows"))


def _from(keys: list[str], first: dict, include: bool) -> Column:
    """Rows at or after (``include``) or before the key ``first`` in ascending order with nulls first."""
    out = F.lit(include)
    for k in reversed(keys):
        at, c = F.lit(first[k]), F.col(k)
        if first[k] is None:
            out = c.isNotNull() | out if include else c.isNull() & out
        elif include:
            out = F.coalesce((c > at) | ((c == at) & out), F.lit(False))
        else:
            out = F.coalesce((c < at) | ((c == at) & out), F.lit(True))
    return out


def read_page(df: DataFrame, directory: DataFrame, keys: list[str], page: int) -> DataFrame:
    """The rows of one page of ``df`` in order; empty beyond the last page. Fetches at most two directory rows."""
    ends = {r.page: r.asDict() for r in directory.where(F.col("page").isin(page, page + 1)).collect()}
    if page not in ends:
        return df.limit(0)
    rows, lead = df.where(_from(keys, ends[page], True)), keys[0]
    if ends[page][lead] is not None:
        rows = rows.where(F.col(lead) >= F.lit(ends[page][lead]))  # plain bounds reach the scan
    if page + 1 in ends:
        rows = rows.where(_from(keys, ends[page + 1], False))
        if ends[page][lead] is not None:
            rows = rows.where(F.col(lead) <= F.lit(ends[page + 1][lead]))
    return rows.orderBy(*keys)
