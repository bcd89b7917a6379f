"""Data-quality checks (Q1-Q4, Q7). Session-catalog parquet tables refuse
NOT NULL / key constraints, so the constraints become check jobs: each is one
aggregation pass whose result is a handful of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmatch.sources.io import stamp


def null_counts(df: DataFrame, cols: list[str], table: str) -> DataFrame:
    """Q1: nulls per listed column in one pass -> (table_name, column_name, n_null)."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = wide.unpivot([], cols, "column_name", "n_null")
    return long.select(F.lit(table).alias("table_name"), "column_name", "n_null")


def duplicate_keys(df: DataFrame, keys: list[str], table: str) -> DataFrame:
    """Q2: keys occurring more than once -> (table_name, n_duplicate_keys,
    n_rows_in_duplicates). Partial counts per key before the shuffle."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    return per_key.agg(F.count(F.lit(1)).alias("n_duplicate_keys"),
                       F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("n_rows_in_duplicates")
                       ).select(F.lit(table).alias("table_name"), "*")


def bound_violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Q4: rows failing each validity condition (null counts as failing) ->
    (check_name, n_violations)."""
    wide = df.agg(*[F.count_if(~F.coalesce(cond, F.lit(False))).alias(name)
                    for name, cond in checks.items()])
    return wide.unpivot([], list(checks), "check_name", "n_violations")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def intake(records: DataFrame, valid: Column, key_cols: list[str], id_col: str, model_name: str,
           at: str | None = None) -> DataFrame:
    """Q7: stamp new records (id from the keys, time, source) and mark each as
    accepted or rejected by ``valid``; rejects stay in the output as a side
    table instead of being lost."""
    s = stamp(records, id_col, model_name, key_cols=key_cols, at=at, time_col="evaluated_at")
    return s.withColumn("status", F.when(F.coalesce(valid, F.lit(False)), F.lit("accepted"))
                        .otherwise(F.lit("rejected")))
