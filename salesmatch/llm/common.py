"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmatch.session import shared_dir

#: The white space that separates words in every contract: \x20 and \x09-\x0D.
ASCII_WS = " \t\n\x0b\x0c\r"


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to a new table in the cluster's shared folder and read it back.

    This cuts lineage: a lost executor costs at most the task it was running,
    and an expensive column is computed once. The folder is marked for
    deletion when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int, size: int):
    """While a table is written inside: at most so many rows and about so many bytes go to Python at once. Whole
    texts beside their derived arrays then take a bounded share of an executor, on the JVM's side too."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def give_back() -> None:
    """Free memory of this Python worker goes back to the machine. Workers live on between tasks and stages; what
    they keep is missing in the executor's share. Where the C library has no such calls nothing is done."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def tidy(run):
    """``run``, a function for mapInArrow, giving memory back when it ends."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def shuffle_width(spark: SparkSession) -> int:
    """Number of buckets for explicit key buckets: the session's shuffle width."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(name: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII values take the quick built-in; others are
    translated letter by letter, since ``lower`` would change other letters too."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, upper, upper.lower()))


def join_hot_keys(rows: DataFrame, table: DataFrame, key: str, count: str = "_n", hot: int = 200) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each ``key`` (null included) and in ``count``
    the number of its rows. Keys with more than one in ``hot`` of all rows are fewer than ``hot``: they are
    broadcast, so no task gets their rows; the others meet by a shuffle."""
    table = written(table.withColumnRenamed(key, "_key"), "keys")
    total = table.agg(F.sum(count)).first()[0] or 0
    many = F.col(count) * hot > total
    on = F.col(key).eqNullSafe(F.col("_key"))
    often, seldom = table.where(many).drop(count), table.where(~many).drop(count)
    if not seldom.limit(1).count():
        return rows.join(F.broadcast(often), on).drop("_key")
    return rows.join(F.broadcast(often), on).drop("_key").union(
        rows.join(F.broadcast(often.select("_key")), on, "left_anti").join(seldom, on).drop("_key"))
