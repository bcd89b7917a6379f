"""Chat sessions in a keyed table that a stream appends to.

Turn files arrive in a folder. The stream drops repeated (session, turn) rows with
state and appends each micro-batch to a table stored by session bucket. The table's
version carries the number of the last batch it holds: a batch that is run again
after a failure is recognised and not appended twice. A session's history reads its
bucket; clearing sessions rewrites their buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmatch.operators.filters import without_system
from salesmatch.sources.keyed import KeyedTable

TURNS = T.StructType([T.StructField("session_id", T.LongType()), T.StructField("turn", T.LongType()),
                      T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
BUCKETS = 16
_MARK = "session_stream"


def open_store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> KeyedTable:
    """The store at ``path``; a new one is made where there is none."""
    table = KeyedTable(spark, path)
    return table if table.version else KeyedTable.create(spark, path, spark.createDataFrame([], TURNS), ["session_id"], buckets)


def append_available(spark: SparkSession, source: DataFrame, path: str, checkpoint: str) -> KeyedTable:
    """Append the turns that are new in the stream ``source`` (columns of ``TURNS``) and return the store.

    Of rows with one (session, turn) the first to arrive stays, also over several calls with this ``checkpoint``.
    A call that fails is resumed by the next one, from the same batch."""
    open_store(spark, path)

    def add(batch: DataFrame, number: int) -> None:
        table = KeyedTable(spark, path)
        batch.persist()  # evaluated once, also when it is not appended: the stream's state must be kept in step
        try:
            batch.write.format("noop").mode("overwrite").save()
            if table.state["marks"].get(_MARK, -1) < number:
                table.append(batch, {_MARK: number})
        finally:
            batch.unpersist()

    query = (source.dropDuplicates(["session_id", "turn"]).writeStream.foreachBatch(add)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return KeyedTable(spark, path)


def history(table: KeyedTable, session_id: int | None = None) -> DataFrame:
    """The visible turns in order; of one session, read from its bucket, or of all."""
    rows = table.read() if session_id is None else table.read(session_id)
    return without_system(rows).orderBy("session_id", "turn")


def clear(table: KeyedTable, sessions: DataFrame) -> KeyedTable:
    """Drop whole sessions. Turns of them that arrive later are stored again."""
    return table.delete(sessions)


def counts(table: KeyedTable) -> DataFrame:
    """Turns and characters of every session."""
    return table.read().groupBy("session_id").agg(F.count("*").alias("n_turns"), F.sum(F.length("content")).alias("n_chars"))
