"""Chat sessions as a long table.

The reference keeps sessions in a per-process dict, which loses them between
server workers; here a session is the set of rows (session_id, turn, role,
content). History stays long (one row per turn, ordered by ``turn``) instead
of one array per session, so a very long session never becomes one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmatch.operators.filters import without_system
from salesmatch.sources.io import delete_by_key

CONTEXT_TURN = -1


def append_turns(turns: DataFrame, new_turns: DataFrame) -> DataFrame:
    """Append turns (ids and order come with the rows)."""
    return turns.unionByName(new_turns)


def history(turns: DataFrame) -> DataFrame:
    """The visible history: every turn except system rows, ordered by
    (session_id, turn); range partitioning splits long sessions across tasks."""
    return without_system(turns).orderBy("session_id", "turn")


def clear(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """Drop whole sessions."""
    return delete_by_key(turns, sessions, ["session_id"])


def with_context(turns: DataFrame, contexts: DataFrame, content: Column | str = "context") -> DataFrame:
    """A request = one system context row (turn -1) per session, followed
    by the session's turns. ``contexts`` holds (session_id, <content>)."""
    ctx = contexts.select(
        "session_id", F.lit(CONTEXT_TURN).cast(turns.schema["turn"].dataType).alias("turn"),
        F.lit("system").alias("role"),
        (F.col(content) if isinstance(content, str) else content).alias("content"))
    return ctx.unionByName(turns.select("session_id", "turn", "role", "content"))


def default_contexts(turns: DataFrame, contexts: DataFrame, default: str) -> DataFrame:
    """``contexts`` (session_id, context) and ``default`` for every other session that has turns."""
    others = turns.select("session_id").distinct().join(contexts.select("session_id"), "session_id", "left_anti")
    return contexts.select("session_id", "context").unionByName(others.withColumn("context", F.lit(default)))
