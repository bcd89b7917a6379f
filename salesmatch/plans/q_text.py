"""Text helpers and sessions over conversations and traces."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmatch.functions import text as TX
from salesmatch.functions.text import chunks, head, json_value, map_value, short_label, tail_or_all, truncate
from salesmatch.operators import sessions
from salesmatch.plans import bindings as B
from salesmatch.plans.registry import query


@query("labels_and_truncation", B.with_ctes("chat_turns") + """
SELECT session_id, turn,
       CASE WHEN length(content) > 30 THEN left(content, 30) || '...' ELSE content END AS short_text,
       left(content, 20) || '...' AS label,
       array_to_string(list_slice(string_split(content, ' '), 1, 3), ' ') AS first_words,
       CAST(CASE WHEN len(string_split(content, ' ')) > 3 THEN len(string_split(content, ' ')) - 3
                 ELSE len(string_split(content, ' ')) END AS INTEGER) AS rest_words
FROM chat_turns
""")
def labels_and_truncation(spark, sf_dir):
    """Truncation with ellipsis, fixed label, first words and the rest."""
    t = B.chat_turns(spark, sf_dir)
    words = F.split(F.col("content"), " ")
    return t.select("session_id", "turn", truncate("content", 30).alias("short_text"),
                    short_label("content", 20).alias("label"),
                    F.array_join(head(words, 3), " ").alias("first_words"),
                    F.size(tail_or_all(words, 3)).alias("rest_words"))


@query("text_chunks", B.with_ctes("chat_turns") + """
SELECT session_id, turn, CAST(s // 30 AS INTEGER) AS chunk_no, substring(content, s + 1, 30) AS chunk
FROM chat_turns, unnest(generate_series(0, length(content) - 1, 30)) AS g(s)
""")
def text_chunks(spark, sf_dir):
    """every turn's whole text in 30-character chunks."""
    t = B.chat_turns(spark, sf_dir)
    return t.select("session_id", "turn", F.posexplode(chunks("content", 30)).alias("chunk_no", "chunk"))


@query("nested_defaults", B.with_ctes("traces") + """
SELECT trace_id,
       coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k,
       coalesce(json_extract_string(props, '$.source'), 'unknown') AS source,
       coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), -1) AS k_from_map,
       coalesce(TRY_CAST(json_extract_string(props, '$.z') AS INTEGER), -1) AS z_from_map
FROM traces
""")
def nested_defaults(spark, sf_dir):
    """JSON path and map lookups with defaults for missing keys."""
    t = B.traces(spark, sf_dir)
    m = F.from_json("props", "map<string,int>")
    return t.select("trace_id", json_value("props", "$.k", 0, "int").alias("k"),
                    json_value("props", "$.source", "unknown").alias("source"),
                    map_value(m, "k", -1).alias("k_from_map"),
                    map_value(m, "z", -1).alias("z_from_map"))


@query("session_history", B.with_ctes("chat_turns") + """
SELECT session_id, turn, role, content FROM chat_turns WHERE role <> 'system'
""")
def session_history(spark, sf_dir):
    """Visible history of every session in turn order."""
    return sessions.history(B.chat_turns(spark, sf_dir))


NOW = "2024-01-31 00:00:00"


@query("numbers_and_times", B.with_ctes("traces") + f"""
SELECT trace_id, epoch_us(ts) // 1000 AS at_ms, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS at_text,
       ts >= TIMESTAMP '{NOW}' - INTERVAL 1440 MINUTE AS is_recent,
       CAST(trunc(execution_time_ms * 0.8) AS BIGINT) AS truncated, round_even((trace_id % 80) / 8.0, 1) AS half_even,
       CASE WHEN trace_id % 4 = 0 THEN '-' ELSE trace_name END AS scalar_text,
       CASE trace_id % 4 WHEN 0 THEN '-' WHEN 1 THEN '-' ELSE trace_name || ', ' || status END AS list_text
FROM traces
""")
def numbers_and_times(spark, sf_dir):
    """Truncation, rounding to even, epoch milliseconds and back, ISO text, age, scalars and lists as text."""
    t = B.traces(spark, sf_dir)
    k = F.col("trace_id")
    lists = F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, F.array().cast("array<string>")).otherwise(F.array("trace_name", "status"))
    scalar = F.when(k % 4 != 0, F.col("trace_name"))
    return t.select(
        "trace_id", TX.epoch_ms("ts").alias("at_ms"), TX.iso_text("ts").alias("at_text"),
        (F.col("ts") >= TX.minutes_ago(1440, F.lit(NOW).cast("timestamp"))).alias("is_recent"),
        TX.trunc_long(F.col("execution_time_ms") * 0.8).alias("truncated"), TX.round_even((k % 80) / F.lit(8.0), 1).alias("half_even"),
        TX.list_text(scalar, kind=T.StringType()).alias("scalar_text"), TX.list_text(lists).alias("list_text"))
