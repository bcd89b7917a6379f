"""Explicit schemas for the data model (never inferred from rows, see T1)."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
TS, DT = T.TimestampType(), T.DateType()


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


def _arr(dtype):
    return T.ArrayType(dtype, True)


CUSTOMERS = T.StructType([
    _f("customer_id", S, False), _f("name", S, False), _f("age", I),
    _f("gender", S), _f("occupation", S), _f("address", S),
    _f("family_structure", S), _f("current_vehicle", S), _f("preferences", S),
    _f("background", S), _f("budget_min", I), _f("budget_max", I),
    _f("created_at", TS),
])

VEHICLES = T.StructType([
    _f("vehicle_id", S, False), _f("make", S), _f("model", S), _f("year", I),
    _f("price", I), _f("mileage", I), _f("body_type", S), _f("fuel_type", S),
    _f("seating_capacity", I), _f("features", _arr(S)), _f("stock_status", S),
    _f("color", S), _f("description", S), _f("image_path", S),
    _f("created_at", TS),
])

INTERACTIONS = T.StructType([
    _f("interaction_id", S, False), _f("customer_id", S), _f("interaction_type", S),
    _f("sales_rep", S), _f("transcript", S), _f("interaction_date", DT),
    _f("duration_minutes", I), _f("created_at", TS),
])

RECOMMENDATION_ITEM = T.StructType([
    _f("vehicle_id", S), _f("match_score", I), _f("reason", S),
])

RECOMMENDATIONS = T.StructType([
    _f("recommendation_id", S, False), _f("customer_id", S),
    _f("recommendations_json", S), _f("talk_script", S),
    _f("generated_at", TS), _f("model_used", S),
])

INSIGHT = T.StructType([
    _f("needs", _arr(S)), _f("priorities", _arr(S)), _f("avoid", _arr(S)),
    _f("purchase_intent", S), _f("key_insight", S), _f("detected_keywords", _arr(S)),
])

PERSONA = T.StructType([
    _f("life_stage", S), _f("values", S), _f("personality", S),
    _f("lifestyle", S), _f("decision_style", S),
])
DEEP_NEEDS = T.StructType([
    _f("unstated_needs", _arr(S)), _f("emotional_drivers", _arr(S)),
    _f("concerns", _arr(S)), _f("family_considerations", _arr(S)),
    _f("lifestyle_needs", _arr(S)),
])
CUSTOMER_INSIGHT = T.StructType([
    _f("customer_persona", PERSONA), _f("deep_needs", DEEP_NEEDS),
    _f("key_quotes", _arr(S)),
])

NEEDS = T.StructType([
    _f("body_type", S), _f("budget_min", L), _f("budget_max", L),
    _f("family_size", I), _f("primary_use", S), _f("must_have_features", _arr(S)),
    _f("preferred_brands", _arr(S)), _f("deal_breakers", _arr(S)),
])

USAGE = T.StructType([
    _f("prompt_tokens", I), _f("completion_tokens", I), _f("total_tokens", I),
])
MESSAGE = T.StructType([_f("role", S), _f("content", S)])
TRACES = T.StructType([
    _f("trace_id", S, False), _f("request_id", S), _f("status", S),
    _f("timestamp_ms", L), _f("execution_time_ms", L),
    _f("request", T.StructType([
        _f("messages", _arr(MESSAGE)), _f("model", S),
        _f("max_tokens", I), _f("temperature", D),
    ])),
    _f("response", T.StructType([_f("usage", USAGE)])),
    _f("tags", T.MapType(S, S)),
    _f("error", T.StructType([_f("error_code", S), _f("message", S)])),
])

EVALUATIONS = T.StructType([
    _f("evaluation_id", S, False), _f("trace_id", S), _f("timestamp", TS),
    _f("input_preview", S), _f("output_preview", S), _f("rating", I),
    _f("feedback", S), _f("evaluator", S),
    _f("metrics", T.StructType([
        _f("relevance", I), _f("faithfulness", I), _f("helpfulness", I),
    ])),
    _f("ground_truth", S),
])

CHAT_TURNS = T.StructType([
    _f("session_id", S, False), _f("turn", L, False), _f("role", S), _f("content", S),
])

CONTENT = _arr(T.StructType([_f("type", S), _f("text", S)]))
AGENT_OUTPUT = _arr(T.StructType([_f("type", S), _f("role", S), _f("content", CONTENT)]))
AGENT_RESPONSE = T.StructType([
    _f("output", AGENT_OUTPUT),
    _f("choices", _arr(T.StructType([_f("message", T.StructType([_f("content", S)]))]))),
])
