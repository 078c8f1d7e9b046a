"""The fact table of the engine: one row per assistant turn."""

from __future__ import annotations

from pyspark.sql import types as T

#: Activities in list order; the earliest wins ties.
ACTIVITIES = ("thinking", "exploration", "coding", "testing", "shipping", "conversation")

TURNS = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("event_key", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("project", T.StringType()),
        T.StructField("project_raw", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("model", T.StringType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("cache_read_tokens", T.LongType()),
        T.StructField("cache_creation_tokens", T.LongType()),
        T.StructField("cache_creation_1h_tokens", T.LongType()),
        T.StructField("thinking_tokens", T.LongType()),
        T.StructField("tools", T.ArrayType(T.StringType())),
        T.StructField("tool_result_chars", T.MapType(T.StringType(), T.LongType())),
        T.StructField("has_thinking", T.BooleanType()),
        T.StructField("is_error", T.BooleanType()),
        T.StructField("is_sidechain", T.BooleanType()),
        T.StructField("git_branch", T.StringType()),
        T.StructField("activity", T.StringType()),
        T.StructField("parent_session_id", T.StringType()),
        T.StructField("agent_type", T.StringType()),
    ]
)
