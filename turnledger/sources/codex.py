"""Turns from rollout logs whose token counters only ever grow.

A turn is a tick of the counters, differenced from the tick before in its file; tools and
commands called since then are its own. Lines that are no JSON give nothing; a tick without a
readable time is of 1970.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import classify_activity

_USAGE = "struct<input_tokens:bigint, cached_input_tokens:bigint, output_tokens:bigint, reasoning_output_tokens:bigint>"
LINE = f"type string, timestamp string, payload struct<type:string, id:string, cwd:string, model:string, role:string, content:string, name:string, arguments:string, info:struct<total_token_usage:{_USAGE}, last_token_usage:{_USAGE}>>"


def codex_turns(lines: DataFrame) -> DataFrame:
    d = lines.select("file", "ord", F.from_json("value", LINE).alias("d")).filter("d.payload is not null").select("file", "ord", "d.type", "d.timestamp", "d.payload")
    p, item = F.col("payload"), F.col("type") == "response_item"
    meta = (F.col("type") == "session_meta") | (p["type"] == "session_meta")
    total = F.coalesce(p["info"]["total_token_usage"], p["info"]["last_token_usage"])
    tick = (F.col("type") == "event_msg") & (p["type"] == "token_count") & total.isNotNull()
    call = item & (p["type"] == "function_call") & p["name"].isNotNull()
    said = F.when(p["content"].startswith("["), F.array_join(F.transform(F.from_json(p["content"], "array<struct<text:string>>"), lambda b: b["text"]), "\n")).otherwise(p["content"])
    command = F.get_json_object(p["arguments"], "$.command")
    command = F.when(command.startswith("["), F.array_join(F.from_json(command, "array<string>"), " ")).otherwise(command)
    before = Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns(
        {
            "tick": F.coalesce(tick, F.lit(False)),
            "session": F.last(F.when(meta, p["id"]), True).over(before),
            "cwd": F.last(F.when(meta, p["cwd"]), True).over(before),
            "model": F.last(F.when(p["type"] == "turn_context", p["model"]), True).over(before),
            "intent_text": F.last(F.when(item & (p["type"] == "message") & (p["role"] == "user") & (F.trim(said) != ""), F.trim(said)), True).over(before),
            "tool": F.when(call, p["name"]),
            "command": F.when(call & p["name"].rlike("shell|exec"), command),
            "total": total,
        }
    )
    # A line belongs to the next tick: the number of ticks before it.
    earlier = Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("turn", F.coalesce(F.count(F.when(F.col("tick"), 1)).over(earlier), F.lit(0)))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("ord", F.col(c).alias("x"))))), lambda s: s["x"])
    own = {c: F.max_by(c, F.when(F.col("tick"), F.col("ord"))).alias(c) for c in ("session", "cwd", "model", "intent_text", "timestamp", "total")}
    turns = d.groupBy("file", "turn").agg(ordered("tool").alias("tools"), ordered("command").alias("commands"), F.max("tick").alias("tick"), *own.values()).filter("tick")
    last = Window.partitionBy("file").orderBy("turn")
    n = lambda name: F.coalesce(F.col("total")[name], F.lit(0).cast("long"))
    grown = lambda name: F.greatest(F.lit(0), n(name) - F.coalesce(F.lag(n(name)).over(last), F.lit(0)))
    turns = turns.withColumns({"d_in": grown("input_tokens"), "d_cached": grown("cached_input_tokens"), "d_out": grown("output_tokens"), "d_think": grown("reasoning_output_tokens")})
    session = F.coalesce("session", F.regexp_extract("file", r"([^/]+?)(?:\.jsonl)?$", 1))
    out = turns.select(
        F.lit("codex").alias("source"),
        F.concat(session, F.lit(":"), F.col("turn") + 1).alias("event_key"),
        session.alias("session_id"),
        F.regexp_extract("cwd", r"([^/]+)/*$", 1).alias("project"),
        F.coalesce(F.try_to_timestamp("timestamp"), F.timestamp_seconds(F.lit(0))).alias("ts"),
        F.coalesce("model", F.lit("unknown")).alias("model"),
        # The vendor counts cached tokens inside the input; a counter that goes back may leave less than nothing.
        (F.col("d_in") - F.col("d_cached")).alias("input_tokens"),
        F.col("d_out").alias("output_tokens"),
        F.col("d_cached").alias("cache_read_tokens"),
        F.lit(0).cast("long").alias("cache_creation_tokens"),
        F.col("d_think").alias("thinking_tokens"),
        "tools",
        "commands",
        (F.col("d_think") > 0).alias("has_thinking"),
        F.lit(False).alias("is_error"),
        "intent_text",
    )
    return out.withColumn("activity", classify_activity(F.col("tools"), F.col("commands"), F.col("has_thinking"), F.col("thinking_tokens")))
