"""Turns from tables exported from agents' own databases (cursor, antigravity)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import classify_activity
from .chats import SHELL_TOOL

COMPOSER = "lastUpdatedAt bigint, modelConfig struct<modelName:string>, fullConversationHeadersOnly array<struct<bubbleId:string>>"
BUBBLE = "type int, createdAt string, text string, tokenCount struct<inputTokens:bigint, outputTokens:bigint>, toolFormerData struct<name:string, status:string, rawArgs:string>, modelInfo struct<modelName:string>"
#: Tools by step type, and the types that are no tools. Fixed values.
STEP_TOOLS = {8: "view_file", 9: "list_directory", 21: "run_command", 23: "update_plan"}
NO_TOOL_STEPS = (14, 15, 98)


def cursor_turns(items: DataFrame, projects: DataFrame) -> DataFrame:
    """items: (key, value), of which only conversations and their bubbles are read; projects: (composer, project).

    A bubble with tokens is a turn; tools and errors since the one before are its own. Bubbles
    come in the order of the conversation's headers, or by id where it has none.
    """
    key = F.split("key", ":")
    items = items.filter("(key like 'composerData:%' or key like 'bubbleId:%') and value is not null")
    chats = items.filter("key like 'composerData:%'").select(F.substring("key", len("composerData:") + 1, 1 << 20).alias("composer"), F.from_json("value", COMPOSER).alias("c"))
    bubbles = items.filter("key like 'bubbleId:%'").select(F.get(key, F.lit(1)).alias("composer"), F.get(key, F.lit(2)).alias("bubble"), F.from_json("value", BUBBLE).alias("b")).filter("composer <> '' and bubble <> ''")
    headers = F.col("c.fullConversationHeadersOnly")
    listed = chats.select("composer", F.col("c.lastUpdatedAt").alias("updated"), F.col("c.modelConfig.modelName").alias("chat_model"), headers.alias("headers"))
    head = listed.filter(F.size("headers") > 0).select("composer", "updated", "chat_model", F.posexplode("headers").alias("ord", "h"))
    head = head.select("composer", "updated", "chat_model", "ord", F.col("h.bubbleId").alias("bubble"))
    ordered = head.join(bubbles, ["composer", "bubble"])
    plain = listed.filter(F.coalesce(F.size("headers"), F.lit(0)) <= 0).drop("headers").join(bubbles, "composer").withColumn("ord", F.lit(0))
    b, by = F.col("b"), ("ord", "bubble")
    tool, n = b["toolFormerData"], lambda name: F.coalesce(b["tokenCount"][name], F.lit(0).cast("long"))
    before = Window.partitionBy("composer").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("composer").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    tick = (n("inputTokens") != 0) | (n("outputTokens") != 0)
    said = F.when((b["type"] == 1) & (F.trim(b["text"]) != ""), F.trim(b["text"]))
    d = ordered.unionByName(plain).withColumns(
        {
            "tick": tick,
            "turn": F.coalesce(F.count(F.when(tick, 1)).over(earlier), F.lit(0)),
            "intent_text": F.last(said, True).over(before),
            "tool": F.nullif(tool["name"], F.lit("")),
            "command": F.when(tool["name"].rlike(SHELL_TOOL), F.get_json_object(tool["rawArgs"], "$.command")),
            "failed": (F.coalesce(tool["name"], F.lit("")) != "") & F.coalesce(tool["status"].isin("error", "failed"), F.lit(False)),
        }
    )
    place = F.struct(*by)
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(*by, F.col(c).alias("x"))))), lambda s: s["x"])
    own = F.struct("bubble", "b", "updated", "chat_model", "intent_text")
    turns = d.groupBy("composer", "turn").agg(in_order("tool").alias("tools"), in_order("command").alias("commands"), F.max("failed").alias("is_error"), F.max_by(own, F.when(F.col("tick"), place)).alias("own"), F.max("tick").alias("tick"))
    t = turns.filter("tick").select("composer", "tools", "commands", "is_error", "own.*")
    model = F.nullif(F.coalesce(b["modelInfo"]["modelName"], "chat_model"), F.lit(""))
    known = projects.groupBy("composer").agg(F.min("project").alias("project"))
    out = t.join(known, "composer", "left").select(
        F.lit("cursor").alias("source"),
        F.concat("composer", F.lit(":"), "bubble").alias("event_key"),
        F.col("composer").alias("session_id"),
        F.coalesce("project", F.lit("unknown")).alias("project"),
        F.coalesce(F.try_to_timestamp(b["createdAt"]), F.timestamp_millis(F.coalesce("updated", F.lit(0).cast("long")))).alias("ts"),
        F.when(model.isNull() | (model == "default"), "cursor-auto").otherwise(model).alias("model"),
        n("inputTokens").alias("input_tokens"),
        n("outputTokens").alias("output_tokens"),
        *(F.lit(0).cast("long").alias(c) for c in ("cache_read_tokens", "cache_creation_tokens", "thinking_tokens")),
        "tools",
        "commands",
        F.lit(False).alias("has_thinking"),
        "is_error",
        "intent_text",
    )
    return out.withColumn("activity", classify_activity(F.col("tools"), F.col("commands"), F.col("has_thinking"), F.col("thinking_tokens")))


def antigravity_turns(generations: DataFrame, steps: DataFrame) -> DataFrame:
    """generations: (conversation, idx, last_step, ts, model, project, git_branch, input_tokens, output_tokens, cache_read_tokens); steps: (conversation, idx, step_type, status, command, error).

    A generation owns the steps after its last_step up to that of the next one; last_step only
    grows within a conversation. So one ordering of both finds the owner, without a range join.
    Generations without tokens bound steps, but are no turns. What a user cancels is no error.
    """
    g = generations.select("conversation", F.col("last_step").alias("place"), F.lit(1).alias("kind"), F.col("idx").alias("nth"), F.col("idx").alias("gen"))
    s = steps.select("conversation", F.col("idx").alias("place"), F.lit(0).alias("kind"), F.col("idx").alias("nth"), F.lit(None).cast(dict(g.dtypes)["gen"]).alias("gen"), "step_type", "status", "command", "error")
    # A step at the next generation's last_step still belongs to the one before.
    before = Window.partitionBy("conversation").orderBy("place", "kind", "nth").rowsBetween(Window.unboundedPreceding, 0)
    owned = g.unionByName(s, True).withColumn("idx", F.last("gen", True).over(before)).filter("kind = 0 and idx is not null").filter(~F.col("step_type").isin(*NO_TOOL_STEPS))
    names = F.create_map(*(F.lit(x) for pair in STEP_TOOLS.items() for x in pair))
    name = F.coalesce(F.try_element_at(names, F.col("step_type").cast("int")), F.concat(F.lit("step_"), "step_type"))
    failed = (F.col("status") == 7) & ~F.coalesce(F.col("error").rlike("(?i)cancel"), F.lit(False))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("place", F.col(c).alias("x"))))), lambda p: p["x"])
    did = owned.withColumns({"tool": name, "failed": F.coalesce(failed, F.lit(False)), "command": F.nullif("command", F.lit(""))}).groupBy("conversation", "idx").agg(in_order("tool").alias("tools"), in_order("command").alias("commands"), F.max("failed").alias("is_error"))
    none, n = F.array().cast("array<string>"), lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    turns = generations.filter("coalesce(input_tokens, output_tokens, cache_read_tokens) is not null").join(did, ["conversation", "idx"], "left")
    out = turns.select(
        F.lit("antigravity").alias("source"),
        F.concat("conversation", F.lit(":"), "idx").alias("event_key"),
        F.col("conversation").alias("session_id"),
        F.coalesce("project", F.lit("unknown")).alias("project"),
        F.coalesce("ts", F.timestamp_millis(F.lit(0))).alias("ts"),
        F.coalesce("model", F.lit("antigravity")).alias("model"),
        n("input_tokens"),
        n("output_tokens"),
        n("cache_read_tokens"),
        *(F.lit(0).cast("long").alias(c) for c in ("cache_creation_tokens", "thinking_tokens")),
        F.coalesce("tools", none).alias("tools"),
        F.coalesce("commands", none).alias("commands"),
        F.lit(False).alias("has_thinking"),
        F.coalesce("is_error", F.lit(False)).alias("is_error"),
        "git_branch",
    )
    return out.withColumn("activity", classify_activity(F.col("tools"), F.col("commands"), F.col("has_thinking"), F.col("thinking_tokens")))
