"""Turns from chats stored as one JSON document each (gemini-cli, copilot).

Documents that are no JSON give nothing. A chat is one row, so its messages are exploded from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.classify import classify_activity
from .lines import read_lines

GEMINI = (
    "sessionId string, messages array<struct<type:string, id:string, timestamp:string, model:string, content:string, tokens:struct<input:bigint, output:bigint, tool:bigint, cached:bigint, thoughts:bigint>, "
    "thoughts:array<string>, toolCalls:array<struct<name:string, status:string, args:struct<command:string>>>>>"
)
COPILOT = (
    "struct<sessionId:string, creationDate:bigint, lastMessageDate:bigint, requests:array<struct<requestId:string, timestamp:bigint, modelId:string, isCanceled:boolean, message:struct<text:string>, "
    "result:struct<errorDetails:string>, response:array<string>>>>"
)
PART = "kind string, value string, content struct<value:string>, toolId string, toolName string, invocationMessage string"
#: A part's kinds that are tool calls, and tools whose message is a command. Fixed values.
TOOL_KINDS = ("toolInvocationSerialized", "toolInvocation")
SHELL_TOOL = r"(?i)terminal|shell|command"


def read_chats(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): each .json file whole, and of each .jsonl file the first line."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    first = read_lines(spark, path).filter(F.col("file").endswith(".jsonl") & (F.col("ord.block") == 0))
    first = first.groupBy("file").agg(F.min_by("value", "ord").alias("value"))
    return whole.select(F.col("_metadata.file_path").alias("file"), "value").unionByName(first)


def folder_name(uri: Column) -> Column:
    """The last folder of a file URI; null where it can't be decoded."""
    plain = F.try_url_decode(F.replace(F.regexp_replace(uri, "^file://", ""), F.lit("+"), F.lit("%2B")))
    return F.regexp_extract(plain, r"([^/]+)/*$", 1)


def _names(calls: Column, default: str) -> Column:
    return F.coalesce(F.transform(calls, lambda c: F.coalesce(c["name"], F.lit(default))), F.array().cast("array<string>"))


def gemini_turns(chats: DataFrame, hashes: DataFrame) -> DataFrame:
    """chats: (file, value); hashes: (hash, project). Messages with an id and tokens; an unknown hash is cut to 12 signs."""
    d = chats.select("file", F.from_json("value", GEMINI).alias("d")).select("file", "d.sessionId", F.posexplode("d.messages").alias("ord", "m"))
    m = F.col("m")
    parts = F.from_json(m["content"], "array<struct<text:string>>")
    said = F.when(m["content"].startswith("["), F.array_join(F.transform(parts, lambda p: p["text"]), " ")).otherwise(m["content"])
    prompt = F.when((m["type"] == "user") & (F.trim(said) != ""), F.trim(said))
    before = Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("intent_text", F.last(prompt, True).over(before)).filter(F.coalesce(m["type"] != "user", F.lit(True)) & m["tokens"].isNotNull() & (m["id"] != ""))
    folder = F.regexp_extract("file", r"([^/]+)/chats/[^/]+$", 1)
    session = F.coalesce("sessionId", F.regexp_extract("file", r"([^/]+)$", 1))
    calls, n = m["toolCalls"], lambda name: F.coalesce(m["tokens"][name], F.lit(0).cast("long"))
    known = hashes.groupBy(F.col("hash").alias("folder")).agg(F.min("project").alias("known"))
    t = d.withColumn("folder", folder).join(known, "folder", "left")
    out = t.select(
        F.lit("gemini-cli").alias("source"),
        F.concat(session, F.lit(":"), m["id"]).alias("event_key"),
        session.alias("session_id"),
        F.coalesce("known", F.when(F.col("folder").rlike("^[0-9a-f]{40,}$"), F.substring("folder", 1, 12)).otherwise(F.col("folder"))).alias("project"),
        F.coalesce(F.try_to_timestamp(m["timestamp"]), F.timestamp_millis(F.lit(0))).alias("ts"),
        F.coalesce(m["model"], F.lit("gemini")).alias("model"),
        n("input").alias("input_tokens"),
        (n("output") + n("tool")).alias("output_tokens"),
        n("cached").alias("cache_read_tokens"),
        F.lit(0).cast("long").alias("cache_creation_tokens"),
        n("thoughts").alias("thinking_tokens"),
        _names(calls, "unknown").alias("tools"),
        F.filter(F.transform(calls, lambda c: c["args"]["command"]), lambda x: x.isNotNull()).alias("commands"),
        F.coalesce(F.size(m["thoughts"]) > 0, F.lit(False)).alias("has_thinking"),
        F.coalesce(F.exists(calls, lambda c: F.coalesce(c["status"].isin("error", "failed"), F.lit(False))), F.lit(False)).alias("is_error"),
        "intent_text",
    )
    return out.withColumn("activity", classify_activity(F.col("tools"), F.col("commands"), F.col("has_thinking"), F.col("thinking_tokens")))


def copilot_turns(chats: DataFrame, workspaces: DataFrame) -> DataFrame:
    """chats: (file, value); workspaces: (workspace, folder URI). Tokens are estimated from texts, and the model says so.

    A .jsonl file counts only where it starts with a snapshot. Requests without any text give nothing.
    """
    snapshot = F.from_json("value", f"kind int, v {COPILOT}")
    chat = F.when(F.col("file").endswith(".jsonl"), F.when(snapshot["kind"] == 0, snapshot["v"])).otherwise(F.from_json("value", COPILOT))
    d = chats.select("file", chat.alias("d")).select("file", "d.sessionId", "d.creationDate", "d.lastMessageDate", F.posexplode("d.requests").alias("ord", "r"))
    r = F.col("r")

    def part(p: Column) -> Column:
        x, inner = F.from_json(p, PART), F.from_json(p, "value struct<value:string>, invocationMessage struct<value:string>")
        name = F.when(x["kind"].isin(*TOOL_KINDS), F.coalesce(x["toolId"], x["toolName"], F.lit("tool")))
        value = F.when(inner["value"].isNotNull(), inner["value"]["value"]).otherwise(x["value"])
        said = F.when(inner["invocationMessage"].isNotNull(), inner["invocationMessage"]["value"]).otherwise(x["invocationMessage"])
        command = F.when(name.rlike(SHELL_TOOL), F.replace(said, F.lit("`"), F.lit("")))
        return F.struct(F.concat(F.coalesce(value, F.lit("")), F.coalesce(x["content"]["value"], F.lit(""))).alias("text"), name.alias("tool"), command.alias("command"))

    parts = F.transform(F.coalesce(r["response"], F.array().cast("array<string>")), part)
    d = d.withColumns({"parts": parts, "asked": F.coalesce(r["message"]["text"], F.lit(""))})
    some = lambda name: F.filter(F.transform("parts", lambda p: p[name]), lambda x: x.isNotNull())
    d = d.withColumns({"answered": F.array_join(some("text"), ""), "tools": some("tool"), "commands": some("command")}).filter("asked <> '' or answered <> ''")
    session = F.coalesce("sessionId", F.regexp_extract("file", r"([^/]+?)\.jsonl?$", 1))
    known = workspaces.groupBy("workspace").agg(F.min(folder_name(F.col("folder"))).alias("known"))
    t = d.withColumn("workspace", F.regexp_extract("file", r"([^/]+)/chatSessions/[^/]+$", 1)).join(known, "workspace", "left")
    tokens = lambda c: F.ceil(F.length(c) / 4).cast("long")
    zero = F.lit(0).cast("long")
    out = t.select(
        F.lit("copilot").alias("source"),
        F.concat(session, F.lit(":"), F.coalesce(r["requestId"], F.col("ord").cast("string"))).alias("event_key"),
        session.alias("session_id"),
        F.coalesce("known", F.lit("unknown")).alias("project"),
        F.timestamp_millis(F.coalesce(r["timestamp"], "lastMessageDate", "creationDate", zero)).alias("ts"),
        F.concat(F.coalesce(r["modelId"], F.lit("copilot")), F.lit(" (est)")).alias("model"),
        tokens("asked").alias("input_tokens"),
        tokens("answered").alias("output_tokens"),
        *(zero.alias(c) for c in ("cache_read_tokens", "cache_creation_tokens", "thinking_tokens")),
        "tools",
        "commands",
        F.lit(False).alias("has_thinking"),
        # Who cancels a request did not fail.
        (r["result"]["errorDetails"].isNotNull() & ~F.coalesce(r["isCanceled"], F.lit(False))).alias("is_error"),
        F.nullif("asked", F.lit("")).alias("intent_text"),
    )
    return out.withColumn("activity", classify_activity(F.col("tools"), F.col("commands"), F.col("has_thinking"), F.col("thinking_tokens")))
