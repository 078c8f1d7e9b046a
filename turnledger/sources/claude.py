"""Turns from transcripts with one JSON object a line: assistant turns, the results of their tool calls, prompts.

Lines that are no JSON, or lack what a turn needs, give nothing; a turn without a readable time is
of 1970. Tool results are linked to the latest earlier call with their id in the same file, by a
join; prompts are carried to the turns after them by a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import classify_activity, is_declination
from ..tables import stored

LINE = (
    "type string, uuid string, sessionId string, agentId string, cwd string, gitBranch string, timestamp string, isSidechain boolean, attributionSkill string, attributionAgent string, "
    "prNumber string, prRepository string, message struct<model:string, usage:struct<input_tokens:bigint, output_tokens:bigint, cache_read_input_tokens:bigint, cache_creation_input_tokens:bigint, "
    "cache_creation:struct<ephemeral_1h_input_tokens:bigint>>, content:string>"
)
BLOCKS = "array<struct<type:string, text:string, name:string, id:string, input:struct<command:string>, tool_use_id:string, is_error:boolean, content:string>>"
#: A subagent's own file: the parent session's folder, then the agent's id. Fixed value.
SUBAGENT_FILE = r"([^/]+)/subagents/(?:[^/]+/){0,5}agent-([^/]+)\.jsonl$"


def _fields(lines: DataFrame) -> DataFrame:
    d = lines.select("file", "ord", F.from_json("value", LINE).alias("d")).select("file", "ord", "d.*")
    content = F.col("message.content")
    return d.withColumn("blocks", F.when(content.startswith("["), F.from_json(content, BLOCKS)))


def parsed(lines: DataFrame) -> DataFrame:
    """file, ord, the line's fields and its content's blocks (null where the content is plain text)."""
    return _fields(lines).filter("type is not null")


def parsed_once(lines: DataFrame) -> DataFrame:
    """What parsed() gives, as a table: turns, calls and results are taken from it, and each would else parse all lines again.

    The filter comes after the table, for it would parse the lines once more. A content that has blocks is kept as these alone.
    """
    plain = F.when(F.col("blocks").isNull(), F.col("message.content"))
    return stored(_fields(lines).withColumn("message", F.col("message").withField("content", plain)), compression="zstd").filter("type is not null")


def _of(kind: str) -> Column:
    return F.filter(F.coalesce("blocks", F.from_json(F.lit("[]"), BLOCKS)), lambda b: b["type"] == kind)


def result_chars(content: Column) -> Column:
    """Characters of a result: of a text, or of its parts' texts, or else of their JSON."""
    parts = F.when(content.startswith("["), F.from_json(content, "array<string>"))
    size = F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n + F.coalesce(F.length(F.get_json_object(p, "$.text")), F.length(p), F.lit(0)))
    return F.coalesce(size, F.length(content).cast("long"), F.lit(0).cast("long"))


def result_text(content: Column) -> Column:
    """A result's text, or its parts' texts in a row."""
    parts = F.when(content.startswith("["), F.from_json(content, "array<struct<text:string>>"))
    return F.coalesce(F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), " "), content)


def assistants(p: DataFrame) -> DataFrame:
    """Lines that are turns: with usage and a key, and not all zero."""
    u = F.col("message.usage")
    n = lambda name: F.coalesce(u[name], F.lit(0).cast("long"))
    some = (n("input_tokens") + n("output_tokens") != 0) | (n("cache_read_input_tokens") != 0) | (n("cache_creation_input_tokens") != 0)
    return p.filter((F.col("type") == "assistant") & u.isNotNull() & F.col("uuid").isNotNull() & some)


def link_tool_results(p: DataFrame) -> DataFrame:
    """(file, uuid, is_error, tool_result_chars): what the results say of the turns whose tools they answer."""
    calls = assistants(p).select("file", "uuid", F.col("ord").alias("use_ord"), F.explode(_of("tool_use")).alias("b")).filter("b.id is not null and b.name is not null")
    calls = calls.select("file", F.col("b.id").alias("id"), "use_ord", F.struct("uuid", "b.name").alias("call"))
    results = p.filter("type = 'user'").select("file", "ord", F.posexplode(_of("tool_result")).alias("place", "b")).filter("b.tool_use_id is not null")
    failed = F.coalesce(F.col("b.is_error"), F.lit(False)) & ~is_declination(result_text(F.col("b.content")))
    results = results.select("file", "ord", "place", F.col("b.tool_use_id").alias("id"), failed.alias("failed"), result_chars(F.col("b.content")).alias("chars"))
    j = results.join(calls, ["file", "id"]).filter(F.col("use_ord") < F.col("ord"))
    latest = j.groupBy("file", "ord", "place").agg(F.max_by("call", "use_ord").alias("call"), F.first("failed").alias("failed"), F.first("chars").alias("chars"))
    by_tool = latest.groupBy("file", "call").agg(F.max("failed").alias("failed"), F.sum("chars").alias("chars"))
    sizes = F.filter(F.collect_list(F.struct(F.col("call.name").alias("key"), F.col("chars").alias("value"))), lambda x: x["value"] > 0)
    turns = by_tool.groupBy("file", F.col("call.uuid").alias("uuid")).agg(F.max("failed").alias("is_error"), sizes.alias("sizes"))
    return turns.select("file", "uuid", "is_error", F.when(F.size("sizes") > 0, F.map_from_entries("sizes")).alias("tool_result_chars"))


def carry_prompt(p: DataFrame) -> DataFrame:
    """p with intent_text: the last prompt with a letter or sign before the line, in its file.

    Only turns keep their message; what tools gave back is long, and is not taken through the exchange.
    """
    texts = F.array_join(F.transform(_of("text"), lambda b: b["text"]), "\n")
    said = F.trim(F.when(F.col("blocks").isNotNull(), texts).otherwise(F.col("message.content")))
    prompt = F.when((F.col("type") == "user") & (said != ""), said)
    w = Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    turn = F.col("type") == "assistant"
    lean = p.withColumns({"_prompt": prompt, "message": F.when(turn, F.col("message")), "blocks": F.when(turn, F.col("blocks"))})
    return lean.withColumn("intent_text", F.last("_prompt", True).over(w)).drop("_prompt")


def pr_links(p: DataFrame) -> DataFrame:
    """(session_id, pr_count): distinct repository and number pairs; only their count is kept."""
    key = F.concat(F.coalesce("prRepository", F.lit("")), F.lit("#"), "prNumber")
    session = F.coalesce("sessionId", F.regexp_extract("file", r"([^/]+?)(?:\.jsonl)?$", 1))
    return p.filter("type = 'pr-link' and prNumber is not null").groupBy(session.alias("session_id")).agg(F.countDistinct(key).alias("pr_count"))


def claude_turns(lines: DataFrame) -> DataFrame:
    """The turns of all lines, without a project (see project_family.session_projects), with cwd, commands, intent and response."""
    p = parsed_once(lines)
    t = assistants(carry_prompt(p)).join(link_tool_results(p), ["file", "uuid"], "left")
    u = F.col("message.usage")
    n = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    agent = F.nullif(F.regexp_extract("file", SUBAGENT_FILE, 2), F.lit(""))
    parent = F.nullif(F.regexp_extract("file", SUBAGENT_FILE, 1), F.lit(""))
    session = F.coalesce("sessionId", F.regexp_extract("file", r"([^/]+?)(?:\.jsonl)?$", 1))
    inline = F.coalesce("isSidechain", F.lit(False))
    uses = _of("tool_use")
    out = t.select(
        F.lit("claude-code").alias("source"),
        F.col("uuid").alias("event_key"),
        F.when(agent.isNotNull(), F.coalesce(F.nullif("agentId", F.lit("")), agent)).otherwise(session).alias("session_id"),
        F.coalesce(F.try_to_timestamp("timestamp"), F.timestamp_seconds(F.lit(0))).alias("ts"),
        F.coalesce("message.model", F.lit("unknown")).alias("model"),
        n(u["input_tokens"]).alias("input_tokens"),
        n(u["output_tokens"]).alias("output_tokens"),
        n(u["cache_read_input_tokens"]).alias("cache_read_tokens"),
        n(u["cache_creation_input_tokens"]).alias("cache_creation_tokens"),
        n(u["cache_creation"]["ephemeral_1h_input_tokens"]).alias("cache_creation_1h_tokens"),
        F.lit(0).cast("long").alias("thinking_tokens"),
        F.filter(F.transform(uses, lambda b: b["name"]), lambda x: x.isNotNull()).alias("tools"),
        F.filter(F.transform(uses, lambda b: b["input"]["command"]), lambda x: x.isNotNull()).alias("commands"),
        "tool_result_chars",
        (F.size(_of("thinking")) > 0).alias("has_thinking"),
        F.coalesce("is_error", F.lit(False)).alias("is_error"),
        (agent.isNotNull() | inline).alias("is_sidechain"),
        F.col("gitBranch").alias("git_branch"),
        F.when(agent.isNotNull(), parent).when(inline, session).alias("parent_session_id"),
        F.when(agent.isNotNull(), F.nullif("attributionAgent", F.lit(""))).alias("agent_type"),
        F.nullif("attributionSkill", F.lit("")).alias("skill"),
        "cwd",
        # What a parent agent writes or gets is no person's text.
        F.when(agent.isNull(), F.col("intent_text")).alias("intent_text"),
        F.when(agent.isNull(), F.nullif(F.array_join(F.transform(_of("text"), lambda b: b["text"]), "\n"), F.lit(""))).alias("response_text"),
        "file",
        "ord",
    )
    return out.withColumn("activity", classify_activity(F.col("tools"), F.col("commands"), F.col("has_thinking"), F.col("thinking_tokens")))
