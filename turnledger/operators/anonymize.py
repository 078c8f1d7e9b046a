"""Sessions that can be given away: the shape of the work stays, all names go.

A family is a conversation with its subagents' runs. What is kept are the order, the gaps, tokens,
models, built-in tools, errors and sizes of results; families, runs, servers and their tools are
numbered, servers' tools by first appearance in the family (main turns first, then run by run).
Times are shifted so that a family begins at a fixed one. No text, branch, project or path is read.

Numbers come from minima over positions and ranks over them, so a family may be of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import server_of, tool_class
from ..tables import numbered, stored
from .annotate import root_of

# Where a family's time begins, names in place of real ones, tools that classify as the class says, commands that classify as the activity says.
EPOCH = "2026-01-01 09:00:00"
PROJECT, BRANCH, FOLDER, AGENT_TYPE = "project-1", "main", "-Users-dev-project-1", "general-purpose"
STAND_INS = {"read": "read_file", "write": "write_file", "shell": "run_command", "plan": "todowrite", "interactive": "ask_user"}
COMMANDS = {"testing": "npm test", "shipping": 'git commit -m "synthetic"'}


def _choose(value: Column, names: dict[str, str], default: Column) -> Column:
    out = default
    for key, name in names.items():
        out = F.when(value == key, name).otherwise(out)
    return out


def anonymize_sessions(turns: DataFrame) -> DataFrame:
    """The turns with all names replaced: the columns of a turn, with family, run (0: the main loop) and nth (the turn's place in its run, from 0).

    A turn that is a sidechain belongs to the run of its session_id, all others to their family's main loop.
    """
    order = F.struct("ts", "event_key")
    t = turns.withColumns({"root": root_of(), "_run": F.when(F.col("is_sidechain"), F.col("session_id"))})
    families = t.groupBy("root").agg(F.min("ts").alias("_start"))
    families = stored(numbered(families, [F.asc("_start"), F.asc("root")], "family"))
    runs = t.filter("_run is not null").groupBy("root", "_run").agg(F.min(order).alias("_first"))
    runs = runs.select("root", "_run", F.row_number().over(Window.partitionBy("root").orderBy("_first", "_run")).alias("run"))
    main = t.filter("_run is null").withColumn("run", F.lit(0))
    # Families are joined by root below: the places of turns need no exchange of their own.
    t = main.unionByName(t.join(runs, ["root", "_run"])).drop("_run").repartition("root")
    t = t.withColumn("nth", F.row_number().over(Window.partitionBy("root", "run").orderBy("ts", "event_key")) - 1)
    t = stored(t.join(families, "root"))
    # First appearance of each tool and server: run, place in the run, place among the turn's tools.
    used = t.select("root", "run", "nth", F.posexplode("tools").alias("pos", "tool")).withColumn("server", server_of(F.col("tool"))).filter("server is not null")
    seen = used.groupBy("root", "server", "tool").agg(F.min(F.struct("run", "nth", "pos")).alias("first"))
    by_server = seen.withColumn("server_first", F.min("first").over(Window.partitionBy("root", "server")))
    nth_server = F.dense_rank().over(Window.partitionBy("root").orderBy("server_first"))
    nth_tool = F.dense_rank().over(Window.partitionBy("root").orderBy("first"))
    alias = F.concat(F.lit("mcp__server-"), nth_server, F.lit("__"), _choose(tool_class(F.col("tool")), STAND_INS, F.concat(F.lit("tool-"), nth_tool)))
    names = by_server.select("root", "tool", alias.alias("alias"))
    # A map of the names of a family's server tools, not of its turns.
    maps = names.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("tool", "alias"))).alias("names"))
    t = t.join(maps, "root", "left")
    renamed = lambda tool: F.coalesce(F.try_element_at("names", tool), tool)
    start = F.lit(EPOCH).cast("timestamp")
    session = F.concat(F.lit("session-"), "family")
    agent = F.concat("family", F.lit("-"), "run")
    entries = F.transform(F.map_entries("tool_result_chars"), lambda e: F.struct(renamed(e["key"]).alias("key"), e["value"].alias("value")))
    # Tools with one stand-in are one.
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    sizes = F.map_from_arrays(keys, F.transform(keys, lambda k: F.aggregate(F.filter(entries, lambda e: e["key"] == k), F.lit(0).cast("long"), lambda n, e: n + e["value"])))
    is_run = F.col("run") > 0
    return t.select(
        F.lit("claude-code").alias("source"),
        F.concat(F.when(is_run, agent).otherwise(session), F.lit("-t"), "nth").alias("event_key"),
        F.when(is_run, agent).otherwise(session).alias("session_id"),
        F.lit(PROJECT).alias("project"),
        F.lit(None).cast("string").alias("project_raw"),
        (F.col("ts") + (start - F.col("_start"))).alias("ts"),
        "model",
        "input_tokens",
        "output_tokens",
        "cache_read_tokens",
        "cache_creation_tokens",
        "cache_creation_1h_tokens",
        "thinking_tokens",
        F.transform("tools", renamed).alias("tools"),
        F.when(F.col("tool_result_chars").isNotNull(), sizes).alias("tool_result_chars"),
        "has_thinking",
        "is_error",
        "is_sidechain",
        F.lit(BRANCH).alias("git_branch"),
        "activity",
        F.when(is_run, session).alias("parent_session_id"),
        F.when(is_run & F.col("agent_type").isNotNull(), F.lit(AGENT_TYPE)).alias("agent_type"),
        "family",
        "run",
        "nth",
    )


def anonymized_lines(turns: DataFrame) -> DataFrame:
    """(file, ord, value): anonymised turns as lines of transcripts; a run has a file of its own.

    Results are filler of the recorded length; a turn that failed says so in its first result.
    """
    session = F.concat(F.lit("session-"), "family")
    run = F.concat("family", F.lit("-"), "run")
    is_run = F.col("run") > 0
    file = F.concat(F.lit(f"{FOLDER}/"), session, F.when(is_run, F.concat(F.lit("/subagents/agent-"), run)).otherwise(F.lit("")), F.lit(".jsonl"))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    lit = lambda x, name: F.lit(x).alias(name)
    text = lambda *c: F.to_json(F.struct(*c))
    none, tools = F.array().cast("array<string>"), F.coalesce("tools", F.array().cast("array<string>"))
    call = lambda i: F.concat("event_key", F.lit("-c"), i)
    command = _choose(F.col("activity"), COMMANDS, F.lit(None).cast("string"))
    blocks = F.concat(
        F.when(F.col("has_thinking") | (F.col("thinking_tokens") > 0), F.array(F.lit('{"type":"thinking","thinking":"synthetic"}'))).otherwise(none),
        F.when(F.size(tools) == 0, F.array(F.lit('{"type":"text","text":"synthetic"}'))).otherwise(none),
        F.transform(tools, lambda x, i: text(lit("tool_use", "type"), call(i).alias("id"), x.alias("name"), F.struct(F.when(i == 0, command).alias("command")).alias("input"))),
    )
    five = F.greatest(F.lit(0), F.col("cache_creation_tokens") - F.col("cache_creation_1h_tokens"))
    cache = F.when(F.col("cache_creation_1h_tokens") > 0, F.struct(five.alias("ephemeral_5m_input_tokens"), F.col("cache_creation_1h_tokens").alias("ephemeral_1h_input_tokens")))
    usage = text("input_tokens", "output_tokens", F.col("cache_read_tokens").alias("cache_read_input_tokens"), F.col("cache_creation_tokens").alias("cache_creation_input_tokens"), cache.alias("cache_creation"))
    head = text(lit("assistant", "type"), F.col("event_key").alias("uuid"), session.alias("sessionId"), F.when(is_run, run).alias("agentId"), F.when(is_run, F.lit(True)).alias("isSidechain"), F.col("agent_type").alias("attributionAgent"),
        lit(f"/Users/dev/{PROJECT}", "cwd"), lit(BRANCH, "gitBranch"), stamp.alias("timestamp"))
    body = F.concat(F.lit(',"message":{"model":'), F.regexp_extract(text("model"), r'^\{"model":(.*)\}$', 1), F.lit(',"usage":'), usage, F.lit(',"content":['), F.array_join(blocks, ","), F.lit("]}}"))
    said = turns.select(file.alias("file"), (F.col("nth") * 2).alias("ord"), F.concat(F.substring(head, F.lit(1), F.length(head) - 1), body).alias("value"))
    chars = lambda x: F.coalesce(F.try_element_at("tool_result_chars", x), F.lit(0).cast("long"))
    # A tool that a turn calls twice has its size once.
    size = lambda x, i: F.when(F.array_position(tools, x) == i + 1, chars(x)).otherwise(0)
    failed = lambda i: F.coalesce(F.col("is_error"), F.lit(False)) & (i == 0)
    results = F.transform(tools, lambda x, i: F.when((size(x, i) > 0) | failed(i), text(lit("tool_result", "type"), call(i).alias("tool_use_id"), F.when(failed(i), F.lit(True)).alias("is_error"), F.repeat(F.lit("x"), size(x, i).cast("int")).alias("content"))))
    results = F.filter(results, lambda r: r.isNotNull())
    about = text(lit("user", "type"), F.concat("event_key", F.lit("-r")).alias("uuid"), session.alias("sessionId"), stamp.alias("timestamp"))
    back = turns.select(file.alias("file"), (F.col("nth") * 2 + 1).alias("ord"), F.concat(F.substring(about, F.lit(1), F.length(about) - 1), F.lit(',"message":{"content":['), F.array_join(results, ","), F.lit("]}}")).alias("value"), F.size(results).alias("n"))
    return said.unionByName(back.filter("n > 0").drop("n"))
