"""Queries of further log formats: each renders ``events`` in the format and parses it again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import chats as H
from ..sources import stores as D
from ..tables import stored
from .core import rounded
from .mapping import sql, turns

QUERIES: dict = {}
ORACLE_SQL: dict = {}
EV = ", ev AS (SELECT t.*, output_tokens // 20 AS k, e.et FROM t JOIN e ON e.event_id = t.event_id)"
#: These formats keep no thinking: such turns with no tool are conversation.
UNTHOUGHT = "CASE WHEN activity = 'thinking' AND et NOT IN ('view', 'click', 'error', 'purchase') AND k % 2 <> 0 THEN 'conversation' ELSE activity END AS activity"
PROMPT = "'prompt ' || max(CASE WHEN k % 3 = 0 THEN event_id END) OVER (PARTITION BY session_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def add(name: str, query, oracle: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(query(turns(spark, sf_dir, True).withColumn("k", F.floor(F.col("output_tokens") / 20)).withColumn("at", F.col("event_key").cast("long"))))
    ORACLE_SQL[name] = sql(EV + oracle)


def tool_list(t: DataFrame, *columns: str) -> DataFrame:
    return t.select(*columns, F.array_join("tools", ",").alias("tools"))


def _lit(value, name: str) -> Column:
    return F.lit(value).alias(name)


def by_session(rows: DataFrame, *keys: str) -> DataFrame:
    """keys and items: the column x of all rows of a session, in the order of at."""
    return rows.groupBy("session_id", *keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("items"))


def gemini_chats(t: DataFrame) -> DataFrame:
    calls = F.transform("tools", lambda x, i: F.struct(x.alias("name"), F.when(F.col("is_error"), F.when(F.col("k") % 4 == 0, "error").otherwise("failed")).otherwise("success").alias("status"), F.struct(F.get("commands", i).alias("command")).alias("args")))
    tokens = F.struct(F.col("input_tokens").alias("input"), F.col("output_tokens").alias("output"), F.col("k").alias("tool"), F.col("cache_read_tokens").alias("cached"), F.col("thinking_tokens").alias("thoughts"))
    turn = F.struct(_lit("gemini", "type"), F.col("event_key").alias("id"), F.date_format("ts", TIME).alias("timestamp"), "model", tokens.alias("tokens"), F.when(F.col("has_thinking"), F.array(F.lit("so"))).alias("thoughts"), calls.alias("toolCalls"))
    part = F.to_json(F.struct(F.concat(F.lit("prompt "), "event_key").alias("text")))
    # Parts or a plain text, as versions of the format have it.
    asked = F.concat(F.lit('{"type":"user","content":'), F.when(F.col("k") % 2 == 0, F.concat(F.lit("["), part, F.lit("]"))).otherwise(F.concat(F.lit('" prompt '), "event_key", F.lit(' "'))), F.lit("}"))
    x = F.array_join(F.array(F.when(F.col("k") % 3 == 0, asked), F.to_json(turn)), ",")
    folder = F.when(F.col("user_id") % 3 == 0, F.sha2("project", 256)).otherwise(F.col("project"))
    docs = by_session(t.select("session_id", "at", folder.alias("folder"), x.alias("x")), "folder")
    value = F.concat(F.lit('{"sessionId":"'), "session_id", F.lit('","messages":['), F.array_join("items", ","), F.lit("]}"))
    return stored(docs.select(F.concat(F.lit("/tmp/"), "folder", F.lit("/chats/"), "session_id", F.lit(".json")).alias("file"), value.alias("value")))


def gemini(t: DataFrame) -> DataFrame:
    known = t.filter("user_id % 2 = 0").select(F.sha2("project", 256).alias("hash"), "project").distinct()
    return tool_list(H.gemini_turns(gemini_chats(t), known), "event_key", "session_id", "project", "ts", "model", "input_tokens", "output_tokens", "cache_read_tokens", "thinking_tokens", "has_thinking", "is_error", "activity", "intent_text")


add(
    "ingest_gemini_turns",
    gemini,
    f""", known AS (SELECT DISTINCT project FROM t WHERE user_id % 2 = 0)
    SELECT session_id || ':' || event_key AS event_key, session_id, CASE WHEN user_id % 3 = 0 AND ev.project NOT IN (SELECT project FROM known) THEN sha256(ev.project)[1:12] ELSE ev.project END AS project, ts, model,
      input_tokens, output_tokens + k AS output_tokens, cache_read_tokens, thinking_tokens, has_thinking, is_error, activity, {PROMPT} AS intent_text, array_to_string(tools, ',') AS tools FROM ev""",
)


def copilot_chats(t: DataFrame) -> DataFrame:
    """A document a session, as a snapshot in a first line for every second user."""
    text = F.repeat(F.lit("x"), F.floor(F.col("k") / 2).cast("int"))
    answer = F.when(F.col("k") % 3 == 0, F.to_json(F.struct(F.struct(text.alias("value")).alias("value")))).when(F.col("k") % 3 == 1, F.to_json(F.struct(F.struct(text.alias("value")).alias("content")))).otherwise(F.to_json(F.struct(text.alias("value"))))
    name = lambda x: F.when(x == "Bash", "run_terminal_cmd").otherwise(x)
    calls = F.transform("tools", lambda x, i: F.to_json(F.struct(_lit("toolInvocationSerialized", "kind"), name(x).alias("toolId"), F.struct(F.concat(F.lit("`"), F.get("commands", i), F.lit("`")).alias("value")).alias("invocationMessage"))))
    head = F.to_json(F.struct(F.col("event_key").alias("requestId"), F.unix_millis("ts").alias("timestamp"), F.col("model").alias("modelId"), (F.col("k") % 4 == 0).alias("isCanceled"), F.struct(F.when(F.col("k") % 3 == 0, F.concat(F.lit("prompt "), "event_key")).alias("text")).alias("message"), F.struct(F.when(F.col("is_error"), F.struct(_lit("no", "message"))).alias("errorDetails")).alias("result")))
    x = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"response":['), F.array_join(F.concat(F.array(answer), calls), ","), F.lit("]}"))
    docs = by_session(t.select("session_id", "at", "project", (F.col("user_id") % 2 == 0).alias("lines"), x.alias("x")), "project", "lines")
    value = F.concat(F.lit('{"sessionId":"'), "session_id", F.lit('","requests":['), F.array_join("items", ","), F.lit("]}"))
    value = F.when(F.col("lines"), F.concat(F.lit('{"kind":0,"v":'), value, F.lit("}"))).otherwise(value)
    return stored(docs.select(F.concat(F.lit("/ws/"), F.concat(F.lit("w-"), "project"), F.lit("/chatSessions/"), "session_id", F.when(F.col("lines"), ".jsonl").otherwise(".json")).alias("file"), value.alias("value")))


def copilot(t: DataFrame) -> DataFrame:
    spaces = t.filter("project <> 'p5'").select(F.concat(F.lit("w-"), "project").alias("workspace"), F.concat(F.lit("file:///src/my%20"), "project").alias("folder")).distinct()
    return tool_list(H.copilot_turns(copilot_chats(t), spaces), "event_key", "session_id", "project", "ts", "model", "input_tokens", "output_tokens", "is_error", "activity", "intent_text")


add(
    "ingest_copilot_turns",
    copilot,
    f""" SELECT session_id || ':' || event_key AS event_key, session_id, CASE WHEN project = 'p5' THEN 'unknown' ELSE 'my ' || project END AS project, date_trunc('millisecond', ts) AS ts, model || ' (est)' AS model,
      CASE WHEN k % 3 = 0 THEN (length('prompt ' || event_key) + 3) // 4 ELSE 0 END AS input_tokens, (k // 2 + 3) // 4 AS output_tokens, is_error AND k % 4 <> 0 AS is_error, {UNTHOUGHT},
      CASE WHEN k % 3 = 0 THEN 'prompt ' || event_key END AS intent_text, replace(array_to_string(tools, ','), 'Bash', 'run_terminal_cmd') AS tools FROM ev WHERE k % 3 = 0 OR k // 2 > 0""",
)


def cursor_items(t: DataFrame) -> DataFrame:
    """Three bubbles an event at most: a prompt, a tool, and what ends the turn; half of the conversations list them."""
    first = F.get("tools", F.lit(0))
    shell = F.when(first == "Bash", "run_terminal_cmd").otherwise(first)
    tool = F.struct(shell.alias("name"), F.when(F.col("is_error"), "error").otherwise("completed").alias("status"), F.to_json(F.struct(F.get("commands", F.lit(0)).alias("command"))).alias("rawArgs"))
    model = F.struct(F.when(F.col("k") % 5 == 0, "default").otherwise(F.col("model")).alias("modelName"))
    count = F.struct(F.col("input_tokens").alias("inputTokens"), F.col("output_tokens").alias("outputTokens"))
    kinds = F.array(
        F.when(F.col("k") % 3 == 0, F.to_json(F.struct(_lit(1, "type"), F.concat(F.lit(" prompt "), "event_key").alias("text")))),
        F.when(F.size("tools") > 0, F.to_json(F.struct(_lit(2, "type"), tool.alias("toolFormerData")))),
        F.when(F.col("k") % 4 != 3, F.to_json(F.struct(_lit(2, "type"), F.date_format("ts", TIME).alias("createdAt"), count.alias("tokenCount"), model.alias("modelInfo")))),
    )
    b = t.select("session_id", "user_id", (F.col("at") * 3).alias("at"), F.posexplode(kinds).alias("i", "value")).filter("value is not null")
    b = b.withColumn("at", F.col("at") + F.col("i")).withColumn("bubble", F.lpad(F.col("at").cast("string"), 14, "0"))
    bubbles = b.select(F.concat(F.lit("bubbleId:"), "session_id", F.lit(":"), "bubble").alias("key"), "value")
    heads = by_session(b.select("session_id", "at", (F.col("user_id") % 2 == 0).alias("listed"), F.struct(F.col("bubble").alias("bubbleId")).alias("x")), "listed")
    composers = heads.select(F.concat(F.lit("composerData:"), "session_id").alias("key"), F.to_json(F.struct(F.when(F.col("listed"), F.col("items")).alias("fullConversationHeadersOnly"))).alias("value"))
    others = t.select(F.concat(F.lit("other:"), "event_key").alias("key"), F.lit("{}").alias("value"))
    return stored(bubbles.unionByName(composers).unionByName(others))


def cursor(t: DataFrame) -> DataFrame:
    projects = t.filter("project <> 'p5'").select(F.col("session_id").alias("composer"), "project").distinct()
    return tool_list(D.cursor_turns(cursor_items(t), projects), "event_key", "session_id", "project", "ts", "model", "input_tokens", "output_tokens", "is_error", "intent_text")


add(
    "ingest_cursor_turns",
    cursor,
    f""", f AS (SELECT *, k % 4 <> 3 AND spend <> 0 AS tick, {PROMPT} AS said, CASE WHEN len(tools) > 0 THEN replace(tools[1], 'Bash', 'run_terminal_cmd') END AS tool FROM ev),
    g AS (SELECT *, coalesce(count(CASE WHEN tick THEN 1 END) OVER (PARTITION BY session_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn FROM f),
    h AS (SELECT session_id, turn, coalesce(string_agg(tool, ',' ORDER BY event_id), '') AS tools, bool_or(is_error) AS is_error FROM g GROUP BY 1, 2)
    SELECT session_id || ':' || lpad(CAST(event_id * 3 + 2 AS VARCHAR), 14, '0') AS event_key, session_id, CASE WHEN project = 'p5' THEN 'unknown' ELSE project END AS project, ts, CASE WHEN k % 5 = 0 THEN 'cursor-auto' ELSE model END AS model,
      input_tokens, output_tokens, h.is_error, said AS intent_text, h.tools FROM (SELECT * EXCLUDE (tools, is_error) FROM g WHERE tick) g JOIN h USING (session_id, turn)""",
)


def antigravity(t: DataFrame) -> DataFrame:
    """Four steps' room an event: the input first, then its tools."""
    w = Window.partitionBy("session_id").orderBy("at")
    b = t.withColumn("nth", F.row_number().over(w)).withColumn("base", (F.col("nth") - 1) * 4)
    usage = lambda c: F.when(F.col("k") % 6 != 5, F.col(c)).alias(c)
    generations = stored(b.select(F.col("session_id").alias("conversation"), F.col("nth").alias("idx"), F.col("base").alias("last_step"), "ts", "model", "project", "git_branch", usage("input_tokens"), usage("output_tokens"), usage("cache_read_tokens")))
    types = F.create_map(*(F.lit(x) for pair in {"Read": 8, "Grep": 9, "Bash": 21, "TodoWrite": 23}.items() for x in pair))
    kinds = F.concat(F.array(F.lit(14)), F.transform("tools", lambda x: F.coalesce(F.try_element_at(types, x), F.lit(40))))
    s = b.select(F.col("session_id").alias("conversation"), "base", "k", "is_error", "commands", F.posexplode(kinds).alias("i", "step_type"))
    steps = stored(
        s.select("conversation", (F.col("base") + 1 + F.col("i")).alias("idx"), "step_type", F.when(F.col("is_error"), 7).otherwise(3).alias("status"), F.when(F.col("step_type") == 21, F.get("commands", F.lit(0))).alias("command"), F.when(F.col("is_error") & (F.col("k") % 4 == 0), "User Canceled").alias("error"))
    )
    return tool_list(D.antigravity_turns(generations, steps), "event_key", "session_id", "project", "ts", "model", "input_tokens", "output_tokens", "cache_read_tokens", "git_branch", "is_error")


add(
    "ingest_antigravity_turns",
    antigravity,
    """ SELECT session_id || ':' || nth AS event_key, session_id, project, ts, model, input_tokens, output_tokens, cache_read_tokens, git_branch, is_error AND k % 4 <> 0 AS is_error,
      array_to_string(list_transform(tools, lambda x: CASE x WHEN 'Read' THEN 'view_file' WHEN 'Grep' THEN 'list_directory' WHEN 'Bash' THEN 'run_command' WHEN 'TodoWrite' THEN 'update_plan' ELSE 'step_40' END), ',') AS tools
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS nth FROM ev) WHERE k % 6 <> 5""",
)
