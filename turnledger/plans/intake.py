"""Queries of intake: logs rendered from ``events`` and parsed again, stored turns, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import is_declination, lenient_sizes, lenient_tools, redact_tool_name
from ..operators import project_family as P
from ..operators import state as St
from ..sources import claude as C
from ..sources import codex as X
from ..sources.bundles import read_bundles, write_bundles
from ..streaming import intake as I
from ..tables import shared_dir, stored
from .core import rounded, total
from .mapping import NOW, now, sql, turns

QUERIES: dict = {}
ORACLE_SQL: dict = {}
DECLINED = "The user doesn't want to proceed with this tool use."
CWD = "concat('/home/dev/', case when user_id % 3 = 0 then 'mono' when user_id % 3 = 1 then concat('mono/', project) else project end, case when cast(event_key as bigint) % 4 = 0 then '/api' else '' end)"


def add(name: str, query, oracle: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(query(turns(spark, sf_dir, True).withColumn("k", F.floor(F.col("output_tokens") / 20))))
    if oracle:
        ORACLE_SQL[name] = sql(oracle)


# --- transcripts ---


def transcript(t: DataFrame, own_runs: bool = False) -> DataFrame:
    """Lines (file, ord, value): sometimes a prompt, then the turn, the results of its tools, sometimes a pull request.

    With own_runs each run has a file of its own below its parent's folder. Every turn is mapped once for all its lines.
    """
    at = F.col("event_key").cast("long") * 4
    file = F.concat(F.lit("/logs/"), "session_id", F.lit(".jsonl"))
    if own_runs:
        file = F.when(F.col("is_sidechain"), F.concat(F.lit("/logs/"), "parent_session_id", F.lit("/subagents/agent-"), "session_id", F.lit(".jsonl"))).otherwise(file)
    one = F.struct
    lit = lambda x, name: F.lit(x).alias(name)
    base = t.withColumn("cwd", F.expr(CWD)).withColumn("failed", F.col("is_error"))
    line = lambda place, value: one((at + place).alias("ord"), value.alias("value"))
    prompt = F.when(F.col("k") % 3 == 0, line(0, F.to_json(one(lit("user", "type"), one(F.concat(F.lit("prompt "), "event_key").alias("content")).alias("message")))))
    blocks = F.concat(
        F.when(F.col("has_thinking"), F.array(F.lit('{"type":"thinking"}'))).otherwise(F.array().cast("array<string>")),
        F.array(F.concat(F.lit('{"type":"text","text":"answer '), "event_key", F.lit('"}'))),
        F.transform("tools", lambda x, i: F.to_json(one(lit("tool_use", "type"), F.concat(F.lit("c"), F.col("event_key"), F.lit("-"), i).alias("id"), x.alias("name"), one(F.get("commands", i).alias("command")).alias("input")))),
    )
    usage = one("input_tokens", "output_tokens", F.col("cache_read_tokens").alias("cache_read_input_tokens"), F.col("cache_creation_tokens").alias("cache_creation_input_tokens"), one(F.col("cache_creation_1h_tokens").alias("ephemeral_1h_input_tokens")).alias("cache_creation"))
    head = F.to_json(one(lit("assistant", "type"), F.col("event_key").alias("uuid"), F.col("session_id").alias("sessionId"), "cwd", F.col("git_branch").alias("gitBranch"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.col("is_sidechain").alias("isSidechain"), F.col("skill").alias("attributionSkill")))
    message = F.concat(F.lit(',"message":{"model":"'), "model", F.lit('","usage":'), F.to_json(usage), F.lit(',"content":['), F.array_join(blocks, ","), F.lit("]}}"))
    turn = line(1, F.concat(F.substring(head, F.lit(1), F.length(head) - 1), message))
    said = F.when(F.col("k") % 7 == 0, DECLINED).otherwise(F.repeat(F.lit("x"), F.col("k").cast("int")))
    results = F.transform("tools", lambda x, i: F.to_json(one(lit("tool_result", "type"), F.concat(F.lit("c"), F.col("event_key"), F.lit("-"), i).alias("tool_use_id"), F.col("is_error"), said.alias("content"))))
    result = F.when(F.size("tools") > 0, line(2, F.concat(F.lit('{"type":"user","message":{"content":['), F.array_join(results, ","), F.lit("]}}"))))
    link = F.when(F.col("user_id") % 13 == 0, line(3, F.to_json(one(lit("pr-link", "type"), F.col("session_id").alias("sessionId"), (F.col("k") % 3).alias("prNumber"), lit("r", "prRepository")))))
    broken = F.when(F.col("k") % 10 == 0, line(3, F.lit("{no json")))
    lines = base.select(file.alias("file"), F.explode(F.array(prompt, turn, result, link, broken)).alias("line")).filter("line is not null")
    # A table: the parsers' filters would else be pushed through the rendering.
    return stored(lines.select("file", "line.*"))


def written(t: DataFrame) -> DataFrame:
    """The transcript as bundles of many sessions' files, and read again."""
    path = shared_dir(t.sparkSession)
    write_bundles(transcript(t), path)
    return read_bundles(t.sparkSession, path)


KEPT = "spend + cache_read_tokens + cache_creation_tokens <> 0"
CLAUDE_COLUMNS = "event_key, session_id, ts, model, input_tokens, output_tokens, cache_read_tokens, cache_creation_tokens, cache_creation_1h_tokens, activity, is_sidechain, parent_session_id, git_branch, skill"
ACT = """CASE WHEN activity = 'thinking' AND et NOT IN ('view', 'click', 'error', 'purchase') AND k % 2 <> 0 AND NOT has_thinking THEN 'conversation' ELSE activity END"""
EV = ", ev AS (SELECT t.*, output_tokens // 20 AS k, e.et FROM t JOIN e ON e.event_id = t.event_id)"
add(
    "ingest_claude_turns",
    lambda t: (c := C.claude_turns(written(t))).select(*(x for x in CLAUDE_COLUMNS.split(", "))).withColumn("parent_session_id", F.when(F.col("is_sidechain"), F.col("session_id"))),
    # The log keeps no count of thinking tokens, and a sidechain inside a transcript belongs to its own session.
    EV + f" SELECT {CLAUDE_COLUMNS.replace('activity', ACT + ' AS activity').replace('parent_session_id', 'CASE WHEN is_sidechain THEN session_id END AS parent_session_id')} FROM ev WHERE {KEPT}",
)
add(
    "ingest_link_tool_results",
    lambda t: C.link_tool_results(C.parsed(transcript(t))).select(F.col("uuid").alias("event_key"), "is_error", F.coalesce(F.aggregate(F.map_values("tool_result_chars"), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).alias("chars")),
    EV + f" SELECT event_key, is_error AND k % 7 <> 0 AS is_error, CAST(len(tools) * CASE WHEN k % 7 = 0 THEN {len(DECLINED)} ELSE k END AS BIGINT) AS chars FROM ev WHERE len(tools) > 0 AND {KEPT}",
)
add(
    "ingest_carry_prompt",
    lambda t: C.carry_prompt(C.parsed(transcript(t))).filter("type = 'assistant'").select(F.col("uuid").alias("event_key"), "intent_text"),
    EV + " SELECT event_key, 'prompt ' || max(CASE WHEN k % 3 = 0 THEN event_id END) OVER (PARTITION BY session_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS intent_text FROM ev",
)
add(
    "ingest_inline_sidechains",
    lambda t: C.claude_turns(transcript(t)).filter("is_sidechain").select("event_key", "session_id", "parent_session_id"),
    f"SELECT event_key, session_id, session_id AS parent_session_id FROM t WHERE is_sidechain AND {KEPT}",
)
add("ingest_pr_links", lambda t: C.pr_links(C.parsed(transcript(t))), EV + " SELECT session_id, count(DISTINCT k % 3) AS pr_count FROM ev WHERE user_id % 13 = 0 GROUP BY 1")


def with_runs(t: DataFrame) -> DataFrame:
    """The transcript with each run in a file of its own below its parent's folder; some parents left no turns."""
    return transcript(t.filter("is_sidechain or user_id % 20 <> 8"), True)


add(
    "ingest_subagents",
    lambda t: P.turn_projects(stored(C.claude_turns(with_runs(t)))).filter("parent_session_id <> session_id").select("event_key", "session_id", "parent_session_id", "is_sidechain", "intent_text", "project"),
    f""", c AS (SELECT session_id, event_id, user_id % 3 AS u3, project AS p, event_id % 4 = 0 AS api FROM t WHERE {KEPT} AND (is_sidechain OR user_id % 20 <> 8)),
    s AS (SELECT session_id, bool_or(NOT api) AS base FROM c GROUP BY 1),
    l AS (SELECT session_id, event_id, CASE WHEN api AND NOT base THEN 'api' WHEN u3 = 0 THEN 'mono' ELSE p END AS label FROM c JOIN s USING (session_id)),
    sp AS (SELECT session_id, arg_max(label, (n, -f)) AS project FROM (SELECT session_id, label, count(*) AS n, min(event_id) AS f FROM l GROUP BY 1, 2) GROUP BY 1)
    SELECT event_key, t.session_id, parent_session_id, is_sidechain, CAST(NULL AS VARCHAR) AS intent_text, coalesce(pp.project, sp.project) AS project
    FROM t LEFT JOIN sp AS pp ON pp.session_id = t.parent_session_id LEFT JOIN sp ON sp.session_id = t.session_id WHERE is_sidechain AND {KEPT}""",
)
add("is_declination", lambda t: t.select("event_key", is_declination(F.when(F.col("k") % 7 == 0, F.concat(F.lit("Error: "), F.lit(DECLINED))).otherwise(F.col("model"))).alias("declined")), EV + " SELECT event_key, k % 7 = 0 AS declined FROM ev")

# --- rollout logs ---


def rollout(t: DataFrame) -> DataFrame:
    """Lines with growing counters: a call of each tool, and a tick for three of four events."""
    at = F.col("event_key").cast("long") * 20
    w = Window.partitionBy("session_id").orderBy(F.col("event_key").cast("long"))
    grown = {c: F.sum(x).over(w) for c, x in {"input_tokens": F.col("input_tokens") + F.col("cache_read_tokens"), "cached_input_tokens": F.col("cache_read_tokens"), "output_tokens": F.col("output_tokens"), "reasoning_output_tokens": F.col("thinking_tokens")}.items()}
    b = t.withColumns({f"s_{c}": x for c, x in grown.items()}).withColumn("nth", F.row_number().over(w))
    file = F.concat(F.lit("/rollouts/"), "session_id", F.lit(".jsonl"))
    payload = lambda kind, *cols: F.to_json(F.struct(F.lit(kind).alias("type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.struct(*cols).alias("payload")))
    meta = b.filter("nth = 1").select(file.alias("file"), at.alias("ord"), payload("session_meta", F.col("session_id").alias("id"), F.concat(F.lit("/src/"), "project").alias("cwd")).alias("value"))
    model = b.select(file.alias("file"), (at + 1).alias("ord"), payload("turn_context", F.lit("turn_context").alias("type"), "model").alias("value"))
    calls = b.select("*", F.posexplode("tools").alias("i", "tool")).select(file.alias("file"), (at + 2 + F.col("i")).alias("ord"), payload("response_item", F.lit("function_call").alias("type"), F.col("tool").alias("name")).alias("value"))
    usage = F.struct(*(F.col(f"s_{c}").alias(c) for c in grown))
    ticks = b.filter("k % 4 <> 3").select(file.alias("file"), (at + 15).alias("ord"), payload("event_msg", F.lit("token_count").alias("type"), F.struct(usage.alias("total_token_usage")).alias("info")).alias("value"))
    return stored(meta.unionByName(model).unionByName(calls).unionByName(ticks))


add(
    "ingest_codex_turns",
    lambda t: X.codex_turns(rollout(t)).select("event_key", "session_id", "project", "ts", "model", "input_tokens", "output_tokens", "cache_read_tokens", "thinking_tokens", F.array_join("tools", ",").alias("tools")),
    EV
    + """, g AS (SELECT *, sum(input_tokens) OVER w AS si, sum(cache_read_tokens) OVER w AS sr, sum(output_tokens) OVER w AS so, sum(thinking_tokens) OVER w AS st,
      coalesce(count(CASE WHEN k % 4 <> 3 THEN 1 END) OVER (PARTITION BY session_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn
      FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY event_id)),
    h AS (SELECT session_id, turn, coalesce(array_to_string(flatten(list(tools ORDER BY event_id)), ','), '') AS tools FROM g GROUP BY 1, 2)
    SELECT session_id || ':' || (turn + 1) AS event_key, session_id, project, ts, model, CAST(si - coalesce(lag(si) OVER l, 0) AS BIGINT) AS input_tokens, CAST(so - coalesce(lag(so) OVER l, 0) AS BIGINT) AS output_tokens,
      CAST(sr - coalesce(lag(sr) OVER l, 0) AS BIGINT) AS cache_read_tokens, CAST(st - coalesce(lag(st) OVER l, 0) AS BIGINT) AS thinking_tokens, h.tools
    FROM (SELECT * EXCLUDE (tools) FROM g WHERE k % 4 <> 3) g JOIN h USING (session_id, turn) WINDOW l AS (PARTITION BY session_id ORDER BY event_id)""",
)

# --- stored turns ---


def table_of(t: DataFrame) -> DataFrame:
    path = shared_dir(t.sparkSession)
    St.append_turns(t, None, path)
    return t.sparkSession.read.parquet(path)


def appended(t: DataFrame) -> DataFrame:
    """Half of the turns stored, then all of them twice offered."""
    path = shared_dir(t.sparkSession)
    St.append_turns(t.filter("user_id % 2 = 0"), None, path)
    St.append_turns(t.unionByName(t), t.sparkSession.read.parquet(path), path)
    return t.sparkSession.read.parquet(path)


add("append_turns", lambda t: appended(t).groupBy("source", F.col("dt").cast("string").alias("dt")).agg(F.count("*").alias("turns")), "SELECT source, CAST(CAST(ts AS DATE) AS VARCHAR) AS dt, count(*) AS turns FROM t GROUP BY 1, 2")
add(
    "load_turns",
    lambda t: St.load_turns(table_of(t), now(), 15, project="p3", source="cursor").select("event_key", "session_id", "ts"),
    f"SELECT event_key, session_id, ts FROM t WHERE project = 'p3' AND source = 'cursor' AND ts >= TIMESTAMP '{NOW}' - INTERVAL 15 DAY",
)
add("find_sessions", lambda t: St.find_sessions(t, "u1"), "SELECT session_id, any_value(project) AS project, any_value(source) AS source, count(*) AS turns, max(ts) AS last_ts FROM t WHERE session_id LIKE 'u1%' GROUP BY 1")
add("redact_tool_name", lambda t: t.select(F.explode("tools").alias("tool")).groupBy(redact_tool_name(F.col("tool")).alias("name")).agg(F.count("*").alias("n")), "SELECT CASE WHEN tool = 'mcp__docs__search' THEN 'mcp:search' ELSE tool END AS name, count(*) AS n FROM (SELECT unnest(tools) AS tool FROM t) GROUP BY 1")
add(
    "lenient_tools",
    lambda t: t.select("event_key", F.size(lenient_tools(F.when(F.col("k") % 9 == 0, "[broken").when(F.col("k") % 9 == 1, F.lit(None)).otherwise(F.to_json("tools")))).cast("long").alias("n")),
    EV + " SELECT event_key, CASE WHEN k % 9 < 2 THEN 0 ELSE len(tools) END AS n FROM ev",
)
add(
    "lenient_sizes",
    lambda t: t.select("event_key", F.aggregate(F.map_values(lenient_sizes(F.when(F.col("k") % 9 == 0, "{broken").otherwise(F.to_json("tool_result_chars")))), F.lit(0).cast("long"), lambda a, x: a + x).alias("chars")),
    EV + " SELECT event_key, CASE WHEN k % 9 = 0 THEN 0 ELSE result_chars END AS chars FROM ev",
)
add(
    "session_projects",
    lambda t: P.session_projects(t.withColumn("cwd", F.expr(CWD)).withColumn("ord", F.col("event_key").cast("long"))),
    # The monorepo's folder has three segments; its folders take its name where it was visited itself.
    """, c AS (SELECT session_id, event_id, user_id % 3 AS u3, project AS p, event_id % 4 = 0 AS api FROM t),
    s AS (SELECT session_id, bool_or(NOT api) AS base FROM c GROUP BY 1),
    l AS (SELECT session_id, event_id, CASE WHEN api AND NOT base THEN 'api' WHEN u3 = 0 THEN 'mono' ELSE p END AS label FROM c JOIN s USING (session_id))
    SELECT session_id, arg_max(label, (n, -f)) AS project FROM (SELECT session_id, label, count(*) AS n, min(event_id) AS f FROM l GROUP BY 1, 2) GROUP BY 1""",
)
QUERIES["session_project"], ORACLE_SQL["session_project"] = QUERIES["session_projects"], ORACLE_SQL["session_projects"]

# --- state ---


def prints(t: DataFrame) -> DataFrame:
    return t.groupBy("session_id").agg(F.min("source").alias("source"), F.min("project").alias("project"), F.count("*").alias("shingles"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


add(
    "upsert_relay_fingerprints",
    lambda t: St.upsert_relay_fingerprints(prints(t.filter("user_id % 2 = 0")).withColumn("shingles", F.when(F.col("session_id").endswith("1"), F.lit(9999).cast("long")).otherwise(F.col("shingles"))).withColumn("project", F.lit("old")), prints(t)),
    """, p AS (SELECT session_id, min(source) AS source, min(project) AS project, count(*) AS n, min(ts) AS f, max(ts) AS l, any_value(user_id) % 2 = 0 AND session_id LIKE '%1' AND count(*) < 9999 AS stays FROM t GROUP BY 1)
    SELECT session_id, source, CASE WHEN stays THEN 'old' ELSE project END AS project, CASE WHEN stays THEN 9999 ELSE n END AS shingles, f AS first_ts, l AS last_ts FROM p""",
)


def found(t: DataFrame) -> DataFrame:
    return t.groupBy(F.col("session_id").alias("to_session"), F.concat(F.lit("u"), F.col("user_id") + 1).alias("from_session")).agg(F.count("*").alias("relayed_words"))


add(
    "upsert_relay_findings",
    lambda t: St.upsert_relay_findings(found(t).withColumn("relayed_words", F.lit(-1).cast("long")), found(t.filter("user_id % 3 = 0"))),
    "SELECT session_id AS to_session, 'u' || (user_id + 1) AS from_session, CASE WHEN user_id % 3 = 0 THEN count(*) ELSE -1 END AS relayed_words FROM t GROUP BY session_id, user_id",
)


def metric_values(t: DataFrame) -> DataFrame:
    m = t.agg(F.avg(F.col("is_error").cast("int")).alias("rework_ratio"), (F.sum("cache_read_tokens") / F.sum(F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_creation_tokens"))).alias("cache_hit_ratio"), F.avg(F.col("is_sidechain").cast("int")).alias("retry_share"))
    return m.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in m.columns))).alias("x")).select("x.*")


def stored_findings(t: DataFrame) -> DataFrame:
    """Three findings stored by an earlier run; one of them no longer fires."""
    day = F.lit("2024-01-10").cast("timestamp")
    rows = metric_values(t).select(F.concat(F.lit("r-"), "metric").alias("rule"), "metric", F.when(F.col("metric") == "cache_hit_ratio", "up").otherwise("down").alias("direction"), (F.col("value") * F.when(F.col("metric") == "retry_share", 1.0).otherwise(0.5)).alias("baseline"), day.alias("created_at"), F.lit(None).cast("timestamp").alias("resolved_at"))
    return rows


VALUES = """, mv AS (SELECT 'rework_ratio' AS metric, avg(is_error::INTEGER) AS value FROM t UNION ALL SELECT 'cache_hit_ratio', sum(cache_read_tokens) / sum(ctx)::DOUBLE FROM t UNION ALL SELECT 'retry_share', avg(is_sidechain::INTEGER) FROM t)
"""
add(
    "sync_findings",
    lambda t: St.sync_findings(stored_findings(t), metric_values(t), stored_findings(t).select("rule", "metric", "direction").filter("metric <> 'retry_share'").unionByName(t.sparkSession.createDataFrame([("r-new", "retry_share", "down")], "rule string, metric string, direction string")), now()).select("rule", "metric", "direction", "baseline", F.col("current"), "status", F.col("resolved_at").isNotNull().alias("resolved")),
    VALUES
    + """, st AS (SELECT 'r-' || metric AS rule, metric, CASE WHEN metric = 'cache_hit_ratio' THEN 'up' ELSE 'down' END AS direction, value * CASE WHEN metric = 'retry_share' THEN 1.0 ELSE 0.5 END AS baseline, value AS current FROM mv)
    SELECT rule, metric, direction, round(baseline, 6) AS baseline, round(current, 6) AS current,
      CASE WHEN metric = 'retry_share' THEN 'resolved' WHEN (CASE direction WHEN 'up' THEN current - baseline ELSE baseline - current END) > 0.02 THEN 'improving' WHEN (CASE direction WHEN 'up' THEN current - baseline ELSE baseline - current END) < -0.02 THEN 'regressing' ELSE 'tracking' END AS status,
      metric = 'retry_share' AS resolved FROM st
    UNION ALL SELECT 'r-new', 'retry_share', 'down', round(value, 6), round(value, 6), 'new', FALSE FROM mv WHERE metric = 'retry_share'""",
)


def interventions(t: DataFrame) -> DataFrame:
    state = stored_findings(t).withColumn("message", F.lit("old")).withColumn("rule", F.when(F.col("metric") == "rework_ratio", "llm:rework_ratio").otherwise(F.col("rule")))
    proposed = metric_values(t).select("metric", F.concat(F.lit("lower "), "metric").alias("message")).unionByName(t.select(F.lit("unknown").alias("metric"), F.lit("x").alias("message")).limit(1))
    return St.record_interventions(state, proposed, metric_values(t), now()).select("rule", "metric", "direction", "baseline", "message")


add(
    "record_interventions",
    interventions,
    VALUES
    + """SELECT CASE WHEN metric = 'rework_ratio' THEN 'llm:rework_ratio' ELSE 'r-' || metric END AS rule, metric, CASE WHEN metric = 'cache_hit_ratio' THEN 'up' ELSE 'down' END AS direction, round(value * CASE WHEN metric = 'retry_share' THEN 1.0 ELSE 0.5 END, 6) AS baseline, 'old' AS message FROM mv
    UNION ALL SELECT 'llm:' || metric, metric, CASE WHEN metric = 'cache_hit_ratio' THEN 'up' ELSE 'down' END, round(value, 6), 'lower ' || metric FROM mv WHERE metric <> 'rework_ratio'""",
)

# --- streams ---

STREAM_COLUMNS = ["source", "event_key", "session_id", "project", "ts", "input_tokens", "output_tokens"]


def collected(t: DataFrame) -> DataFrame:
    """Two runs over a growing folder of files that repeat turns; what the table holds then."""
    spark, rows = t.sparkSession, t.select(*STREAM_COLUMNS)
    files, table, state = shared_dir(spark), shared_dir(spark), shared_dir(spark)
    rows.filter("input_tokens % 3 <> 0").write.parquet(f"{files}/a")
    I.stream_collect(spark, f"{files}/*", rows.schema, table, state)
    rows.unionByName(rows).write.parquet(f"{files}/b")
    I.stream_collect(spark, f"{files}/*", rows.schema, table, state)
    return spark.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(table)


def streamed_days(t: DataFrame) -> DataFrame:
    spark, rows = t.sparkSession, t.select(*STREAM_COLUMNS)
    files, table = I.turn_files(rows), shared_dir(spark)
    I.stream_daily_usage(spark, files, rows.schema, table, shared_dir(spark), "60 days")
    return I.daily_usage(spark, table)


add("stream_collect", lambda t: collected(t).select("source", "event_key", "session_id"), "SELECT source, event_key, session_id FROM t")
add("stream_daily_usage", streamed_days, f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, source, project, count(*) AS turns, {total('spend')} AS tokens FROM t GROUP BY 1, 2, 3")
