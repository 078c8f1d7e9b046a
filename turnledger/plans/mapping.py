"""The driver's tables as turns, in plain arithmetic, once for Spark and once in SQL.

The tables are not agent logs; every column of a turn is derived from ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import classify_activity

NOW = "2024-01-31 00:00:00"
DAYS = 30

SOURCES = ["claude-code", "gemini-cli", "codex", "cursor", "antigravity", "copilot"]
MODELS = ["claude-opus-4-7", "claude-haiku-4-5", "claude-sonnet-4-5", "gpt-5-codex", "gemini-3-pro-preview", "gemini-3-flash-preview", "totally-new-llm"]


def now():
    return F.lit(NOW).cast("timestamp")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("u"),
        F.col("event_type").alias("et"),
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def turns(spark: SparkSession, sf_dir: str, with_commands: bool = False) -> DataFrame:
    """Turns mapped from ``events``."""
    e = events(spark, sf_dir)
    u, k, et = F.col("u"), F.col("k"), F.col("et")
    w = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01")) / 5)
    side = u % 10 == 9
    none = F.array().cast("array<string>")
    tools = (
        F.when(et == "view", F.when(k % 4 == 0, F.array(F.lit("Read"), F.lit("mcp__docs__search"))).otherwise(F.array(F.lit("Grep"))))
        .when(et == "click", F.array(F.lit("Edit")))
        .when(et.isin("error", "purchase"), F.array(F.lit("Bash")))
        .otherwise(F.when(k % 2 == 0, F.array(F.lit("TodoWrite"))).otherwise(none))
    )
    commands = F.when(et == "error", F.array(F.lit("pytest -q"))).when(et == "purchase", F.array(F.when(k >= 97, "git push").otherwise("ls"))).otherwise(none)
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    out = e.select(
        pick(SOURCES, u % 6).alias("source"),
        F.col("event_id").cast("string").alias("event_key"),
        F.concat(F.lit("u"), u, F.lit("-"), w).alias("session_id"),
        F.concat(F.lit("p"), (u - side.cast("int")) % 12).alias("project"),
        F.lit(None).cast("string").alias("project_raw"),
        "ts",
        pick(MODELS, F.col("event_id") % 7).alias("model"),
        F.floor(F.col("value") * 10).alias("input_tokens"),
        (k * 20).alias("output_tokens"),
        F.when(k < 70, k * 900).otherwise(0).alias("cache_read_tokens"),
        F.when(k % 5 == 0, k * 50).otherwise(0).alias("cache_creation_tokens"),
        F.when((k % 5 == 0) & (u % 4 == 0), k * 50).otherwise(0).alias("cache_creation_1h_tokens"),
        F.when(k % 11 == 0, k).otherwise(0).alias("thinking_tokens"),
        tools.alias("tools"),
        commands.alias("commands"),
        F.when((u % 6 == 0) & (F.size(tools) > 0), F.create_map(F.get(tools, F.lit(0)), k * 400)).alias("tool_result_chars"),
        ((et == "signup") & (k % 4 == 1)).alias("has_thinking"),
        (((et == "error") & (k % 2 == 0)) | ((et == "click") & (k % 10 == 0))).alias("is_error"),
        side.alias("is_sidechain"),
        F.when(u % 3 != 0, F.concat(F.lit("b"), u % 4)).alias("git_branch"),
        F.when(side, F.concat(F.lit("u"), u - 1, F.lit("-"), w)).alias("parent_session_id"),
        F.when(side, F.when(u % 3 == 1, "general-purpose").when(u % 3 == 2, "Explore")).alias("agent_type"),
        F.when(~side & (u % 6 == 0) & (k % 20 == 0), F.concat(F.lit("skill-"), w % 3)).alias("skill"),
        u.alias("user_id"),
    )
    out = out.withColumn("activity", classify_activity(F.col("tools"), F.col("commands"), F.col("has_thinking"), F.col("thinking_tokens")))
    return out if with_commands else out.drop("commands")


def pr_sessions(turns_: DataFrame) -> DataFrame:
    """Sessions with a linked pull request: main sessions of every 13th user."""
    return turns_.filter(~F.col("is_sidechain") & (F.col("user_id") % 13 == 0)).select("session_id").distinct()


#: The same turns in DuckDB: common table expressions that every oracle starts with.
TURNS_SQL = """
e AS (
  SELECT event_id, ts, user_id AS u, event_type AS et, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 5.0) AS BIGINT) AS w
  FROM events),
t0 AS (
  SELECT
    (['claude-code','gemini-cli','codex','cursor','antigravity','copilot'])[u % 6 + 1] AS source,
    CAST(event_id AS VARCHAR) AS event_key,
    'u' || u || '-' || w AS session_id,
    'p' || ((u - CASE WHEN u % 10 = 9 THEN 1 ELSE 0 END) % 12) AS project,
    ts,
    (['claude-opus-4-7','claude-haiku-4-5','claude-sonnet-4-5','gpt-5-codex','gemini-3-pro-preview','gemini-3-flash-preview','totally-new-llm'])[event_id % 7 + 1] AS model,
    CAST(floor(value * 10) AS BIGINT) AS input_tokens,
    k * 20 AS output_tokens,
    CASE WHEN k < 70 THEN k * 900 ELSE 0 END AS cache_read_tokens,
    CASE WHEN k % 5 = 0 THEN k * 50 ELSE 0 END AS cache_creation_tokens,
    CASE WHEN k % 5 = 0 AND u % 4 = 0 THEN k * 50 ELSE 0 END AS cache_creation_1h_tokens,
    CASE WHEN k % 11 = 0 THEN k ELSE 0 END AS thinking_tokens,
    CASE WHEN et = 'view' THEN CASE WHEN k % 4 = 0 THEN ['Read','mcp__docs__search'] ELSE ['Grep'] END
         WHEN et = 'click' THEN ['Edit'] WHEN et IN ('error','purchase') THEN ['Bash']
         WHEN k % 2 = 0 THEN ['TodoWrite'] ELSE CAST([] AS VARCHAR[]) END AS tools,
    CASE WHEN u % 6 = 0 AND NOT (et NOT IN ('view','click','error','purchase') AND k % 2 <> 0) THEN k * 400 END AS result_chars,
    et = 'signup' AND k % 4 = 1 AS has_thinking,
    (et = 'error' AND k % 2 = 0) OR (et = 'click' AND k % 10 = 0) AS is_error,
    u % 10 = 9 AS is_sidechain,
    CASE WHEN u % 3 <> 0 THEN 'b' || (u % 4) END AS git_branch,
    CASE WHEN et = 'error' THEN 'testing' WHEN et = 'purchase' AND k >= 97 THEN 'shipping'
         WHEN et = 'view' AND k % 4 = 0 THEN 'coding' -- a tool of no known class acts
         WHEN et IN ('purchase','view') THEN 'exploration' WHEN et = 'click' THEN 'coding'
         WHEN k % 2 = 0 THEN 'thinking' WHEN (et = 'signup' AND k % 4 = 1) OR k % 11 = 0 THEN 'thinking' ELSE 'conversation' END AS activity,
    CASE WHEN u % 10 = 9 THEN 'u' || (u - 1) || '-' || w END AS parent_session_id,
    CASE WHEN u % 10 = 9 THEN CASE u % 3 WHEN 1 THEN 'general-purpose' WHEN 2 THEN 'Explore' END END AS agent_type,
    CASE WHEN u % 10 <> 9 AND u % 6 = 0 AND k % 20 = 0 THEN 'skill-' || (w % 3) END AS skill,
    u AS user_id, event_id
  FROM e),
price(model, pi, po, pr, pw, p1h, est) AS (VALUES
  ('claude-opus-4-7', 5.0, 25.0, 0.5, 6.25, 10.0, false), ('claude-haiku-4-5', 1.0, 5.0, 0.1, 1.25, 2.0, false),
  ('claude-sonnet-4-5', 3.0, 15.0, 0.3, 3.75, 6.0, false), ('gpt-5-codex', 1.25, 10.0, 0.125, 0.0, NULL, true),
  ('gemini-3-pro-preview', 2.0, 12.0, 0.2, 0.0, NULL, false), ('gemini-3-flash-preview', 0.5, 3.0, 0.05, 0.0, NULL, false)),
t AS (
  SELECT t0.*, coalesce((input_tokens * pi::DOUBLE + output_tokens * po::DOUBLE + cache_read_tokens * pr::DOUBLE + cache_creation_tokens * pw::DOUBLE) / 1e6, 0) AS usd,
    pi IS NOT NULL AS priced, coalesce(est, false) AS estimated,
    input_tokens + output_tokens AS spend,
    input_tokens + cache_read_tokens + cache_creation_tokens AS ctx,
    input_tokens + cache_creation_tokens AS fresh,
    coalesce(parent_session_id, session_id) AS root,
    t0.model IN ('claude-opus-4-7', 'gpt-5-codex', 'gemini-3-pro-preview') AS premium
  FROM t0 LEFT JOIN price ON t0.model = price.model),
pr AS (SELECT DISTINCT session_id FROM t WHERE NOT is_sidechain AND user_id % 13 = 0)
"""


def sql(body: str) -> str:
    """An oracle over the turns: t (priced turns) and pr (sessions with a pull request)."""
    return f"WITH {TURNS_SQL.strip()}{body if body.lstrip().startswith(',') else chr(10) + body}"
