"""Queries of the core metrics, sessions and tools, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import norm_tool, server_of, tool_class
from ..functions.pricing import is_premium, price_turns
from ..operators import metrics as M
from ..operators import sessions as S
from ..operators import surface as U
from .mapping import NOW, now, pr_sessions, sql, turns

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, money to eight (all of it that prices can give), as the oracles have them."""
    return df.select(*(F.round(c, 8 if "usd" in c or "cost" in c else 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def add(name: str, query, oracle: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(query(turns(spark, sf_dir)))
    ORACLE_SQL[name] = sql(oracle)


def total(x: str, when: str = "TRUE") -> str:
    return f"CAST(coalesce(sum({x}) FILTER ({when}), 0) AS BIGINT)"


def share(a: str, b: str, digits: int = 6) -> str:
    return f"round(CASE WHEN coalesce({b}, 0) <> 0 THEN ({a}) / CAST({b} AS DOUBLE) ELSE 0 END, {digits})"


#: a: turns with what depends on their order; as in annotate().
A = """, a0 AS (
  SELECT *, row_number() OVER w AS idx, count(*) OVER (PARTITION BY session_id) AS n_turns,
    lag(ctx) OVER w AS prev_ctx, lag(activity) OVER w AS prev_activity, lag(ts) OVER w AS prev_ts,
    lag(CASE WHEN is_error THEN tools END) OVER w AS pet,
    coalesce(max(CASE WHEN is_error AND activity IN ('coding', 'testing') THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, event_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS failed_before,
    sum(CASE WHEN NOT is_sidechain THEN cache_creation_tokens ELSE 0 END) OVER (PARTITION BY session_id) AS mw,
    sum(CASE WHEN NOT is_sidechain THEN cache_creation_1h_tokens ELSE 0 END) OVER (PARTITION BY session_id) AS mw1
  FROM t WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_key)),
m0 AS (
  SELECT event_key, row_number() OVER w AS main_idx, count(*) OVER (PARTITION BY session_id) AS main_n, lag(ts) OVER w AS prev_main_ts
  FROM t WHERE NOT is_sidechain WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_key)),
a1 AS (
  SELECT a0.*, main_idx, main_n, CASE WHEN mw > 0 AND 2 * mw1 >= mw THEN 3600 ELSE 300 END AS ttl,
    date_diff('microsecond', prev_main_ts, ts) / 1e6 AS main_gap,
    CASE WHEN prev_ctx >= 20000 AND ctx * 2 < prev_ctx THEN idx END AS reset_idx,
    failed_before AND activity IN ('coding', 'testing') AS rework,
    coalesce(list_has_any(tools, pet), FALSE) AS retry,
    coalesce(result_chars, 0) AS chars, CAST(CASE WHEN coalesce(result_chars, 0) > 0 THEN round(result_chars / 4.0) ELSE 0 END AS BIGINT) AS returned
  FROM a0 LEFT JOIN m0 USING (event_key)),
a AS (
  SELECT *, coalesce(main_gap > ttl, FALSE) AS cold,
    coalesce(min(reset_idx) OVER (PARTITION BY session_id ORDER BY ts, event_key ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n_turns + 1) - 1 - idx AS carried
  FROM a1)
"""

# --- scalar expressions, over whole tables ---

add(
    "norm_tool",
    lambda t: t.select(F.explode("tools").alias("tool")).groupBy(norm_tool(F.col("tool")).alias("name")).count().withColumnRenamed("count", "n"),
    "SELECT regexp_replace(lower(tool), '^mcp__\\S+__', '') AS name, count(*) AS n FROM (SELECT unnest(tools) AS tool FROM t) GROUP BY 1",
)
add(
    "tool_class",
    lambda t: t.select(F.explode("tools").alias("tool")).groupBy(tool_class(F.col("tool")).alias("class")).count().withColumnRenamed("count", "n"),
    """SELECT CASE tool WHEN 'Edit' THEN 'write' WHEN 'TodoWrite' THEN 'plan' WHEN 'Read' THEN 'read' WHEN 'Grep' THEN 'read' WHEN 'Bash' THEN 'shell' ELSE 'other' END AS class, count(*) AS n
    FROM (SELECT unnest(tools) AS tool FROM t) GROUP BY 1""",
)
add("classify_activity", lambda t: t.groupBy("activity").agg(F.count("*").alias("turns")), "SELECT activity, count(*) AS turns FROM t GROUP BY 1")
add(
    "price_turns",
    lambda t: price_turns(t).select("event_key", "usd", "estimated", "priced"),
    "SELECT event_key, round(usd, 8) AS usd, estimated, priced FROM t",
)
add("premium_model", lambda t: t.select("model", is_premium(F.col("model")).alias("premium")).distinct(), "SELECT DISTINCT model, premium FROM t")
add(
    "server_of",
    lambda t: t.select(F.explode("tools").alias("tool")).groupBy("tool", server_of(F.col("tool")).alias("server")).count().withColumnRenamed("count", "n"),
    "SELECT tool, CASE WHEN tool LIKE 'mcp\\_\\_%\\_\\_%' ESCAPE '\\' THEN split_part(tool, '__', 2) END AS server, count(*) AS n FROM (SELECT unnest(tools) AS tool FROM t) GROUP BY ALL",
)
add("day_bucket", lambda t: t.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("turns")), "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS turns FROM t GROUP BY 1")
add(
    "context_tokens",
    lambda t: M.with_sums(t).select("event_key", "ctx", "fresh", "spend", "returned"),
    "SELECT event_key, ctx, fresh, spend, CAST(CASE WHEN result_chars > 0 THEN round(result_chars / 4.0) ELSE 0 END AS BIGINT) AS returned FROM t",
)

# --- metrics ---

USAGE = f"""count(*) AS events, count(DISTINCT root) AS sessions, {total('input_tokens')} AS input_tokens, {total('output_tokens')} AS output_tokens,
  {total('cache_read_tokens')} AS cache_read_tokens, {total('cache_creation_tokens')} AS cache_creation_tokens, {total('thinking_tokens')} AS thinking_tokens,
  {total('spend')} AS spend_tokens, count(*) FILTER (is_error) AS error_events, {share('sum(cache_read_tokens)', 'sum(ctx)')} AS cache_hit_ratio"""
add("usage_totals", lambda t: M.usage_totals(t, ("project",)), f"SELECT project, {USAGE} FROM t GROUP BY 1")
add("usage_overall", lambda t: M.usage_totals(t), f"SELECT {USAGE} FROM t")
add(
    "cost_totals",
    lambda t: M.cost_totals(t, ("project",)),
    f"SELECT project, round(coalesce(sum(usd) FILTER (priced), 0), 8) AS cost_usd, bool_or(priced AND estimated) AS cost_estimated, {total('spend', 'NOT priced')} AS unpriced_tokens FROM t GROUP BY 1",
)
add(
    "activity_breakdown",
    lambda t: M.activity_breakdown(t, ("project",)),
    f"SELECT project, activity, {total('spend')} AS tokens, count(*) AS turns, {share('sum(spend)', 'any_value(total)')} AS share FROM t JOIN (SELECT project, sum(spend) AS total FROM t GROUP BY 1) USING (project) GROUP BY 1, 2",
)
add(
    "think_to_code",
    lambda t: M.think_to_code(t, ("project",)),
    f"""SELECT project, {total('spend', "activity IN ('thinking', 'exploration')")} AS thinking_side, {total('spend', "activity = 'coding'")} AS coding_side,
    round(thinking_side / CAST(CASE WHEN coding_side = 0 THEN 1 ELSE coding_side END AS DOUBLE), 6) AS think_to_code FROM t GROUP BY 1""",
)
add("model_breakdown", lambda t: M.model_breakdown(t), f"SELECT model, {total('spend')} AS tokens, round(sum(usd), 8) AS cost_usd, any_value(premium) AS premium FROM t GROUP BY 1")
add("rework", lambda t: M.rework(t, ("project",)), A + f"SELECT project, {total('spend', 'rework')} AS rework_tokens, {share('sum(spend) FILTER (rework)', 'sum(spend)')} AS rework_ratio FROM a GROUP BY 1")
add("cache_ttl", lambda t: M.cache_ttl(t), A + "SELECT session_id, any_value(ttl) AS ttl_seconds FROM a WHERE NOT is_sidechain GROUP BY 1")
add(
    "cold_restarts",
    lambda t: M.cold_restarts(t, ("project",)),
    A + f"SELECT project, count(*) FILTER (cold) AS cold_turns, {total('fresh', 'cold')} AS cold_tokens, {total('fresh', 'NOT is_sidechain')} AS base_tokens, {share('cold_tokens', 'base_tokens')} AS cold_share FROM a GROUP BY 1",
)
G = A + """, g AS (
  SELECT session_id, any_value(project) AS project, sum(ctx) FILTER (main_idx <= main_n // 2) AS early, sum(ctx) FILTER (main_idx > main_n - main_n // 2) AS late,
    sum(fresh) FILTER (main_idx > main_n - main_n // 2) AS late_fresh
  FROM a WHERE NOT is_sidechain AND main_n >= 8 GROUP BY 1),
gg AS (SELECT session_id, project, CAST(late AS DOUBLE) / early AS growth, CAST(late_fresh AS DOUBLE) / late AS late_fresh_share FROM g WHERE early > 0 AND late > 0)
"""
add("context_growth", lambda t: M.context_growth(t), G + "SELECT session_id, round(growth, 6) AS growth, round(late_fresh_share, 6) AS late_fresh_share FROM gg")
add(
    "context_bloat",
    lambda t: M.context_bloat(t, ("project",)),
    G + f"SELECT project, count(*) AS trend_sessions, count(*) FILTER (growth >= 2 AND late_fresh_share >= 0.3) AS bloated_sessions, {share('bloated_sessions', 'trend_sessions')} AS bloat_share FROM gg GROUP BY 1",
)
WASTE = "premium AND activity IN ('exploration', 'conversation')"
add("premium_waste", lambda t: M.premium_waste(t, ("project",)), f"SELECT project, {total('spend', WASTE)} AS premium_waste_tokens, {share('premium_waste_tokens', 'sum(spend)')} AS premium_waste_share FROM t GROUP BY 1")
add("retry_spend", lambda t: M.retry_spend(t, ("project",)), A + f"SELECT project, {total('spend', 'retry')} AS retry_tokens, {share('retry_tokens', 'sum(spend)')} AS retry_share FROM a GROUP BY 1")
add(
    "extended_cache",
    lambda t: M.extended_cache(t, ("project",)),
    A + f"SELECT project, {total('cache_creation_1h_tokens')} AS extended_tokens, count(DISTINCT session_id) FILTER (ttl = 3600) AS extended_sessions, {share('extended_tokens', 'sum(cache_creation_tokens)')} AS extended_share FROM a GROUP BY 1",
)
add(
    "subagent_share",
    lambda t: M.subagent_share(t, ("project",)),
    f"SELECT project, count(DISTINCT session_id) FILTER (is_sidechain AND session_id IS DISTINCT FROM parent_session_id) AS runs, {total('spend', 'is_sidechain')} AS subagent_tokens, {share('subagent_tokens', 'sum(spend)')} AS subagent_share FROM t GROUP BY 1",
)
add("tool_result_totals", lambda t: M.tool_result_totals(t, ("project",)), A + f"SELECT project, {total('returned')} AS returned_tokens, count(*) FILTER (chars > 0) AS measured_turns FROM a GROUP BY 1")
add("carried_turns", lambda t: M.carried_turns(t), A + "SELECT session_id, event_key, carried FROM a")
add(
    "tool_result_carry",
    lambda t: M.tool_result_carry(t, ("project",)),
    A + f", s AS (SELECT project, session_id, sum(returned * carried) AS carry, sum(ctx) AS ctx FROM a GROUP BY 1, 2) SELECT project, {total('least(carry, ctx)')} AS carry_tokens, {share('carry_tokens', 'sum(ctx)')} AS carry_share FROM s GROUP BY 1",
)
FLOOR = """, f AS (SELECT project, session_id, min(ctx) FILTER (ctx > 0) AS floor, count(*) AS n, sum(ctx) AS ctx FROM t WHERE NOT is_sidechain GROUP BY 1, 2)
"""
add(
    "session_floor",
    lambda t: M.session_floor(t, ("project",)),
    FLOOR + f"""SELECT project, count(floor) AS floor_sessions, {total('n')} AS floor_turns, {total('ctx')} AS floor_base_tokens,
    round(CASE WHEN count(floor) >= 5 THEN quantile_cont(CAST(floor AS DOUBLE), 0.5) ELSE 0 END, 6) AS floor_tokens, {share('floor_tokens * floor_turns', 'floor_base_tokens')} AS floor_share FROM f GROUP BY 1""",
)
SHIP = """, c AS (
  SELECT project, root, bool_or(activity = 'shipping') OR root IN (SELECT session_id FROM pr) AS shipped, sum(spend) AS spend, sum(usd) AS usd FROM t GROUP BY 1, 2)
"""
SHIPPED = f"""count(*) FILTER (shipped) AS shipped_sessions, count(*) AS conversations, {share('count(*) FILTER (shipped)', 'count(*)')} AS shipped_share,
  {share('sum(usd) FILTER (shipped)', 'count(*) FILTER (shipped)', 8)} AS cost_per_shipped, {share('sum(spend) FILTER (shipped)', 'count(*) FILTER (shipped)')} AS tokens_per_shipped"""
STREAMS = f""", st AS (
  SELECT project, coalesce(git_branch, chr(0) || session_id) AS stream, coalesce(git_branch, session_id) AS shown, sum(spend) AS tokens, sum(usd) AS usd, max(ts) AS last, count(DISTINCT session_id) AS sessions,
    bool_or(activity = 'shipping' OR session_id IN (SELECT session_id FROM pr)) AS ships, bool_or(activity = 'coding') AS codes
  FROM t WHERE NOT is_sidechain GROUP BY 1, 2, 3),
sx AS (SELECT *, date_diff('microsecond', last, TIMESTAMP '{NOW}') / 86400000000.0 AS idle FROM st WHERE codes AND NOT ships)
"""
WORK = f"""count(*) FILTER (idle >= 7) AS abandoned_streams, {total('tokens', 'idle >= 7')} AS abandoned_tokens, count(*) FILTER (idle < 7) AS open_streams, {total('tokens', 'idle < 7')} AS open_tokens"""
CHANCE = f""", o AS (
  SELECT project, session_id, sum(fresh) FILTER (main_gap > 300 AND main_gap <= 3600) AS recovered, sum(cache_creation_tokens) AS writes FROM a WHERE NOT is_sidechain AND ttl = 300 GROUP BY 1, 2)
SELECT project, {total('recovered')} AS recoverable_tokens, {total('writes')} AS write_tokens, count(*) FILTER (recovered > 0) AS recoverable_sessions FROM o GROUP BY 1"""
add("extended_cache_opportunity", lambda t: M.extended_cache_opportunity(t, ("project",)), A + CHANCE)
add("shipped_outcomes", lambda t: M.shipped_outcomes(t, pr_sessions(t), ("project",)), SHIP + f"SELECT project, {SHIPPED} FROM c GROUP BY 1")
add("work_streams", lambda t: M.work_streams(t, pr_sessions(t), now()), STREAMS + f"SELECT {WORK} FROM sx")


def acts() -> str:
    return ", ".join(f"{total('spend', f'activity = {a!r}')} AS {a}_activity" for a in ("thinking", "exploration", "coding", "testing", "shipping", "conversation"))


METRICS = G + FLOOR + SHIP + STREAMS + f""",
base AS (
  SELECT project, count(*) AS events, {total('input_tokens')} AS input_tokens, {total('output_tokens')} AS output_tokens, {total('cache_read_tokens')} AS cache_read_tokens,
    {total('cache_creation_tokens')} AS cache_creation_tokens, {total('cache_creation_1h_tokens')} AS extended_cache_tokens, {total('thinking_tokens')} AS thinking_tokens, {total('spend')} AS spend_tokens,
    count(*) FILTER (is_error) AS error_events, round(coalesce(sum(usd) FILTER (priced), 0), 8) AS cost_usd, {total('spend', 'NOT priced')} AS unpriced_tokens, {acts()},
    {total('spend', 'rework')} AS rework_tokens, {total('spend', 'retry')} AS retry_tokens, {total('spend', 'premium')} AS premium_tokens, {total('spend', WASTE)} AS premium_waste_tokens,
    count(*) FILTER (cold) AS cold_restart_turns, {total('fresh', 'cold')} AS cold_restart_tokens, {total('fresh', 'NOT is_sidechain')} AS main_fresh_tokens,
    count(DISTINCT session_id) FILTER (ttl = 3600) AS extended_cache_sessions, count(DISTINCT session_id) FILTER (is_sidechain AND session_id IS DISTINCT FROM parent_session_id) AS subagent_sessions,
    {total('spend', 'is_sidechain')} AS subagent_tokens, {total('returned')} AS returned_tokens, count(*) FILTER (chars > 0) AS measured_turns,
    coalesce(bool_or(priced AND estimated), FALSE) AS cost_estimated, {total('ctx')} AS input_side
  FROM a GROUP BY 1),
fl AS (
  SELECT project, {total('n')} AS floor_turns, {total('ctx')} AS floor_base_tokens, count(floor) AS floor_sessions,
    CASE WHEN count(floor) >= 5 THEN quantile_cont(CAST(floor AS DOUBLE), 0.5) ELSE 0 END AS floor_tokens FROM f GROUP BY 1),
ca AS (SELECT project, {total('least(carry, ctx)')} AS carry_tokens FROM (SELECT project, session_id, sum(returned * carried) AS carry, sum(ctx) AS ctx FROM a GROUP BY 1, 2) GROUP BY 1),
tr AS (SELECT project, count(*) AS trend_sessions, count(*) FILTER (growth >= 2 AND late_fresh_share >= 0.3) AS bloated_sessions FROM gg GROUP BY 1),
sh AS (SELECT project, {SHIPPED} FROM c GROUP BY 1),
ws AS (SELECT project, {WORK} FROM sx GROUP BY 1)
SELECT base.* EXCLUDE (input_side), coalesce(carry_tokens, 0) AS carry_tokens, coalesce(floor_turns, 0) AS floor_turns, coalesce(floor_base_tokens, 0) AS floor_base_tokens, coalesce(floor_sessions, 0) AS floor_sessions,
  coalesce(trend_sessions, 0) AS trend_sessions, coalesce(bloated_sessions, 0) AS bloated_sessions, round(coalesce(floor_tokens, 0), 6) AS floor_tokens,
  sh.* EXCLUDE (project), coalesce(abandoned_streams, 0) AS abandoned_streams, coalesce(abandoned_tokens, 0) AS abandoned_tokens, coalesce(open_streams, 0) AS open_streams, coalesce(open_tokens, 0) AS open_tokens,
  {share('cache_read_tokens', 'input_side')} AS cache_hit_ratio, {share('rework_tokens', 'spend_tokens')} AS rework_ratio,
  round((thinking_activity + exploration_activity) / CAST(CASE WHEN coding_activity = 0 THEN 1 ELSE coding_activity END AS DOUBLE), 6) AS think_to_code,
  {share('bloated_sessions', 'trend_sessions')} AS bloat_share, {share('cold_restart_tokens', 'main_fresh_tokens')} AS cold_share, {share('premium_tokens', 'spend_tokens')} AS premium_share,
  {share('premium_waste_tokens', 'spend_tokens')} AS premium_waste_share, {share('retry_tokens', 'spend_tokens')} AS retry_share, {share('extended_cache_tokens', 'cache_creation_tokens')} AS extended_share,
  {share('subagent_tokens', 'spend_tokens')} AS subagent_share, {share('carry_tokens', 'input_side')} AS carry_share, {share('floor_tokens * floor_turns', 'floor_base_tokens')} AS floor_share,
  {share('coalesce(abandoned_tokens, 0)', 'spend_tokens')} AS abandoned_share
FROM base LEFT JOIN fl USING (project) LEFT JOIN ca USING (project) LEFT JOIN tr USING (project) LEFT JOIN sh USING (project) LEFT JOIN ws USING (project)
"""
add("compute_metrics", lambda t: M.compute_metrics(t, pr_sessions(t), now(), ("project",)), METRICS)

# --- sessions ---

STATS = A + f""", s AS (
  SELECT session_id, arg_min(project, idx) AS project, arg_min(source, idx) AS source, count(*) AS turns, {total('spend')} AS spend_tokens, round(sum(usd), 8) AS cost_usd, count(*) FILTER (is_error) AS error_turns,
    count(*) FILTER (prev_activity = 'testing' AND activity = 'coding') AS fix_iterations, CAST(round(sum(ctx) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS avg_context,
    count(*) FILTER (NOT is_sidechain AND date_diff('microsecond', prev_ts, ts) / 1e6 > ttl) AS cold_turns,
    {total('fresh', "NOT is_sidechain AND date_diff('microsecond', prev_ts, ts) / 1e6 > ttl")} AS cold_tokens,
    CAST(round(date_diff('microsecond', min(ts), max(ts)) / 60e6) AS BIGINT) AS duration_min, arg_min(is_sidechain, idx) AS is_sidechain,
    arg_min(agent_type, idx) FILTER (agent_type IS NOT NULL) AS agent_type,
    round(CASE WHEN count(*) >= 8 AND sum(ctx) FILTER (idx <= n_turns // 2) > 0 AND sum(ctx) FILTER (idx > n_turns - n_turns // 2) > 0
      THEN sum(ctx) FILTER (idx > n_turns - n_turns // 2) / CAST(sum(ctx) FILTER (idx <= n_turns // 2) AS DOUBLE) ELSE 0 END, 6) AS context_growth
  FROM a GROUP BY 1),
dom AS (
  SELECT session_id, activity AS dominant FROM (
    SELECT session_id, activity, row_number() OVER (PARTITION BY session_id ORDER BY sum(spend) DESC, list_position(['thinking','exploration','coding','testing','shipping','conversation'], activity)) AS r
    FROM (SELECT session_id, activity, spend FROM t UNION ALL SELECT session_id, 'thinking', 0 FROM t) GROUP BY 1, 2) WHERE r = 1),
ss AS (SELECT s.*, dominant FROM s JOIN dom USING (session_id))
"""
add("session_stats", lambda t: S.session_stats(t), STATS + "SELECT * FROM ss")
FAN = f""", fan AS (
  SELECT root, coalesce(arg_max(project, (ts, event_key)) FILTER (NOT is_sidechain), arg_min(project, (ts, event_key))) AS project,
    coalesce(arg_max(source, (ts, event_key)) FILTER (NOT is_sidechain), arg_min(source, (ts, event_key))) AS source,
    count(DISTINCT session_id) FILTER (is_sidechain) AS agents, {total('spend', 'is_sidechain')} AS agent_spend, round(coalesce(sum(usd) FILTER (is_sidechain), 0), 8) AS agent_cost, {total('spend', 'NOT is_sidechain')} AS main_spend
  FROM t GROUP BY 1 HAVING count(*) FILTER (is_sidechain) > 0)
"""
add("fan_out", lambda t: S.fan_out(t), FAN + f"SELECT *, {share('agent_spend', 'main_spend')} AS ratio FROM fan")
TYPES = f""", ty AS (SELECT coalesce(agent_type, 'unlabelled') AS agent_type, count(DISTINCT session_id) AS runs, {total('spend')} AS spend_tokens, round(sum(usd), 8) AS cost_usd FROM t WHERE is_sidechain GROUP BY 1)
"""
add("agent_types", lambda t: S.agent_types(t), TYPES + "SELECT * FROM ty")
TOOLS = f""", tl AS (
  SELECT tool, count(*) AS turns, count(*) FILTER (is_error) AS error_turns, {total('spend', 'list_contains(pet, tool)')} AS retry_tokens, {share('count(*) FILTER (is_error)', 'count(*)')} AS error_rate
  FROM (SELECT *, unnest(list_distinct(tools)) AS tool FROM a) GROUP BY 1)
"""
add("tool_stats", lambda t: S.tool_stats(t), A + TOOLS + "SELECT * FROM tl")
add("failing_tools", lambda t: S.failing_tools(t), A + TOOLS + "SELECT * FROM tl WHERE error_rate > 0.05 AND turns >= 20")
add(
    "abandoned_streams",
    lambda t: S.abandoned_streams(t, pr_sessions(t), now()),
    STREAMS + f"SELECT project, stream, CAST(tokens AS BIGINT) AS tokens, round(usd, 8) AS cost_usd, sessions, CAST(floor(idle) AS BIGINT) AS idle_days, idle < 7 AS open FROM sx",
)


def _list(name: str, table: str, item: str, value: str, n: int, where: str = "TRUE") -> str:
    return f"(SELECT '{name}' AS list, {item} AS item, CAST({value} AS DOUBLE) AS value FROM {table} WHERE {where} ORDER BY value DESC, item LIMIT {n})"


add(
    "deep_analysis",
    lambda t: S.deep_analysis(t, pr_sessions(t), now()),
    STATS + FAN + TYPES + TOOLS + STREAMS + " UNION ALL ".join(
        [
            _list("expensive", "ss", "session_id", "spend_tokens", 8, "NOT is_sidechain"),
            _list("fix_loop", "ss", "session_id", "fix_iterations", 8, "NOT is_sidechain AND fix_iterations >= 2"),
            _list("context_heavy", "ss", "session_id", "avg_context", 8, "NOT is_sidechain AND turns >= 10"),
            _list("bloat", "ss", "session_id", "context_growth", 8, "NOT is_sidechain AND context_growth >= 2"),
            _list("cold", "ss", "session_id", "cold_tokens", 8, "NOT is_sidechain AND cold_tokens > 0"),
            _list("tools", "tl", "tool", "turns", 15),
            _list("fan_out", "fan", "root", "agent_spend", 8),
            _list("agent_types", "ty", "agent_type", "spend_tokens", 10),
            _list("streams", "sx", "project || '/' || shown", "tokens", 10),
        ]
    ),
)

# --- tools and servers ---

SIZES = """, z AS (
  SELECT a.*, tools[1] AS tool, returned * carried AS carry, p.pr AS read_price FROM a LEFT JOIN price p ON a.model = p.model WHERE result_chars > 0)
"""
add(
    "tool_carry",
    lambda t: U.tool_carry(t),
    A + SIZES + f"""SELECT tool, count(*) AS calls, {total('returned')} AS returned_tokens, {total('carry')} AS carry_tokens, round(avg(carried), 6) AS mean_carried,
    round(sum(carry * coalesce(read_price::DOUBLE, 0) / 1e6), 8) AS carry_usd, CASE WHEN tool LIKE 'mcp#_#_%' ESCAPE '#' THEN split_part(tool, '__', 2) END AS server FROM z GROUP BY tool""",
)
add(
    "server_stats",
    lambda t: U.server_stats(t),
    A + SIZES + f""", o AS (SELECT 'docs' AS server, * FROM a WHERE list_contains(tools, 'mcp__docs__search'))
    SELECT server, 1::BIGINT AS tools, count(*) AS turns, {total('spend')} AS spend_tokens, round(sum(usd), 8) AS cost_usd, CAST(CAST(max(ts) AS DATE) AS VARCHAR) AS last_day,
      (SELECT {total('returned')} FROM z WHERE tool LIKE 'mcp%') AS returned_tokens, (SELECT {total('carry')} FROM z WHERE tool LIKE 'mcp%') AS carry_tokens,
      {share('count(*) FILTER (is_error)', 'count(*)')} AS error_rate FROM o GROUP BY 1""",
)
add("tool_surface_totals", lambda t: U.tool_surface_totals(t), A + SIZES + f"SELECT count(*) AS calls, {total('returned')} AS returned_tokens, {total('carry')} AS carry_tokens, TRUE AS measured FROM z")
