"""One document of aggregates for a model to look at: rounded numbers, no names that could identify anything.

Results of different grain (metrics, projects, models, lists of sessions, tools) become rows of one
union, each as JSON text, which one aggregation puts together; nothing is joined. Sessions appear
without their ids; agents' types, branches and servers don't appear, tools without the server
they belong to. Lists are of bounded length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import redact_tool_name
from ..functions.pricing import price_turns
from ..tables import stored
from .exports import ACTIVITIES, RATIOS
from .metrics import _sum, compute_metrics, ratio
from .rules import findings, with_rates
from .sessions import fan_out, session_stats, tool_stats
from .team import personas

PROJECTS, SESSIONS, FAN_OUTS = 10, 8, 5
#: Lists of sessions: their name, what a session needs to be on it, by what it is ordered.
LISTS = [
    ("expensiveSessions", "true", "spend_tokens"),
    ("fixLoopSessions", "fix_iterations >= 2", "fix_iterations"),
    ("contextHeavySessions", "turns >= 10", "avg_context"),
    ("bloatTrendSessions", "context_growth >= 2", "context_growth"),
    ("coldRestartSessions", "cold_tokens > 0", "cold_tokens"),
]
_COUNTS = {"conversations": "sessions", "events": "turns", "spend_tokens": "spendTokens", "measured_turns": "toolResultTurns", "shipped_sessions": "shippedSessions", "abandoned_streams": "abandonedStreams", "open_streams": "openStreams", "subagent_tokens": "subagentSpendTokens", "subagent_sessions": "subagentRuns"}


def _object(*columns: Column) -> Column:
    return F.to_json(F.struct(*columns))


def _top(df: DataFrame, part: str, order: list, n: int, json: Column) -> DataFrame:
    best = df.orderBy(*order).limit(n)
    return best.select(F.lit(part).alias("part"), F.row_number().over(Window.orderBy(*order)).alias("place"), json.alias("json"))  # n rows


def payload_parts(turns: DataFrame, pr_sessions: DataFrame, now: Column) -> DataFrame:
    """(part, place, json): the pieces of the document."""
    m = compute_metrics(turns, pr_sessions, now)
    m = stored(with_rates(m, turns))
    cost = lambda c: F.round(c, 2)
    numbers = [F.col(c).alias(n) for c, n in _COUNTS.items()] + [cost("cost_usd").alias("costUsd"), cost("cost_per_shipped").alias("costPerShippedSession"), F.col("floor_tokens").alias("sessionFloorTokens")]
    shares = [F.round(c, 3).alias(n) for c, n in RATIOS.items()]
    active = F.struct(*(F.when(F.col(f"{a}_activity") > 0, F.round(ratio(f"{a}_activity", "spend_tokens"), 3)).alias(a) for a in ACTIVITIES)).alias("activityShares")
    one = F.lit(1)
    parts = m.select(F.lit("overall").alias("part"), one.alias("place"), _object(*numbers, *shares, active, personas(m).alias("persona")).alias("json"))
    parts = parts.unionByName(_top(findings(m), "ruleBasedFindings", [F.asc("rule")], 1 << 10, F.concat(F.lit('"'), "rule", F.lit('"'))))
    models = price_turns(turns).groupBy("model").agg(_sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), cost(F.sum("usd")).alias("costUsd"))
    name = F.regexp_extract(_object("model"), r'^\{"model":(.*)\}$', 1)
    parts = parts.unionByName(models.select(F.lit("models").alias("part"), F.row_number().over(Window.orderBy("model")).alias("place"), F.concat(name, F.lit(":"), _object("tokens", "costUsd")).alias("json")))
    projects = compute_metrics(turns, pr_sessions, now, ("project",))
    about = _object("project", F.col("spend_tokens").alias("spendTokens"), cost("cost_usd").alias("costUsd"), *(F.round(c, 3).alias(RATIOS[c]) for c in ("cache_hit_ratio", "rework_ratio", "think_to_code")), personas(projects).alias("persona"))
    parts = parts.unionByName(_top(projects, "projects", [F.desc("spend_tokens"), F.asc("project")], PROJECTS, about))
    sessions = stored(session_stats(turns).filter("not is_sidechain"))
    slim = _object(
        "project", "source", "turns", F.col("spend_tokens").alias("spendTokens"), cost("cost_usd").alias("costUsd"), F.col("error_turns").alias("errorTurns"), F.col("fix_iterations").alias("fixIterations"), F.col("avg_context").alias("avgContextTokens"),
        F.round("context_growth", 1).alias("contextGrowth"), F.col("cold_tokens").alias("coldRestartTokens"), F.col("duration_min").alias("durationMin"), "dominant",
    )
    for part, needs, by in LISTS:
        parts = parts.unionByName(_top(sessions.filter(needs), part, [F.desc(by), F.asc("session_id")], SESSIONS, slim))
    spread = _object("project", "agents", F.col("agent_spend").alias("agentSpendTokens"), F.col("main_spend").alias("mainSpendTokens"), F.round("ratio", 1).alias("ratio"))
    parts = parts.unionByName(_top(fan_out(turns), "fanOutSessions", [F.desc("agent_spend"), F.asc("root")], FAN_OUTS, spread))
    tool = _object(redact_tool_name(F.col("tool")).alias("tool"), "turns", cost("error_rate").alias("errorRate"), F.col("retry_tokens").alias("retryTokens"))
    failing = tool_stats(turns).orderBy(F.desc("turns"), "tool").limit(15).filter("error_rate > 0.05 and turns >= 20")
    return parts.unionByName(_top(failing, "toolErrorRates", [F.desc("turns"), F.asc("tool")], 15, tool))


def aggregate_payload(turns: DataFrame, pr_sessions: DataFrame, now: Column, days: int) -> DataFrame:
    """One row: doc, the document as JSON."""
    lists = payload_parts(turns, pr_sessions, now).groupBy("part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "json"))), lambda x: x["json"]), ",").alias("json"))
    by = lists.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("part", "json"))).alias("m"))
    part = lambda name: F.coalesce(F.try_element_at("m", F.lit(name)), F.lit(""))
    overall = F.concat(F.regexp_replace(part("overall"), r"\}$", ""), F.lit(',"models":{'), part("models"), F.lit("}}"))
    names = ["projects", *(n for n, _, _ in LISTS), "fanOutSessions", "toolErrorRates", "ruleBasedFindings"]
    arrays = [x for n in names for x in (F.lit(f',"{n}":['), part(n), F.lit("]"))]
    return by.select(F.concat(F.lit(f'{{"windowDays":{days},"overall":'), overall, *arrays, F.lit("}")).alias("doc"))
