"""Session-level analysis: one row per session, conversation, tool or stream, and top lists of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ACTIVITIES
from .annotate import MIN_TREND_TURNS, annotate, halves, with_sums
from .metrics import _sum, ratio, streams


def session_stats(turns: DataFrame) -> DataFrame:
    """One row per session. Here a cold turn's gap is to any turn before it, main loop or not."""
    t = annotate(turns)
    gap = (F.unix_micros("ts") - F.unix_micros("prev_ts")) / 1e6
    cold = ~F.col("is_sidechain") & F.coalesce(gap > F.col("ttl"), F.lit(False))
    early, late = halves(F.col("idx"), F.col("n_turns"))
    order = F.struct("ts", "event_key")
    s = t.groupBy("session_id").agg(
        F.min_by("project", order).alias("project"),
        F.min_by("source", order).alias("source"),
        F.count("*").alias("turns"),
        _sum("spend").alias("spend_tokens"),
        _sum("usd").alias("cost_usd"),
        F.count(F.when(F.col("is_error"), 1)).alias("error_turns"),
        F.count(F.when((F.col("prev_activity") == "testing") & (F.col("activity") == "coding"), 1)).alias("fix_iterations"),
        F.round(F.sum("ctx") / F.count("*")).cast("long").alias("avg_context"),
        _sum("ctx", early).alias("early"),
        _sum("ctx", late).alias("late"),
        F.count(F.when(cold, 1)).alias("cold_turns"),
        _sum("fresh", cold).alias("cold_tokens"),
        F.round((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 60e6).cast("long").alias("duration_min"),
        *(_sum("spend", F.col("activity") == a).alias(f"act_{a}") for a in ACTIVITIES),
        F.min_by("is_sidechain", order).alias("is_sidechain"),
        F.min_by("agent_type", F.when(F.col("agent_type").isNotNull(), order)).alias("agent_type"),
    )
    grown = (F.col("turns") >= MIN_TREND_TURNS) & (F.col("early") > 0) & (F.col("late") > 0)
    # The activity with the most tokens; of equal ones the first in list order.
    ranked = F.array_max(F.array(*(F.struct(F.col(f"act_{a}").alias("tokens"), F.lit(-i).alias("place"), F.lit(a).alias("name")) for i, a in enumerate(ACTIVITIES))))
    s = s.withColumn("context_growth", F.when(grown, F.col("late") / F.col("early")).otherwise(0.0)).withColumn("dominant", ranked["name"])
    return s.drop("early", "late", *(f"act_{a}" for a in ACTIVITIES))


def fan_out(turns: DataFrame) -> DataFrame:
    """Conversations with agent runs: what these spent next to the main loop."""
    t = with_sums(turns)
    main, order = ~F.col("is_sidechain"), F.struct("ts", "event_key")
    s = t.groupBy("root").agg(
        F.coalesce(F.max_by("project", F.when(main, order)), F.min_by("project", order)).alias("project"),
        F.coalesce(F.max_by("source", F.when(main, order)), F.min_by("source", order)).alias("source"),
        F.countDistinct(F.when(~main, F.col("session_id"))).alias("agents"),
        _sum("spend", ~main).alias("agent_spend"),
        _sum("usd", ~main).alias("agent_cost"),
        _sum("spend", main).alias("main_spend"),
    )
    return s.filter("agents > 0").withColumn("ratio", ratio("agent_spend", "main_spend"))


def agent_types(turns: DataFrame) -> DataFrame:
    t = with_sums(turns).filter("is_sidechain")
    kind = F.coalesce(F.nullif("agent_type", F.lit("")), F.lit("unlabelled"))
    return t.groupBy(kind.alias("agent_type")).agg(F.countDistinct("session_id").alias("runs"), _sum("spend").alias("spend_tokens"), _sum("usd").alias("cost_usd"))


def tool_stats(turns: DataFrame) -> DataFrame:
    t = annotate(turns).withColumn("tool", F.explode(F.array_distinct("tools")))
    again = F.coalesce(F.array_contains("prev_error_tools", F.col("tool")), F.lit(False))
    s = t.groupBy("tool").agg(F.count("*").alias("turns"), F.count(F.when(F.col("is_error"), 1)).alias("error_turns"), _sum("spend", again).alias("retry_tokens"))
    return s.withColumn("error_rate", ratio("error_turns", "turns"))


def failing_tools(turns: DataFrame) -> DataFrame:
    return tool_stats(turns).filter("error_rate > 0.05 and turns >= 20")


def abandoned_streams(turns: DataFrame, pr_sessions: DataFrame, now: Column) -> DataFrame:
    """Streams that wrote code and never shipped, open or abandoned."""
    return streams(turns, pr_sessions, now).filter("codes and not ships").select("project", "stream", "tokens", "cost_usd", "sessions", F.floor("idle_days").alias("idle_days"), "open")


def deep_analysis(turns: DataFrame, pr_sessions: DataFrame, now: Column) -> DataFrame:
    """The worst few of each list, as (list, rank, item, value); ties go to the smaller item."""
    s = session_stats(turns).filter("not is_sidechain")

    def top(df: DataFrame, name: str, item: str, value: str, n: int) -> DataFrame:
        best = df.select(F.col(item).alias("item"), F.col(value).cast("double").alias("value")).orderBy(F.desc("value"), "item").limit(n)
        return best.select(F.lit(name).alias("list"), "item", "value")

    lists = [
        top(s, "expensive", "session_id", "spend_tokens", 8),
        top(s.filter("fix_iterations >= 2"), "fix_loop", "session_id", "fix_iterations", 8),
        top(s.filter("turns >= 10"), "context_heavy", "session_id", "avg_context", 8),
        top(s.filter("context_growth >= 2"), "bloat", "session_id", "context_growth", 8),
        top(s.filter("cold_tokens > 0"), "cold", "session_id", "cold_tokens", 8),
        top(tool_stats(turns), "tools", "tool", "turns", 15),
        top(fan_out(turns), "fan_out", "root", "agent_spend", 8),
        top(agent_types(turns), "agent_types", "agent_type", "spend_tokens", 10),
        top(abandoned_streams(turns, pr_sessions, now).withColumn("item", F.concat_ws("/", "project", F.regexp_replace("stream", "\\x00", ""))), "streams", "item", "tokens", 10),
    ]
    out = lists[0]
    for other in lists[1:]:
        out = out.unionByName(other)
    return out
