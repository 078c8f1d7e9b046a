"""Usage metrics of any scope: the whole window (), or per project, session, conversation ...

A scope is a tuple of grouping columns. Turns are annotated once; sessions are aggregated
from them, and scopes from sessions and turns, all with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .annotate import MIN_TREND_TURNS, LONG_TTL_SECONDS, TTL_SECONDS, annotate, halves, with_sums

BLOAT_GROWTH, BLOAT_FRESH_SHARE = 2.0, 0.3
FLOOR_MIN_SESSIONS = 5
ABANDON_IDLE_DAYS = 7


def ratio(a, b) -> Column:
    """a / b, and 0 where b is 0 or null."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(F.coalesce(b, F.lit(0)) != 0, a / b).otherwise(F.lit(0.0))


def _sum(value, when: Column | None = None) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.sum(value if when is None else F.when(when, value)), F.lit(0))


def usage_totals(turns: DataFrame, scope=()) -> DataFrame:
    t = with_sums(turns)
    out = t.groupBy(*scope).agg(
        F.count("*").alias("events"),
        F.countDistinct("root").alias("sessions"),
        *(_sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "thinking_tokens")),
        _sum("spend").alias("spend_tokens"),
        F.count(F.when(F.col("is_error"), 1)).alias("error_events"),
    )
    return out.withColumn("cache_hit_ratio", ratio("cache_read_tokens", F.col("cache_read_tokens") + F.col("input_tokens") + F.col("cache_creation_tokens")))


def cost_totals(turns: DataFrame, scope=()) -> DataFrame:
    t = with_sums(turns)
    return t.groupBy(*scope).agg(
        _sum("usd", F.col("priced")).alias("cost_usd"),
        F.coalesce(F.bool_or(F.col("priced") & F.col("estimated")), F.lit(False)).alias("cost_estimated"),
        _sum("spend", ~F.col("priced")).alias("unpriced_tokens"),
    )


def activity_breakdown(turns: DataFrame, scope=()) -> DataFrame:
    t = with_sums(turns)
    total = t.groupBy(*scope).agg(_sum("spend").alias("total"))
    by = t.groupBy(*scope, F.col("act").alias("activity")).agg(_sum("spend").alias("tokens"), F.count("*").alias("turns"))
    joined = by.join(total, list(scope)) if scope else by.crossJoin(F.broadcast(total))  # one row
    return joined.withColumn("share", ratio("tokens", "total")).drop("total")


def think_to_code(turns: DataFrame, scope=()) -> DataFrame:
    t = with_sums(turns).groupBy(*scope).agg(
        _sum("spend", F.col("act").isin("thinking", "exploration")).alias("thinking_side"), _sum("spend", F.col("act") == "coding").alias("coding_side")
    )
    return t.withColumn("think_to_code", F.col("thinking_side") / F.when(F.col("coding_side") == 0, 1).otherwise(F.col("coding_side")))


def model_breakdown(turns: DataFrame, scope=()) -> DataFrame:
    return with_sums(turns).groupBy(*scope, "model").agg(_sum("spend").alias("tokens"), _sum("usd").alias("cost_usd"), F.first("premium").alias("premium"))


def rework(turns: DataFrame, scope=()) -> DataFrame:
    t = annotate(turns, scope).groupBy(*scope).agg(_sum("spend", F.col("rework")).alias("rework_tokens"), _sum("spend").alias("total"))
    return t.withColumn("rework_ratio", ratio("rework_tokens", "total")).drop("total")


def cache_ttl(turns: DataFrame, scope=()) -> DataFrame:
    """The cache tier of each session's main loop, in seconds."""
    t = annotate(turns, scope).filter("not is_sidechain")
    return t.groupBy(*scope, "session_id").agg(F.first("ttl").alias("ttl_seconds"))


def cold_restarts(turns: DataFrame, scope=()) -> DataFrame:
    t = annotate(turns, scope).groupBy(*scope).agg(
        F.count(F.when(F.col("cold"), 1)).alias("cold_turns"),
        _sum("fresh", F.col("cold")).alias("cold_tokens"),
        _sum("fresh", ~F.col("is_sidechain")).alias("base_tokens"),
    )
    return t.withColumn("cold_share", ratio("cold_tokens", "base_tokens"))


def context_growth(turns: DataFrame, scope=(), main_only: bool = True) -> DataFrame:
    """Per session of at least eight turns: context of the last half against the first, and its fresh share."""
    t = annotate(turns, scope)
    idx, n = (F.col("main_idx"), F.col("main_turns")) if main_only else (F.col("idx"), F.col("n_turns"))
    if main_only:
        t = t.filter("not is_sidechain")
    early, late = halves(idx, n)
    g = t.filter(n >= MIN_TREND_TURNS).groupBy(*scope, "session_id").agg(
        _sum("ctx", early).alias("early"), _sum("ctx", late).alias("late"), _sum("fresh", late).alias("late_fresh")
    )
    return g.filter("early > 0 and late > 0").select(*scope, "session_id", (F.col("late") / F.col("early")).alias("growth"), (F.col("late_fresh") / F.col("late")).alias("late_fresh_share"))


def context_bloat(turns: DataFrame, scope=()) -> DataFrame:
    bloated = (F.col("growth") >= BLOAT_GROWTH) & (F.col("late_fresh_share") >= BLOAT_FRESH_SHARE)
    g = context_growth(turns, scope).groupBy(*scope).agg(F.count("*").alias("trend_sessions"), F.count(F.when(bloated, 1)).alias("bloated_sessions"))
    return g.withColumn("bloat_share", ratio("bloated_sessions", "trend_sessions"))


def premium_waste(turns: DataFrame, scope=()) -> DataFrame:
    t = with_sums(turns).groupBy(*scope).agg(_sum("spend", F.col("premium") & F.col("act").isin("exploration", "conversation")).alias("premium_waste_tokens"), _sum("spend").alias("total"))
    return t.withColumn("premium_waste_share", ratio("premium_waste_tokens", "total")).drop("total")


def retry_spend(turns: DataFrame, scope=()) -> DataFrame:
    t = annotate(turns, scope).groupBy(*scope).agg(_sum("spend", F.col("retry")).alias("retry_tokens"), _sum("spend").alias("total"))
    return t.withColumn("retry_share", ratio("retry_tokens", "total")).drop("total")


def extended_cache(turns: DataFrame, scope=()) -> DataFrame:
    t = annotate(turns, scope).groupBy(*scope).agg(
        _sum("cache_creation_1h_tokens").alias("extended_tokens"),
        _sum("cache_creation_tokens").alias("writes"),
        F.countDistinct(F.when((F.col("ttl") == LONG_TTL_SECONDS), F.col("session_id"))).alias("extended_sessions"),
    )
    return t.withColumn("extended_share", ratio("extended_tokens", "writes")).drop("writes")


def subagent_share(turns: DataFrame, scope=()) -> DataFrame:
    own = F.col("is_sidechain") & ~F.col("session_id").eqNullSafe(F.col("parent_session_id"))
    t = with_sums(turns).groupBy(*scope).agg(
        F.countDistinct(F.when(own, F.col("session_id"))).alias("runs"), _sum("spend", F.col("is_sidechain")).alias("subagent_tokens"), _sum("spend").alias("total")
    )
    return t.withColumn("subagent_share", ratio("subagent_tokens", "total")).drop("total")


def tool_result_totals(turns: DataFrame, scope=()) -> DataFrame:
    return with_sums(turns).groupBy(*scope).agg(_sum("returned").alias("returned_tokens"), F.count(F.when(F.col("chars") > 0, 1)).alias("measured_turns"))


def carried_turns(turns: DataFrame, scope=()) -> DataFrame:
    """Later turns of the session that still carry a turn's results."""
    return annotate(turns, scope).select(*scope, "session_id", "event_key", "carried")


def tool_result_carry(turns: DataFrame, scope=()) -> DataFrame:
    """Tokens carried, never more than the session's own context, and their share of the input side."""
    s = annotate(turns, scope).groupBy(*scope, "session_id").agg(_sum(F.col("returned") * F.col("carried")).alias("carry"), _sum("ctx").alias("ctx"))
    t = s.groupBy(*scope).agg(_sum(F.least("carry", "ctx")).alias("carry_tokens"), _sum("ctx").alias("input_side"))
    return t.withColumn("carry_share", ratio("carry_tokens", "input_side")).drop("input_side")


def session_floor(turns: DataFrame, scope=()) -> DataFrame:
    """The median over main-loop sessions of their smallest context; 0 below five sessions."""
    s = with_sums(turns).filter("not is_sidechain").groupBy(*scope, "session_id").agg(F.min(F.when(F.col("ctx") > 0, F.col("ctx"))).alias("floor"), F.count("*").alias("n"), _sum("ctx").alias("ctx"))
    t = s.groupBy(*scope).agg(F.percentile("floor", 0.5).alias("median"), F.count("floor").alias("floor_sessions"), _sum("n").alias("floor_turns"), _sum("ctx").alias("floor_base_tokens"))
    t = t.withColumn("floor_tokens", F.when(F.col("floor_sessions") >= FLOOR_MIN_SESSIONS, F.col("median")).otherwise(0.0)).drop("median")
    return t.withColumn("floor_share", ratio(F.col("floor_tokens") * F.col("floor_turns"), "floor_base_tokens"))


def shipped_outcomes(turns: DataFrame, pr_sessions: DataFrame, scope=()) -> DataFrame:
    """Conversations that shipped (a shipping turn, or a linked pull request) and what one cost."""
    prs = pr_sessions.select(F.col("session_id").alias("root"), F.lit(True).alias("has_pr")).distinct()
    c = with_sums(turns).groupBy(*scope, "root").agg(F.max(F.col("activity") == "shipping").alias("ships"), _sum("spend").alias("spend"), _sum("usd").alias("usd"))
    c = c.join(prs, "root", "left").withColumn("shipped", F.coalesce("ships", F.lit(False)) | F.coalesce("has_pr", F.lit(False)))
    t = c.groupBy(*scope).agg(
        F.count(F.when(F.col("shipped"), 1)).alias("shipped_sessions"), F.count("*").alias("conversations"), _sum("usd", F.col("shipped")).alias("usd"), _sum("spend", F.col("shipped")).alias("spend")
    )
    return t.select(
        *scope,
        "shipped_sessions",
        "conversations",
        ratio("shipped_sessions", "conversations").alias("shipped_share"),
        ratio("usd", "shipped_sessions").alias("cost_per_shipped"),
        ratio("spend", "shipped_sessions").alias("tokens_per_shipped"),
    )


def streams(turns: DataFrame, pr_sessions: DataFrame, now: Column, scope=()) -> DataFrame:
    """Work streams of the main loop: project and branch, or project and session without a branch."""
    prs = pr_sessions.select("session_id", F.lit(True).alias("has_pr")).distinct()
    t = with_sums(turns).filter("not is_sidechain").join(prs, "session_id", "left")
    stream = F.coalesce(F.nullif("git_branch", F.lit("")), F.concat(F.lit("\0"), F.col("session_id")))
    s = t.groupBy(*dict.fromkeys((*scope, "project")), stream.alias("stream")).agg(
        _sum("spend").alias("tokens"),
        _sum("usd").alias("cost_usd"),
        F.max("ts").alias("last"),
        F.max((F.col("activity") == "shipping") | F.coalesce("has_pr", F.lit(False))).alias("ships"),
        F.max(F.col("activity") == "coding").alias("codes"),
        F.countDistinct("session_id").alias("sessions"),
    )
    idle = (F.unix_micros(now) - F.unix_micros("last")) / 86_400_000_000
    return s.withColumn("idle_days", idle).withColumn("open", F.col("idle_days") < ABANDON_IDLE_DAYS)


def work_streams(turns: DataFrame, pr_sessions: DataFrame, now: Column, scope=()) -> DataFrame:
    s = streams(turns, pr_sessions, now, scope)
    left = F.col("codes") & ~F.col("ships")
    gone, open_ = left & ~F.col("open"), left & F.col("open")
    return s.groupBy(*scope).agg(
        F.count(F.when(gone, 1)).alias("abandoned_streams"), _sum("tokens", gone).alias("abandoned_tokens"), F.count(F.when(open_, 1)).alias("open_streams"), _sum("tokens", open_).alias("open_tokens")
    )


def extended_cache_opportunity(turns: DataFrame, scope=()) -> DataFrame:
    """What the hour-long cache could recover on five-minute sessions, and the writes that would cost more."""
    t = annotate(turns, scope).filter("not is_sidechain").filter(F.col("ttl") == TTL_SECONDS)
    missed = F.coalesce((F.col("main_gap") > TTL_SECONDS) & (F.col("main_gap") <= LONG_TTL_SECONDS), F.lit(False))
    s = t.groupBy(*scope, "session_id").agg(_sum("fresh", missed).alias("recovered"), _sum("cache_creation_tokens").alias("writes"))
    return s.groupBy(*scope).agg(_sum("recovered").alias("recoverable_tokens"), _sum("writes").alias("write_tokens"), F.count(F.when(F.col("recovered") > 0, 1)).alias("recoverable_sessions"))


def compute_metrics(turns: DataFrame, pr_sessions: DataFrame, now: Column, scope=()) -> DataFrame:
    """All metrics of a scope in one row.

    One exchange by session feeds the per-session aggregates; everything else rolls these up.
    Work streams and conversations have other keys and are joined on the scope.
    """
    t = annotate(turns, scope)
    main = ~F.col("is_sidechain")
    early, late = halves(F.col("main_idx"), F.col("main_turns"))
    own_run = F.col("is_sidechain") & ~F.col("session_id").eqNullSafe(F.col("parent_session_id"))
    s = t.groupBy(*scope, "session_id").agg(
        F.count("*").alias("events"),
        *(_sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "cache_creation_1h_tokens", "thinking_tokens", "spend", "ctx")),
        F.count(F.when(F.col("is_error"), 1)).alias("errors"),
        _sum("usd", F.col("priced")).alias("usd"),
        F.bool_or(F.col("priced") & F.col("estimated")).alias("estimated"),
        _sum("spend", ~F.col("priced")).alias("unpriced"),
        *(_sum("spend", F.col("act") == a).alias(f"act_{a}") for a in ("thinking", "exploration", "coding", "testing", "shipping", "conversation")),
        _sum("spend", F.col("rework")).alias("rework"),
        _sum("spend", F.col("retry")).alias("retry"),
        _sum("spend", F.col("premium")).alias("premium"),
        _sum("spend", F.col("premium") & F.col("act").isin("exploration", "conversation")).alias("waste"),
        F.count(F.when(F.col("cold"), 1)).alias("cold_turns"),
        _sum("fresh", F.col("cold")).alias("cold_tokens"),
        _sum("fresh", main).alias("main_fresh"),
        F.max("main_turns").alias("main_turns"),
        F.max(F.when(F.col("ttl") == LONG_TTL_SECONDS, 1).otherwise(0)).alias("long_tier"),
        F.max(F.when(own_run, 1).otherwise(0)).alias("run"),
        _sum("spend", F.col("is_sidechain")).alias("side_spend"),
        _sum("returned").alias("returned"),
        F.count(F.when(F.col("chars") > 0, 1)).alias("measured"),
        _sum(F.col("returned") * F.col("carried")).alias("carry"),
        F.min(F.when(main & (F.col("ctx") > 0), F.col("ctx"))).alias("floor"),
        _sum("ctx", main).alias("main_ctx"),
        _sum("ctx", main & early).alias("early"),
        _sum("ctx", main & late).alias("late"),
        _sum("fresh", main & late).alias("late_fresh"),
    )
    trend = (F.col("main_turns") >= MIN_TREND_TURNS) & (F.col("early") > 0) & (F.col("late") > 0)
    bloated = trend & (F.col("late") / F.col("early") >= BLOAT_GROWTH) & (F.col("late_fresh") / F.col("late") >= BLOAT_FRESH_SHARE)
    m = s.groupBy(*scope).agg(
        *(
            _sum(c).alias(a)
            for c, a in {
                "events": "events", "input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_read_tokens": "cache_read_tokens", "cache_creation_tokens": "cache_creation_tokens",
                "cache_creation_1h_tokens": "extended_cache_tokens", "thinking_tokens": "thinking_tokens", "spend": "spend_tokens", "errors": "error_events", "usd": "cost_usd", "unpriced": "unpriced_tokens",
                "act_thinking": "thinking_activity", "act_exploration": "exploration_activity", "act_coding": "coding_activity", "act_testing": "testing_activity", "act_shipping": "shipping_activity",
                "act_conversation": "conversation_activity", "rework": "rework_tokens", "retry": "retry_tokens", "premium": "premium_tokens", "waste": "premium_waste_tokens", "cold_turns": "cold_restart_turns",
                "cold_tokens": "cold_restart_tokens", "main_fresh": "main_fresh_tokens", "long_tier": "extended_cache_sessions", "run": "subagent_sessions", "side_spend": "subagent_tokens", "returned": "returned_tokens",
                "measured": "measured_turns", "main_turns": "floor_turns", "main_ctx": "floor_base_tokens",
            }.items()
        ),
        F.coalesce(F.bool_or("estimated"), F.lit(False)).alias("cost_estimated"),
        _sum(F.least("carry", "ctx")).alias("carry_tokens"),
        F.count("floor").alias("floor_sessions"),
        F.percentile("floor", 0.5).alias("floor_median"),
        F.count(F.when(trend, 1)).alias("trend_sessions"),
        F.count(F.when(bloated, 1)).alias("bloated_sessions"),
    )
    m = m.withColumn("floor_tokens", F.when(F.col("floor_sessions") >= FLOOR_MIN_SESSIONS, F.col("floor_median")).otherwise(0.0)).drop("floor_median")
    input_side = F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_creation_tokens")
    for other in (shipped_outcomes(turns, pr_sessions, scope), work_streams(turns, pr_sessions, now, scope)):
        m = m.join(other, list(scope), "left") if scope else m.crossJoin(F.broadcast(other))  # one row each
    return m.fillna(0).withColumns(
        {
            "cache_hit_ratio": ratio("cache_read_tokens", input_side),
            "rework_ratio": ratio("rework_tokens", "spend_tokens"),
            "think_to_code": (F.col("thinking_activity") + F.col("exploration_activity")) / F.when(F.col("coding_activity") == 0, 1).otherwise(F.col("coding_activity")),
            "bloat_share": ratio("bloated_sessions", "trend_sessions"),
            "cold_share": ratio("cold_restart_tokens", "main_fresh_tokens"),
            "premium_share": ratio("premium_tokens", "spend_tokens"),
            "premium_waste_share": ratio("premium_waste_tokens", "spend_tokens"),
            "retry_share": ratio("retry_tokens", "spend_tokens"),
            "extended_share": ratio("extended_cache_tokens", "cache_creation_tokens"),
            "subagent_share": ratio("subagent_tokens", "spend_tokens"),
            "carry_share": ratio("carry_tokens", input_side),
            "floor_share": ratio(F.col("floor_tokens") * F.col("floor_turns"), "floor_base_tokens"),
            "abandoned_share": ratio("abandoned_tokens", "spend_tokens"),
        }
    )
