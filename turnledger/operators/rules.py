"""Rates, waste rules, personas and what fixing a finding would save."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pricing import model_prices
from .annotate import MIN_TREND_TURNS, annotate, halves
from .metrics import BLOAT_FRESH_SHARE, BLOAT_GROWTH, _sum, model_breakdown, ratio


@dataclass(frozen=True)
class Rule:
    """A predicate over a row of compute_metrics(), and its saving over the window in USD, as SQL expressions."""

    key: str
    metric: str
    direction: str
    fires: str
    target: float | None = None
    family: str | None = None
    savings: str | None = None
    score: str | None = None  # over a conversation's metrics; the higher, the worse
    personal: str | None = None  # the metric whose best quartile of own conversations is the target


RULES: dict[str, Rule] = {}


def register_rule(rule: Rule) -> None:
    if rule.key in RULES:
        raise ValueError(f"rule {rule.key} exists")
    RULES[rule.key] = rule


_SIDE = "(cache_read_tokens + input_tokens + cache_creation_tokens)"
_FRESH = "(rate_input - rate_cache_read)"
_DEAR = "greatest(rate_premium - rate_cheap, 0.0D)"

# The rules' names, thresholds, targets and families.
for _rule in (
    Rule("low-cache-hit", "cache_hit_ratio", "up", "cache_hit_ratio < 0.5D and spend_tokens > 100000", 0.8, "caching", f"(0.8D - cache_hit_ratio) * {_SIDE} * {_FRESH}", score="input_tokens", personal="cache_hit_ratio"),
    Rule("high-rework", "rework_ratio", "down", "rework_ratio > 0.2D", 0.1, "rework", "(rework_ratio - 0.1D) * spend_tokens * rate_spend", score="rework_tokens", personal="rework_ratio"),
    Rule("low-think-code", "think_to_code", "up", "think_to_code < 0.15D and coding_activity > 50000", score="case when think_to_code < 0.15D then coding_activity else 0 end"),
    Rule("premium-model-overuse", "premium_share", "down", "premium_share > 0.9D and models > 1", 0.5, "routing", f"(premium_share - 0.5D) * spend_tokens * {_DEAR}", score="premium_tokens"),
    Rule("context-bloat", "bloat_share", "down", "bloat_share >= 0.3D and trend_sessions >= 3", None, "caching", f"avoidable_tokens * {_FRESH}", score="avoidable_tokens"),
    Rule("cold-restarts", "cold_share", "down", "cold_share >= 0.2D and main_fresh_tokens > 100000", 0.05, "caching", f"(cold_share - 0.05D) * main_fresh_tokens * {_FRESH}", score="cold_restart_tokens", personal="cold_share"),
    Rule("premium-misroute", "premium_waste_share", "down", "premium_waste_share >= 0.3D and spend_tokens > 100000", None, "routing", f"premium_waste_tokens * {_DEAR}", score="premium_waste_tokens"),
    Rule("tool-retry-loops", "retry_share", "down", "retry_share >= 0.05D", None, "rework", "retry_tokens * rate_spend", score="retry_tokens"),
    Rule("tool-result-bloat", "carry_share", "down", "measured_turns >= 40 and carry_share >= 0.25D", 0.1, "caching", f"(carry_share - 0.1D) * {_SIDE} * rate_cache_read", score="carry_tokens", personal="carry_share"),
    Rule("context-floor-creep", "floor_share", "down", "floor_sessions >= 5 and floor_share >= 0.5D", 0.35, "caching", "(floor_share - 0.35D) * floor_base_tokens * rate_cache_read", score="first_ctx * floor_turns"),
    Rule("abandoned-work", "abandoned_share", "down", "abandoned_streams >= 2 and abandoned_share >= 0.25D", 0.1, "outcomes", "(abandoned_share - 0.1D) * spend_tokens * rate_spend", score="abandoned_tokens"),
):
    register_rule(_rule)


def blended_rates(turns: DataFrame, scope=()) -> DataFrame:
    """USD per token: input and cache read weighted by tokens, realised spend, premium and cheapest other model."""
    m = model_breakdown(turns, scope).filter("tokens > 0").join(F.broadcast(model_prices(turns)), "model", "left")  # one row per model
    priced = F.col("p_input").isNotNull()
    rate = F.col("cost_usd") / F.col("tokens")
    r = m.groupBy(*scope).agg(
        _sum("tokens").alias("all_tokens"),
        _sum("tokens", priced).alias("w"),
        _sum(F.col("tokens") * F.col("p_input"), priced).alias("wi"),
        _sum(F.col("tokens") * F.col("p_cache_read"), priced).alias("wr"),
        _sum(F.col("tokens") * (F.col("p_cache_write_1h") - F.col("p_cache_write"))).alias("w1h"),
        _sum("tokens", F.col("p_cache_write_1h").isNotNull()).alias("n1h"),
        _sum("cost_usd").alias("cost"),
        _sum("cost_usd", priced & F.col("premium")).alias("pc"),
        _sum("tokens", priced & F.col("premium")).alias("pt"),
        F.min(F.when(priced & ~F.col("premium") & (F.col("cost_usd") > 0), rate)).alias("cheapest"),
        F.max(~priced | F.coalesce("estimated", F.lit(False))).alias("estimated"),
    )
    premium = ratio("pc", "pt")
    return r.select(
        *scope,
        ratio("wi", F.col("w") * 1e6).alias("rate_input"),
        ratio("wr", F.col("w") * 1e6).alias("rate_cache_read"),
        ratio("cost", "all_tokens").alias("rate_spend"),
        premium.alias("rate_premium"),
        F.coalesce("cheapest", premium / 5).alias("rate_cheap"),
        ratio("w1h", F.col("n1h") * 1e6).alias("rate_write_1h"),
        (F.col("estimated") | F.col("cheapest").isNull()).alias("rates_estimated"),
    )


def bloat_avoidable(turns: DataFrame, scope=()) -> DataFrame:
    """scope, avoidable_tokens: what the late halves of growing sessions pay anew beyond their early halves."""
    early, late = halves(F.col("idx"), F.col("n_turns"))
    s = annotate(turns, scope).groupBy(*scope, "session_id").agg(
        F.max("n_turns").alias("n"), F.max("is_sidechain").alias("side"), _sum("ctx", early).alias("early"), _sum("ctx", late).alias("late"), _sum("fresh", early).alias("early_fresh"), _sum("fresh", late).alias("late_fresh")
    )
    grows = ~F.col("side") & (F.col("n") >= MIN_TREND_TURNS) & (F.col("early") > 0) & (F.col("late") / F.col("early") >= BLOAT_GROWTH)
    return s.groupBy(*scope).agg(_sum(F.greatest(F.lit(0), F.col("late_fresh") - F.col("early_fresh")), grows).alias("avoidable_tokens"))


def with_rates(metrics: DataFrame, turns: DataFrame, scope=()) -> DataFrame:
    """Metrics rows with the number of models, the avoidable tokens and the blended rates of the same scope."""
    models = turns.groupBy(*scope).agg(F.countDistinct("model").alias("models"))
    rates, avoidable = blended_rates(turns, scope), bloat_avoidable(turns, scope)
    if scope:
        return metrics.join(models, list(scope)).join(avoidable, list(scope)).join(rates, list(scope))
    return metrics.crossJoin(F.broadcast(models)).crossJoin(F.broadcast(avoidable)).crossJoin(F.broadcast(rates))  # one row each


def findings(rated: DataFrame, scope=()) -> DataFrame:
    """One row per scope and rule that fires: rule, family, metric, value, target."""
    items = F.array(
        *(
            F.struct(
                F.lit(r.key).alias("rule"), F.lit(r.family).cast("string").alias("family"), F.lit(r.metric).alias("metric"), F.col(r.metric).cast("double").alias("value"), F.lit(r.target).cast("double").alias("target"),
                F.coalesce(F.expr(r.fires), F.lit(False)).alias("fires"), F.expr(r.savings or "null").cast("double").alias("savings_usd"),
            )
            for r in RULES.values()
        )
    )
    return rated.select(*scope, F.explode(items).alias("f")).select(*scope, "f.*").filter("fires").drop("fires")


def rule_savings(rated: DataFrame, days: int, scope=()) -> DataFrame:
    """Monthly savings of the rules that fire; a rule without a positive amount keeps null."""
    f = findings(rated, scope)
    return f.select(*scope, "rule", "family", F.when(F.col("savings_usd") > 0, F.col("savings_usd") * (30 / days if days > 0 else 1)).alias("monthly_usd"))


def potential_bill(rated: DataFrame, days: int, scope=()) -> DataFrame:
    """Current and potential monthly bill: the best rule of each family, families added."""
    monthly = 30 / days if days > 0 else 1.0
    best = rule_savings(rated, days, scope).filter("family is not null and monthly_usd is not null").groupBy(*scope, "family").agg(F.max("monthly_usd").alias("usd"))
    saved = best.groupBy(*scope).agg(F.sum("usd").alias("saved_usd"), F.count("*").alias("families"))
    now_ = rated.select(*scope, (F.col("cost_usd") * monthly).alias("current_usd"))
    out = now_.join(saved, list(scope)) if scope else now_.crossJoin(F.broadcast(saved))  # one row
    return out.withColumn("potential_usd", F.greatest(F.col("current_usd") - F.col("saved_usd"), F.lit(0.0)))


EVIDENCE = 3
PERSONAL_SESSIONS, PERSONAL_SPEND = 8, 10_000
BASELINES, DOMINANT = ("steady-state", "other-rework"), 0.15
SHORT_SESSION = 4
#: What a full point of a metric is worth over the window, in USD. Metrics without an entry have no price.
POINT_VALUE = {
    "cache_hit_ratio": f"{_SIDE} * {_FRESH}", "rework_ratio": "spend_tokens * rate_spend", "retry_share": "spend_tokens * rate_spend", "premium_share": f"spend_tokens * {_DEAR}",
    "premium_waste_share": f"spend_tokens * {_DEAR}", "cold_share": f"main_fresh_tokens * {_FRESH}", "carry_share": f"{_SIDE} * rate_cache_read", "floor_share": "floor_base_tokens * rate_cache_read",
    "abandoned_share": "spend_tokens * rate_spend",
}


def conversation_metrics(metrics: DataFrame, turns: DataFrame) -> DataFrame:
    """Rows of compute_metrics() by session with what scores need beside; conversations only."""
    t = annotate(turns).groupBy("session_id").agg(F.max("is_sidechain").alias("side"), F.min_by("project", F.struct("ts", "event_key")).alias("project"), F.min_by("ctx", F.when(~F.col("is_sidechain"), F.struct("ts", "event_key"))).alias("first_ctx"))
    return metrics.join(t.filter("not side").drop("side"), "session_id").join(bloat_avoidable(turns, ("session_id",)), "session_id")


def rule_evidence(conversations: DataFrame, fired: DataFrame, most: int = EVIDENCE) -> DataFrame:
    """The worst conversations of each rule of fired (rule): rule, place, session_id, project, score."""
    scores = F.array(*(F.struct(F.lit(r.key).alias("rule"), F.expr(r.score).cast("double").alias("score")) for r in RULES.values() if r.score))
    s = conversations.select("session_id", "project", F.explode(scores).alias("s")).select("session_id", "project", "s.*").filter("score > 0").join(fired.select("rule").distinct(), "rule", "left_semi")
    w = Window.partitionBy("rule").orderBy(F.desc("score"), "session_id")
    return s.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def rule_targets(conversations: DataFrame) -> DataFrame:
    """(rule, target, personal): the best quartile of own conversations of some size, where there are enough; else the fixed one."""
    own = [r for r in RULES.values() if r.personal]
    c = conversations.filter(F.col("spend_tokens") >= PERSONAL_SPEND)
    row = c.agg(F.count("*").alias("n"), *(F.percentile(r.personal, 0.75 if r.direction == "up" else 0.25).alias(r.metric) for r in own))
    rows = F.array(
        *(
            F.struct(F.lit(r.key).alias("rule"), (F.when(F.col("n") >= PERSONAL_SESSIONS, F.col(r.metric)) if r.personal else F.lit(None)).cast("double").alias("own"), F.lit(r.target).cast("double").alias("fixed"))
            for r in RULES.values()
            if r.personal or r.target is not None
        )
    )
    return row.select(F.explode(rows).alias("t")).select("t.rule", F.coalesce("t.own", "t.fixed").alias("target"), F.col("t.own").isNotNull().alias("personal"))


def extended_cache_clause(opportunity: DataFrame, rates: DataFrame, days: int, scope=()) -> DataFrame:
    """What the hour-long cache would save a month after its dearer writes; only where that is a dollar or more."""
    j = opportunity.join(rates, list(scope)) if scope else opportunity.crossJoin(F.broadcast(rates))  # one row
    net = F.col("recoverable_tokens") * (F.col("rate_input") - F.col("rate_cache_read")) - F.col("write_tokens") * F.col("rate_write_1h")
    j = j.filter("rate_write_1h > 0 and recoverable_sessions > 0").withColumn("net_usd", net * (30 / days if days > 0 else 1))
    return j.filter("net_usd >= 1").select(*scope, "recoverable_sessions", "net_usd")


def realized_savings(follow: DataFrame, rated: DataFrame, days: int, scope=()) -> DataFrame:
    """What improvements of tracked findings are worth a month: follow has (scope, rule, metric, direction, baseline, current)."""
    j = follow.join(rated, list(scope)) if scope else follow.crossJoin(F.broadcast(rated))  # one row
    gain = F.when(F.col("direction") == "up", F.col("current") - F.col("baseline")).otherwise(F.col("baseline") - F.col("current"))
    worth = F.lit(None).cast("double")
    for metric, value in POINT_VALUE.items():
        worth = F.when(F.col("metric") == metric, F.expr(value)).otherwise(worth)
    usd = F.when(gain > 0.02, gain * worth * (30 / days if days > 0 else 1))
    return j.select(*scope, "rule", "metric", gain.alias("gain"), F.when(usd > 0, usd).alias("realized_usd"))


def _causes(buckets: DataFrame, scope) -> DataFrame:
    """Shares of (scope, cause, tokens), and whether a cause is the dominant one that can be acted on."""
    total = buckets.groupBy(*scope).agg(_sum("tokens").alias("_all"))
    b = buckets.join(total, list(scope)) if scope else buckets.crossJoin(F.broadcast(total))  # one row
    b = b.filter("tokens > 0").withColumn("share", ratio("tokens", "_all")).drop("_all")
    named = ~F.col("cause").isin(*BASELINES) & (F.col("share") >= DOMINANT)
    w = Window.partitionBy(*scope, named).orderBy(F.desc("share"), "cause")  # at most four rows of each scope
    return b.withColumn("dominant", named & (F.row_number().over(w) == 1))


def cache_cause(turns: DataFrame, scope=()) -> DataFrame:
    """Where fresh input went: cold restarts, sessions too short, growth paid anew late in a session, or the steady rest."""
    w = Window.partitionBy(*scope, "session_id")
    early, late = halves(F.col("idx"), F.col("n_turns"))
    t = annotate(turns, scope).withColumns(
        {
            "side": F.max("is_sidechain").over(w),
            "c_early": F.sum(F.when(early, F.col("ctx"))).over(w),
            "c_late": F.sum(F.when(late, F.col("ctx"))).over(w),
            "f_late": F.sum(F.when(late, F.col("fresh"))).over(w),
        }
    )
    gap = (F.unix_micros("ts") - F.unix_micros("prev_ts")) / 1e6
    grows = (F.col("n_turns") >= MIN_TREND_TURNS) & (F.col("c_early") > 0) & (F.col("c_late") > 0) & (F.col("c_late") / F.col("c_early") >= BLOAT_GROWTH) & (F.col("f_late") / F.col("c_late") >= BLOAT_FRESH_SHARE)
    cause = F.when(~F.col("side") & F.coalesce(gap > F.col("ttl"), F.lit(False)), "cold-restarts").when(~F.col("side") & (F.col("n_turns") < SHORT_SESSION), "short-sessions")
    cause = cause.when(~F.col("side") & F.coalesce(grows, F.lit(False)) & late, "context-churn").otherwise("steady-state")
    return _causes(t.groupBy(*scope, cause.alias("cause")).agg(_sum("fresh").alias("tokens")), scope)


def rework_cause(turns: DataFrame, scope=()) -> DataFrame:
    """Rework by what the session looks like: no tests, broad failures, stacked corrections, or none of these."""
    s = annotate(turns, scope).groupBy(*scope, "session_id").agg(
        _sum("spend", F.col("rework")).alias("tokens"),
        _sum("spend").alias("spend"),
        _sum("spend", F.col("activity") == "testing").alias("testing"),
        F.count("*").alias("n"),
        F.count(F.when(F.col("is_error"), 1)).alias("errors"),
        F.count(F.when((F.col("prev_activity") == "testing") & (F.col("activity") == "coding"), 1)).alias("fixes"),
    )
    cause: Column = F.when(ratio("testing", "spend") < 0.02, "no-test-gate").when(F.col("errors") / F.col("n") > 0.3, "broad-failures").when(F.col("fixes") >= 3, "stacked-corrections").otherwise("other-rework")
    return _causes(s.filter("tokens > 0").groupBy(*scope, cause.alias("cause")).agg(_sum("tokens").alias("tokens")), scope)
