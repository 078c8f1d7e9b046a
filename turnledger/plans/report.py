"""Queries over windows, rules, state, team and billing, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import rules as R
from ..operators import state as St
from ..operators import team as Te
from ..operators import trends as Tr
from .core import METRICS, A, rounded, share, total
from .mapping import DAYS, NOW, now, pr_sessions, sql, turns

QUERIES: dict = {}
ORACLE_SQL: dict = {}
HALF = 15


def add(name: str, query, oracle: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(query(turns(spark, sf_dir)))
    if oracle:
        ORACLE_SQL[name] = sql(oracle)


# --- windows and coverage ---

WIN = f"""win AS (
  SELECT *, CASE WHEN date_diff('microsecond', ts, TIMESTAMP '{NOW}') <= {HALF} * 86400000000 THEN 'current' WHEN date_diff('microsecond', ts, TIMESTAMP '{NOW}') <= {2 * HALF} * 86400000000 THEN 'previous' END AS win FROM t)"""
add("split_windows", lambda t: Tr.split_windows(t, now(), HALF).groupBy("window").agg(F.count("*").alias("turns")), f", {WIN} SELECT win AS window, count(*) AS turns FROM win WHERE win IS NOT NULL GROUP BY 1")
add("filter_window", lambda t: Tr.filter_window(t, now(), HALF).select("event_key", "ts"), f", {WIN} SELECT event_key, ts FROM win WHERE win = 'current'")
add(
    "project_movers",
    lambda t: Tr.project_movers(t, now(), HALF),
    f""", {WIN} SELECT project, {total('spend', "win = 'previous'")} AS prev, {total('spend', "win = 'current'")} AS cur, cur - prev AS delta FROM win GROUP BY 1 HAVING delta <> 0 ORDER BY abs(delta) DESC, project LIMIT 5""",
)
add(
    "trend_comparable",
    lambda t: Tr.trend_comparable(t, now(), HALF),
    f""", {WIN} SELECT count(DISTINCT CAST(ts AS DATE)) FILTER (win = 'current') AS current_days, count(DISTINCT CAST(ts AS DATE)) FILTER (win = 'previous') AS previous_days, previous_days >= current_days * 0.6 AS comparable FROM win""",
)
COVER = f""", d AS (SELECT DISTINCT source, CAST(ts AS DATE) AS day FROM t),
dg AS (SELECT *, date_diff('day', lag(day) OVER (PARTITION BY source ORDER BY day), day) - 1 AS gap FROM d),
cov AS (
  SELECT source, count(*) AS active_days, round(count(*) / {DAYS}.0, 6) AS ratio, CAST(min(day) AS VARCHAR) AS first, CAST(max(day) AS VARCHAR) AS last,
    CAST(greatest(coalesce(max(gap), 0), 0) AS INTEGER) AS largest_gap, CAST(greatest(0, date_diff('day', max(day), DATE '{NOW[:10]}')) AS INTEGER) AS stale_days, min(day) AS fd
  FROM dg GROUP BY 1)
"""
add("source_coverage", lambda t: Tr.source_coverage(t, now(), DAYS), COVER + "SELECT * EXCLUDE (fd) FROM cov")
add(
    "coverage_flags",
    lambda t: Tr.coverage_flags(t, now(), 60, 30),
    COVER.replace(f"{DAYS}.0", "60.0") + f"SELECT source, ratio < 0.6 OR largest_gap >= 3 AS thin, stale_days >= 3 AS stale, source = 'claude-code' AND date_diff('day', fd, DATE '{NOW[:10]}') <= 45 AS retention FROM cov",
)
#: METRICS groups by project; for the two windows the same text groups by the window instead.
TREND_ITEMS = [(label, c, fmt, good, need) for label, c, fmt, good, need in Tr.ROWS]


def _trend_sql() -> str:
    body = METRICS.replace("FROM t ", "FROM tw ").replace("FROM t)", "FROM tw)").replace("project", "win_")
    # Streams keep their project.
    body = body.replace("SELECT win_, coalesce(git_branch, chr(0)", "SELECT win_, project, coalesce(git_branch, chr(0)").replace("WHERE NOT is_sidechain GROUP BY 1, 2, 3),\nsx", "WHERE NOT is_sidechain GROUP BY 1, 2, 3, 4),\nsx")
    body = body.replace("PARTITION BY session_id", "PARTITION BY win_, session_id").replace("SELECT session_id, any_value(win_) AS win_, sum(ctx)", "SELECT session_id, win_, sum(ctx)").replace("main_n >= 8 GROUP BY 1)", "main_n >= 8 GROUP BY 1, 2)")
    head = f""", {WIN}, tw AS (SELECT * EXCLUDE (win), win AS win_ FROM win WHERE win IS NOT NULL)""" + body
    last = head.rindex("\nSELECT base.*")
    rows = " UNION ALL ".join(
        f"SELECT '{label}' AS label, coalesce(max(CASE WHEN win_ = 'previous' THEN {c} END), 0)::DOUBLE AS prev, coalesce(max(CASE WHEN win_ = 'current' THEN {c} END), 0)::DOUBLE AS cur, '{fmt}' AS fmt, {repr(good) if good else 'NULL'} AS good, {f'max({need}) > 0' if need else 'TRUE'} AS has_any FROM mm"
        for label, c, fmt, good, need in TREND_ITEMS
    )
    return (
        head[:last]
        + ", mm AS ("
        + head[last:]
        + f"), r AS ({rows})"
        + """
SELECT label, prev, cur, CASE WHEN (fmt = 'pct' AND abs(cur - prev) < 0.0005) OR (fmt = 'ratio' AND abs(cur - prev) < 0.005) OR abs((cur - prev) / greatest(abs(prev), abs(cur), 1e-9)) < 0.005 THEN 'flat'
  WHEN good IS NULL THEN 'neutral' WHEN (cur > prev) = (good = 'up') THEN 'better' ELSE 'worse' END AS verdict FROM r WHERE has_any"""
    )


add("trend_rows", lambda t: Tr.trend_rows(t, pr_sessions(t), now(), HALF), _trend_sql())

# --- rates and rules, per project ---

RATES = f""", mb AS (SELECT project, t.model, sum(spend) AS tok, sum(usd) AS cost, any_value(premium) AS premium, any_value(priced) AS priced, any_value(estimated) AS est, any_value(p.pi)::DOUBLE AS pi, any_value(p.pr)::DOUBLE AS prr, any_value(p.pw)::DOUBLE AS pw, any_value(p.p1h)::DOUBLE AS p1h
  FROM t LEFT JOIN price p ON t.model = p.model GROUP BY 1, 2 HAVING sum(spend) > 0),
rates AS (
  SELECT project, sum(tok * pi) FILTER (priced) / sum(tok) FILTER (priced) / 1e6 AS rate_input, sum(tok * prr) FILTER (priced) / sum(tok) FILTER (priced) / 1e6 AS rate_cache_read, sum(cost) / sum(tok) AS rate_spend,
    coalesce(sum(cost) FILTER (priced AND premium) / sum(tok) FILTER (priced AND premium), 0) AS rate_premium,
    min(cost / tok) FILTER (priced AND NOT premium AND cost > 0) AS cheapest, coalesce(sum(tok * (p1h - pw)) / sum(tok) FILTER (p1h IS NOT NULL) / 1e6, 0) AS rate_write_1h,
    bool_or(NOT priced OR est) AS est, count(*) AS models
  FROM mb GROUP BY 1),
rr AS (SELECT project, rate_input, rate_cache_read, rate_spend, rate_premium, coalesce(cheapest, rate_premium / 5) AS rate_cheap, rate_write_1h, est OR cheapest IS NULL AS rates_estimated, models FROM rates)
"""


def per_million(df):
    """Rates are USD per token; reported per million tokens."""
    return df.select(*((F.col(c) * 1e6).alias(c) if c.startswith("rate_") else F.col(c) for c in df.columns))


add(
    "blended_rates",
    lambda t: per_million(R.blended_rates(t, ("project",))),
    RATES + "SELECT project, " + ", ".join(f"round({c} * 1e6, 6) AS {c}" for c in ("rate_input", "rate_cache_read", "rate_spend", "rate_premium", "rate_cheap", "rate_write_1h")) + ", rates_estimated FROM rr",
)


def rated(t):
    return R.with_rates(M.compute_metrics(t, pr_sessions(t), now(), ("project",)), t, ("project",))


SIDE = "(cache_read_tokens + input_tokens + cache_creation_tokens)"
DEAR = "greatest(rate_premium - rate_cheap, 0)"
RULE_SQL = [
    ("low-cache-hit", "cache_hit_ratio", "0.8", "caching", "cache_hit_ratio < 0.5 AND spend_tokens > 100000", f"(0.8 - cache_hit_ratio) * {SIDE} * (rate_input - rate_cache_read)"),
    ("high-rework", "rework_ratio", "0.1", "rework", "rework_ratio > 0.2", "(rework_ratio - 0.1) * spend_tokens * rate_spend"),
    ("low-think-code", "think_to_code", "NULL", None, "think_to_code < 0.15 AND coding_activity > 50000", "NULL"),
    ("premium-model-overuse", "premium_share", "0.5", "routing", "premium_share > 0.9 AND models > 1", f"(premium_share - 0.5) * spend_tokens * {DEAR}"),
    ("context-bloat", "bloat_share", "NULL", "caching", "bloat_share >= 0.3 AND trend_sessions >= 3", "avoidable_tokens * (rate_input - rate_cache_read)"),
    ("cold-restarts", "cold_share", "0.05", "caching", "cold_share >= 0.2 AND main_fresh_tokens > 100000", "(cold_share - 0.05) * main_fresh_tokens * (rate_input - rate_cache_read)"),
    ("premium-misroute", "premium_waste_share", "NULL", "routing", "premium_waste_share >= 0.3 AND spend_tokens > 100000", f"premium_waste_tokens * {DEAR}"),
    ("tool-retry-loops", "retry_share", "NULL", "rework", "retry_share >= 0.05", "retry_tokens * rate_spend"),
    ("tool-result-bloat", "carry_share", "0.1", "caching", "measured_turns >= 40 AND carry_share >= 0.25", f"(carry_share - 0.1) * {SIDE} * rate_cache_read"),
    ("context-floor-creep", "floor_share", "0.35", "caching", "floor_sessions >= 5 AND floor_share >= 0.5", "(floor_share - 0.35) * floor_base_tokens * rate_cache_read"),
    ("abandoned-work", "abandoned_share", "0.1", "outcomes", "abandoned_streams >= 2 AND abandoned_share >= 0.25", "(abandoned_share - 0.1) * spend_tokens * rate_spend"),
]
AVOID = """, bs AS (
  SELECT project, session_id, max(n_turns) AS n, bool_or(is_sidechain) AS side, sum(ctx) FILTER (idx <= n_turns // 2) AS e, sum(ctx) FILTER (idx > n_turns - n_turns // 2) AS l,
    sum(fresh) FILTER (idx <= n_turns // 2) AS ef, sum(fresh) FILTER (idx > n_turns - n_turns // 2) AS lf FROM a GROUP BY 1, 2),
av AS (SELECT project, CAST(coalesce(sum(CASE WHEN NOT side AND n >= 8 AND e > 0 AND l / e::DOUBLE >= 2 THEN greatest(0, lf - ef) END), 0) AS BIGINT) AS avoidable_tokens FROM bs GROUP BY 1)
"""
# Exact ratios: the metrics text without its rounding.
RATED = METRICS.replace(", 6) AS think_to_code", ", 15) AS think_to_code").replace("THEN (", "THEN 1.0 * (").replace("ELSE 0 END, 6)", "ELSE 0 END, 15)")
_at = RATED.rindex("\nSELECT base.*")
RATED = RATED[:_at] + ", mm AS (" + RATED[_at:] + ")" + RATES + AVOID + ", rated AS (SELECT mm.*, av.avoidable_tokens, rr.* EXCLUDE (project) FROM mm JOIN av USING (project) JOIN rr USING (project)), fi AS (" + " UNION ALL ".join(
    f"SELECT project, '{k}' AS rule, {repr(f) if f else 'NULL'} AS family, '{m}' AS metric, CAST({m} AS DOUBLE) AS value, CAST({g} AS DOUBLE) AS target, CAST({s} AS DOUBLE) AS savings_usd FROM rated WHERE {w}" for k, m, g, f, w, s in RULE_SQL
) + ")\n"
add("findings", lambda t: R.findings(rated(t), ("project",)), RATED + "SELECT project, rule, family, metric, round(value, 6) AS value, target, round(savings_usd, 8) AS savings_usd FROM fi")
add(
    "rule_savings",
    lambda t: R.rule_savings(rated(t), DAYS, ("project",)),
    RATED + f"SELECT project, rule, family, CASE WHEN savings_usd > 0 THEN round(savings_usd * 30 / {DAYS}, 8) END AS monthly_usd FROM fi",
)
add(
    "potential_bill",
    lambda t: R.potential_bill(rated(t), DAYS, ("project",)),
    RATED + f""", best AS (SELECT project, family, max(savings_usd) * 30 / {DAYS} AS usd FROM fi WHERE family IS NOT NULL AND savings_usd > 0 GROUP BY 1, 2), sv AS (SELECT project, sum(usd) AS saved, count(*) AS families FROM best GROUP BY 1),
    cur AS (SELECT project, sum(usd) FILTER (priced) * 30 / {DAYS} AS cost FROM t GROUP BY 1)
    SELECT project, round(cost, 8) AS current_usd, round(saved, 8) AS saved_usd, families, round(greatest(cost - saved, 0), 8) AS potential_usd FROM cur JOIN sv USING (project)""",
)
PERSONA = """CASE WHEN testing_activity >= 0.2 * spend_tokens AND rework_ratio >= 0.25 THEN 'firefighter' WHEN exploration_activity >= 0.45 * spend_tokens THEN 'explorer'
  WHEN thinking_activity < 0.05 * spend_tokens AND coding_activity >= 0.4 * spend_tokens AND rework_ratio >= 0.15 THEN 'sprinter'
  WHEN cache_hit_ratio >= 0.7 AND rework_ratio < 0.1 AND exploration_activity < 0.25 * spend_tokens THEN 'surgeon' WHEN thinking_activity >= 0.15 * spend_tokens AND rework_ratio < 0.15 THEN 'architect' ELSE 'balanced' END"""
add("personas", lambda t: (m := M.compute_metrics(t, pr_sessions(t), now(), ("project",))).select("project", Te.personas(m).alias("persona")), RATED + f"SELECT project, {PERSONA} AS persona FROM mm")
add(
    "project_breakdown",
    lambda t: (m := M.compute_metrics(t, pr_sessions(t), now(), ("project",))).select("project", "spend_tokens", "cost_usd", Te.personas(m).alias("persona")).orderBy(F.desc("spend_tokens"), "project").limit(15),
    RATED + f"SELECT project, spend_tokens, cost_usd, {PERSONA} AS persona FROM mm ORDER BY spend_tokens DESC, project LIMIT 15",
)

# --- state ---

add(
    "dedup_turns",
    lambda t: St.dedup_turns(t.unionByName(t), t.filter("user_id % 2 = 0")).select("source", "event_key", "session_id"),
    "SELECT DISTINCT source, event_key, session_id FROM t WHERE user_id % 2 <> 0",
)
add(
    "ingest_summary",
    lambda t: St.ingest_summary(t.unionByName(t), t.filter("user_id % 2 = 0")),
    "SELECT source, 2 * count(*) AS scanned, count(*) FILTER (user_id % 2 <> 0) AS new_rows FROM t GROUP BY 1",
)
add(
    "upsert_session_skills",
    lambda t: St.upsert_session_skills(St.session_skills(t.filter("ts < '2024-01-16'")), St.session_skills(t)),
    "SELECT source, session_id, skill, count(*) AS turns, min(ts) AS first_ts, max(ts) AS last_ts FROM t WHERE skill IS NOT NULL GROUP BY 1, 2, 3",
)
add(
    "upsert_session_prs",
    lambda t: (lambda p: St.upsert_session_prs(p, p.withColumn("pr_count", F.col("pr_count") - 1)))(t.filter("not is_sidechain").groupBy("source", "session_id").agg((F.max("user_id") % 3).alias("pr_count"))),
    "SELECT source, session_id, max(user_id) % 3 AS pr_count FROM t WHERE NOT is_sidechain GROUP BY 1, 2 HAVING max(user_id) % 3 > 0",
)
add(
    "record_intents",
    lambda t: (lambda i: St.record_intents(i.filter("label like 'p1%'").withColumn("label", F.lit("kept")), i))(t.groupBy("session_id").agg(F.min("project").alias("label"))),
    "SELECT session_id, CASE WHEN min(project) LIKE 'p1%' THEN 'kept' ELSE min(project) END AS label FROM t GROUP BY 1",
)
add(
    "relabel_sessions",
    lambda t: St.relabel_sessions(t, t.filter("user_id % 5 = 0").select("source", "session_id", F.concat(F.lit("x"), F.col("user_id") % 3).alias("label")).distinct()).groupBy("project", "project_raw").agg(F.count("*").alias("turns")),
    "SELECT CASE WHEN user_id % 5 = 0 THEN 'x' || (user_id % 3) ELSE project END AS project, CASE WHEN user_id % 5 = 0 THEN project END AS project_raw, count(*) AS turns FROM t GROUP BY 1, 2",
)


def _aliases(t):
    """p0 -> p1 -> ... -> p4; p5 <-> p6; p7 -> p5."""
    return t.select("project").distinct().filter("project in ('p0','p1','p2','p3','p5','p6','p7')").select(
        F.col("project").alias("alias"), F.expr("case project when 'p5' then 'p6' when 'p6' then 'p5' when 'p7' then 'p5' else 'p' || (cast(substr(project, 2) as int) + 1) end").alias("target")
    )


ALIAS = """, al AS (SELECT DISTINCT project AS alias, CASE project WHEN 'p5' THEN 'p6' WHEN 'p6' THEN 'p5' WHEN 'p7' THEN 'p5' ELSE 'p' || (CAST(substr(project, 2) AS INTEGER) + 1) END AS target FROM t WHERE project IN ('p0','p1','p2','p3','p5','p6','p7')),
res AS (SELECT alias, CASE WHEN alias IN ('p0','p1','p2','p3') THEN 'p4' WHEN alias = 'p7' THEN 'p5' ELSE alias END AS target FROM al)
"""
add("resolve_alias_chains", lambda t: St.resolve_alias_chains(_aliases(t)), ALIAS + "SELECT alias, target FROM res")
add(
    "apply_project_aliases",
    lambda t: St.apply_project_aliases(t, _aliases(t)).groupBy("project", "project_raw").agg(F.count("*").alias("turns")),
    ALIAS + "SELECT coalesce(target, project) AS project, CASE WHEN target <> project THEN project END AS project_raw, count(*) AS turns FROM t LEFT JOIN res ON alias = project GROUP BY 1, 2",
)
add(
    "sync_intent_projects",
    lambda t: St.sync_intent_projects(t.select("source", "session_id").distinct().withColumn("project", F.when(F.col("session_id").like("u1%"), "p0").otherwise("other")), t),
    "SELECT source, session_id, min(project) AS project FROM t GROUP BY 1, 2",
)

# --- team and billing ---


def by_member(t):
    m = M.compute_metrics(t.withColumn("member", F.concat(F.lit("m"), F.col("user_id") % 8)), pr_sessions(t), now(), ("member",))
    return m


def member_map(t):
    members = t.select((F.col("user_id") % 8).alias("n")).distinct().filter("n < 7")
    names = F.array(F.lit("frontend"), F.lit("backend"), F.lit("data"))
    return members.select(F.concat(F.lit("m"), "n").alias("member"), F.concat(F.lit("t"), F.col("n") % 2).alias("team"), F.element_at(names, (F.col("n") % 3 + 1).cast("int")).alias("discipline"))


MEMBERS = """, me AS (SELECT 'm' || (user_id % 8) AS member, user_id % 8 AS n, * FROM t)
"""
add(
    "team_rollup",
    lambda t: Te.team_rollup(by_member(t), member_map(t), "team").select("team", "members", "events", "spend_tokens", "cost_usd", "conversations", "cache_hit_ratio"),
    MEMBERS + f""", pm AS (SELECT member, n, count(*) AS events, sum(spend) AS spend, round(sum(usd) FILTER (priced), 15) AS usd, count(DISTINCT root) AS conv, sum(cache_read_tokens) AS cr, sum(ctx) AS ctx FROM me GROUP BY 1, 2)
    SELECT CASE WHEN n < 7 THEN 't' || (n % 2) ELSE 'unassigned' END AS team, count(*) AS members, {total('events')} AS events, {total('spend')} AS spend_tokens, round(sum(usd), 8) AS cost_usd, {total('conv')} AS conversations, {share('sum(cr)', 'sum(ctx)')} AS cache_hit_ratio FROM pm GROUP BY 1""",
)
add(
    "merge_metrics",
    lambda t: Te.merge_metrics(by_member(t)).select("members", "events", "spend_tokens", "cost_usd", "error_events", "cache_hit_ratio", "rework_ratio", "shipped_sessions"),
    A + MEMBERS.replace("FROM t", "FROM a") + f""", sp AS (SELECT member, root FROM me GROUP BY 1, 2 HAVING bool_or(activity = 'shipping') OR root IN (SELECT session_id FROM pr))
    SELECT count(DISTINCT member) AS members, count(*) AS events, {total('spend')} AS spend_tokens, round(sum(usd) FILTER (priced), 8) AS cost_usd, count(*) FILTER (is_error) AS error_events, {share('sum(cache_read_tokens)', 'sum(ctx)')} AS cache_hit_ratio,
      {share('sum(spend) FILTER (rework)', 'sum(spend)')} AS rework_ratio, (SELECT count(*) FROM sp) AS shipped_sessions FROM me""",
)


def costs(t):
    m = M.cost_totals(t.withColumn("member", F.concat(F.lit("m"), F.col("user_id") % 8)), ("member",))
    plan = F.element_at(F.array(*map(F.lit, ("pro", "max-5x", "max-20x", "team-standard"))), F.substring("member", 2, 1).cast("int") + 1)
    return m.filter("member < 'm4'").withColumn("plan", plan)


SEATS = MEMBERS + f""", co AS (SELECT member, n, sum(usd) FILTER (priced) * 30 / {DAYS} AS api, bool_or(priced AND estimated) AS est FROM me WHERE n < 4 GROUP BY 1, 2),
se AS (SELECT *, (['pro','max-5x','max-20x','team-standard'])[n + 1] AS plan, ([20.0, 100.0, 200.0, 25.0])[n + 1]::DOUBLE AS seat FROM co)
"""
add(
    "seat_comparison",
    lambda t: Te.seat_comparison(costs(t), DAYS),
    SEATS + """SELECT member, plan, round(api, 8) AS api_usd, seat AS seat_usd, round(api / seat, 6) AS seat_ratio, CASE WHEN api / seat >= 1.5 THEN 'well-used' WHEN api / seat >= 0.8 THEN 'about even' ELSE 'under-used' END AS band, est OR plan = 'max-20x' AS estimated, FALSE AS thin FROM se""",
)
add("team_seat_value", lambda t: Te.team_seat_value(costs(t), DAYS), SEATS + "SELECT count(*) AS seats, round(sum(api), 8) AS api_usd, sum(seat) AS seat_usd, round(sum(api) / sum(seat), 6) AS seat_ratio FROM se")
add(
    "dedupe_exports",
    lambda t: Te.dedupe_exports(t.groupBy(F.concat(F.lit("m"), F.col("user_id") % 8).alias("identity"), "source").agg(F.to_date(F.max("ts")).cast("string").alias("generated_at"), F.min(F.col("event_key").cast("long")).alias("position"))).drop("source"),
    MEMBERS + """, ex AS (SELECT member AS identity, source, CAST(CAST(max(ts) AS DATE) AS VARCHAR) AS generated_at, min(event_id) AS position FROM me GROUP BY 1, 2)
    SELECT identity, generated_at, position, row_number() OVER (PARTITION BY identity ORDER BY generated_at DESC, position) > 1 AS dropped FROM ex""",
)
add(
    "skill_usage",
    lambda t: Te.skill_usage(St.session_skills(t), now(), 7),
    f"SELECT skill, count(*) AS turns, count(DISTINCT session_id) AS sessions, CAST(CAST(min(ts) AS DATE) AS VARCHAR) AS first_day, CAST(CAST(max(ts) AS DATE) AS VARCHAR) AS last_day, date_diff('microsecond', max(ts), TIMESTAMP '{NOW}') > 7 * 86400000000 AS dormant FROM t WHERE skill IS NOT NULL GROUP BY 1",
)
