"""Queries of categories, routing, skills, causes and team categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fnv1a_hex
from ..operators import categories as C
from ..operators import metrics as M
from ..operators import rules as R
from ..operators import team as Te
from ..operators.clusters import CAP, cluster_items, cluster_terms
from ..operators.similarity import SIMILAR
from ..tables import stored
from .core import A, rounded, share, total
from .mapping import DAYS, NOW, now, pr_sessions, sql, turns
from .report import AVOID, RATED, RATES
from .texts import PROMPTS, TOKENS

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def add(name: str, query, oracle: str | None, alone: bool = False) -> None:
    """query takes (turns, prompts); alone: the oracle starts with its own tables."""

    def run(spark, sf_dir):
        c = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("role = 'user'")
        return rounded(query(turns(spark, sf_dir), c.select(F.concat(F.lit("c"), "conv_id").alias("session_id"), "text", F.col("turn").cast("long").alias("turn"))))

    QUERIES[name] = run
    if oracle:
        ORACLE_SQL[name] = oracle if alone else sql(oracle)


TASKS = """, ts0 AS (SELECT root, arg_min(source, (ts, event_key)) AS source, arg_min(project, (ts, event_key)) AS project, min(ts) AS date, CAST(sum(spend) AS BIGINT) AS tokens, sum(usd) AS cost, bool_or(estimated) AS estimated FROM t GROUP BY 1),
ac AS (SELECT root, activity, row_number() OVER (PARTITION BY root ORDER BY count(*) DESC, activity) AS r FROM t GROUP BY 1, 2),
tl AS (SELECT root, list_sort(list(DISTINCT tool)) AS tools FROM (SELECT root, unnest(tools) AS tool FROM t) GROUP BY 1),
ts_ AS (SELECT ts0.*, ac.activity, coalesce(tl.tools, []) AS tools FROM ts0 JOIN ac ON ac.root = ts0.root AND r = 1 LEFT JOIN tl ON tl.root = ts0.root)
"""
add(
    "task_sessions",
    lambda t, p: C.task_sessions(t).withColumn("tools", F.array_join("tools", ",")),
    TASKS + "SELECT root, source, project, date, tokens, round(cost, 8) AS cost_usd, estimated, array_to_string(tools, ',') AS tools, activity FROM ts_",
)
add("session_prompts", lambda t, p: C.session_prompts(p.unionByName(p)).groupBy("session_id").agg(F.count("*").alias("prompts")), "SELECT 'c' || conv_id AS session_id, count(DISTINCT text) AS prompts FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY 1", True)


def mixed_sessions(t: DataFrame, p: DataFrame) -> DataFrame:
    """Conversations of turns, which have no prompts, and those of conversations, which have no turns of their own."""
    first = C.task_sessions(t)
    own = p.select(F.col("session_id").alias("root")).distinct()
    n = F.pmod(F.substring("root", 2, 18).cast("long"), F.lit(5))
    made = own.select(
        "root", F.lit("claude-code").alias("source"), F.concat(F.lit("q"), n).alias("project"), F.lit(NOW).cast("timestamp").alias("date"), (n * 1000).alias("tokens"), (n * 0.25).cast("double").alias("cost_usd"), F.lit(False).alias("estimated"),
        F.array(F.lit("Edit")).alias("tools"), F.lit("coding").alias("activity"),
    )
    return first.unionByName(made)


SESSIONS = """ss AS (
  SELECT root, project, tokens, cost, estimated, tools, activity, date FROM ts_
  UNION ALL SELECT root, 'q' || n, n * 1000, n * 0.25::DOUBLE, FALSE, ['Edit'], 'coding', TIMESTAMP '%s' FROM (SELECT DISTINCT 'c' || conv_id AS root, conv_id %% 5 AS n FROM conversations WHERE role = 'user')),
src AS (SELECT 'c' || conv_id AS id, text FROM (SELECT DISTINCT conv_id, text FROM conversations WHERE role = 'user' AND trim(text) <> '')),
""" % NOW
INTENT = f""", {SESSIONS}{TOKENS}, en AS (SELECT id FROM ok GROUP BY 1 HAVING count(*) >= 2),
fb AS (SELECT root, unnest(list_concat([activity], list_filter(list_transform(tools, lambda x: regexp_replace(lower(x), '^mcp__\\S+__', '')), lambda x: length(x) >= 3))) AS term FROM ss WHERE root NOT IN (SELECT id FROM en)),
fr AS (SELECT root, term, row_number() OVER (PARTITION BY root ORDER BY count(*) DESC, term) AS r FROM fb GROUP BY 1, 2),
it AS (SELECT id AS root, terms, TRUE AS has_text FROM fp WHERE id IN (SELECT id FROM en) UNION ALL SELECT root, list(term ORDER BY r), FALSE FROM fr WHERE r <= 8 GROUP BY 1)
"""


def intents(t: DataFrame, p: DataFrame) -> tuple[DataFrame, DataFrame]:
    s = stored(mixed_sessions(t, p))
    return s, stored(C.session_intents(s, C.session_prompts(p)))


add(
    "session_intents",
    lambda t, p: intents(t, p)[1].select("root", F.array_join("terms", " ").alias("terms"), "label", "has_text"),
    TASKS + INTENT + "SELECT root, array_to_string(terms, ' ') AS terms, array_to_string(terms[1:3], ' ') AS label, has_text FROM it",
)


def clustered(t: DataFrame, p: DataFrame):
    s, i = intents(t, p)
    items = i.select(F.col("root").alias("item"), "terms")
    clusters = stored(cluster_items(items))
    return s, i, items, clusters


CLUSTER = INTENT + f""", ex AS (SELECT root AS id, unnest(terms) AS term FROM it),
idf AS (SELECT term, ln(((SELECT count(*) FROM it) + 1) / (count(DISTINCT id) + 1.0::DOUBLE)) + 1 AS idf FROM ex GROUP BY 1),
sets AS (SELECT root AS id, list_sort(terms) AS k, (row_number() OVER (PARTITION BY list_sort(terms) ORDER BY root) - 1) // {CAP} AS chunk FROM it),
nod AS (SELECT min(id) AS node, k, chunk, count(*) AS size FROM sets GROUP BY k, chunk),
nv AS (SELECT id, sqrt(sum(idf * idf)) AS norm FROM ex JOIN idf USING (term) GROUP BY 1),
v AS (SELECT id, term, idf / norm AS w FROM ex JOIN idf USING (term) JOIN nv USING (id) WHERE id IN (SELECT node FROM nod WHERE size < {CAP})),
lk AS (SELECT x.id AS a, y.id AS b, round(sum(x.w * y.w), 12) AS s FROM v x JOIN v y ON x.term = y.term AND x.id < y.id GROUP BY 1, 2 HAVING round(sum(x.w * y.w), 12) >= {SIMILAR}),
-- Links one by one: a list of the nodes' labels, then of the labels' sizes; each link may rewrite it.
num AS (SELECT node, size, row_number() OVER (ORDER BY node) AS i, count(*) OVER () AS n FROM nod),
lst AS (SELECT list_concat([list_concat((SELECT list(i ORDER BY i) FROM num), (SELECT list(size ORDER BY i) FROM num))], coalesce((SELECT list([x.i, y.i, x.n] ORDER BY lk.s DESC, lk.a, lk.b) FROM lk JOIN num x ON x.node = lk.a JOIN num y ON y.node = lk.b), [])) AS steps),
red AS (SELECT list_reduce(steps, lambda acc, e: CASE WHEN acc[e[1]] <> acc[e[2]] AND acc[e[3] + acc[e[1]]] + acc[e[3] + acc[e[2]]] <= {CAP}
  THEN list_transform(acc, lambda x, k: CASE WHEN k <= e[3] AND x = acc[e[2]] THEN acc[e[1]] WHEN k = e[3] + acc[e[1]] THEN x + acc[e[3] + acc[e[2]]] ELSE x END) ELSE acc END) AS labels FROM lst),
lab AS (SELECT node, k, chunk, labels[i] AS label FROM num JOIN nod USING (node), red),
cl AS (SELECT id AS item, min(id) OVER (PARTITION BY label) AS cluster FROM sets JOIN lab USING (k, chunk)),
tt AS (SELECT cluster, term, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, round(sum(idf), 9) DESC, term) AS r FROM ex JOIN cl ON cl.item = ex.id JOIN idf USING (term) GROUP BY 1, 2),
nm AS (SELECT cluster, array_to_string(list(term ORDER BY r) FILTER (r <= 3), ' ') AS name, array_to_string(list(term ORDER BY r), ' ') AS terms FROM tt WHERE r <= 8 GROUP BY 1),
ca AS (SELECT cluster, count(*) AS sessions, count(DISTINCT project) AS projects, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 8) AS cost_usd, bool_or(estimated) AS estimated, bool_or(has_text) AS has_text
  FROM cl JOIN ss ON ss.root = cl.item JOIN it ON it.root = cl.item GROUP BY 1)
"""
WITH_CLUSTERS = sql(TASKS + CLUSTER)
COLUMNS = "cluster, name, sessions, projects, tokens, cost_usd, estimated, has_text"


def category_rows(t, p):
    s, i, _, clusters = clustered(t, p)
    return stored(C.categories(s, i, clusters))


def shown(df):
    return df.select(*COLUMNS.split(", "))


add("cluster_sessions", lambda t, p: clustered(t, p)[3], WITH_CLUSTERS + "SELECT item, cluster FROM cl", True)
add(
    "cluster_terms",
    lambda t, p: (lambda s, i, items, clusters: cluster_terms(items, clusters).select("cluster", "name", F.array_join("terms", " ").alias("terms")))(*clustered(t, p)),
    WITH_CLUSTERS + "SELECT cluster, name, terms FROM nm",
    True,
)
CATEGORY = WITH_CLUSTERS + f"SELECT {COLUMNS} FROM ca JOIN nm USING (cluster)"
add("categories", lambda t, p: shown(category_rows(t, p)), CATEGORY, True)
add("duplicate_work", lambda t, p: shown(C.duplicate_work(category_rows(t, p))), CATEGORY + " WHERE has_text AND sessions >= 2 AND projects >= 2", True)
add("skill_candidates", lambda t, p: shown(C.skill_candidates(category_rows(t, p))), CATEGORY + " WHERE has_text AND sessions >= 2", True)
add("export_categories", lambda t, p: shown(C.export_categories(category_rows(t, p))).agg(F.count("*").alias("n"), F.sum("cost_usd").alias("cost_usd")), WITH_CLUSTERS + ", x AS (SELECT cost_usd FROM ca WHERE has_text ORDER BY cost_usd DESC LIMIT 40) SELECT count(*) AS n, round(sum(cost_usd), 8) AS cost_usd FROM x", True)
add(
    "duplicate_summary",
    lambda t, p: C.duplicate_summary(category_rows(t, p)),
    WITH_CLUSTERS + "SELECT * FROM (SELECT count(*) AS tasks, CAST(sum(sessions) AS BIGINT) AS sessions, round(sum(cost_usd), 8) AS cost_usd, bool_or(estimated) AS estimated FROM ca WHERE has_text AND sessions >= 2 AND projects >= 2) WHERE tasks > 0",
    True,
)

# --- routing and skills: clusters of turns' conversations by project and week ---


def weekly(t: DataFrame) -> DataFrame:
    """A cluster per week of the users with equal remainder by four."""
    root = F.coalesce("parent_session_id", "session_id")
    return t.select(root.alias("item"), F.concat(F.lit("k"), F.regexp_extract(root, r"^u(\d+)", 1).cast("long") % 4, F.lit("-"), F.substring_index(root, "-", -1)).alias("cluster")).distinct()


FACTS = A + f""", fa AS (
  SELECT root, sum(spend) FILTER (premium) / sum(spend)::DOUBLE >= 0.5 AS premium, arg_min(project, (ts, event_key)) AS project, min(ts) AS date, coalesce(sum(spend) FILTER (rework) / nullif(sum(spend), 0)::DOUBLE, 0) AS rework,
    count(*) FILTER (is_error) / count(*)::DOUBLE AS err, {total('spend', 'premium')} AS ptok, coalesce(sum(usd) FILTER (premium), 0) AS pcost FROM a GROUP BY 1)
"""
add(
    "session_facts",
    lambda t, p: C.session_facts(t, pr_sessions(t), now()).drop("date"),
    FACTS + "SELECT root, coalesce(premium, FALSE) AS premium, project, round(rework, 6) AS rework_ratio, round(err, 6) AS error_rate, ptok AS premium_tokens, round(pcost, 8) AS premium_cost_usd FROM fa",
)
OVERALL = RATES.replace("SELECT project, t.model", "SELECT 'all' AS project, t.model")
add(
    "routing_by_category",
    lambda t, p: C.routing_by_category(stored(C.session_facts(t, pr_sessions(t), now())), weekly(t), R.blended_rates(t), DAYS).drop("premium_cost_usd"),
    FACTS + OVERALL + f""", kk AS (SELECT fa.*, coalesce(premium, FALSE) AS pre, 'k' || (CAST(regexp_extract(root, '^u([0-9]+)', 1) AS BIGINT) % 4) || '-' || split_part(root, '-', 2) AS cluster FROM fa),
    sz AS (SELECT cluster, count(*) AS n, count(DISTINCT project) AS np FROM kk GROUP BY 1 HAVING count(*) >= 6),
    pp AS (SELECT cluster, project, min((date, root)) AS seen, count(*) FILTER (pre) AS a, count(*) FILTER (NOT pre) AS b, sum(ptok) FILTER (pre) AS ptok, avg(rework) FILTER (NOT pre) - avg(rework) FILTER (pre) AS dr, avg(err) FILTER (NOT pre) - avg(err) FILTER (pre) AS de FROM kk GROUP BY 1, 2),
    us AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY seen) AS r FROM pp WHERE a >= 2 AND b >= 2)
    SELECT cluster, us.project, a + b AS sessions, a AS premium_sessions, b AS cheap_sessions, CAST(ptok AS BIGINT) AS premium_tokens, round(dr, 6) AS rework_delta, round(de, 6) AS error_delta,
      CASE WHEN dr > 0.05 OR de > 0.05 THEN 'premium-better' WHEN abs(dr) <= 0.05 AND abs(de) <= 0.05 THEN 'no-measurable-gap' ELSE 'cheap-worse-unclear' END AS verdict,
      CASE WHEN abs(dr) <= 0.05 AND abs(de) <= 0.05 THEN round(ptok * greatest(0, rate_premium - rate_cheap) * 30 / {DAYS}, 8) END AS monthly_usd, np > 1 AS project_scoped FROM us JOIN sz USING (cluster), rr WHERE r = 1""",
)
add(
    "skill_tokens",
    lambda t, p: t.select(F.concat(F.lit("Plug:review-"), "project", F.lit("-deploy.helper_"), "source").alias("name")).distinct().select("name", F.array_join(C.skill_tokens(F.col("name")), " ").alias("tokens")),
    "SELECT DISTINCT 'Plug:review-' || project || '-deploy.helper_' || source AS name, 'deploy helper ' || replace(replace(replace(replace(source, '-', ' '), ' code', ''), 'gemini cli', 'gemini'), 'code ', '') AS tokens FROM t",
)


def skill_tables(t: DataFrame):
    """Clusters of sessions by week; skills whose names hold their clusters' terms, used from the middle of the window on."""
    cl = weekly(t)
    week = F.regexp_extract("cluster", r"(\d+)$", 1)
    cats = cl.groupBy("cluster").agg(F.count("*").alias("sessions"), F.sum(F.lit(0.5)).alias("cost_usd")).select("cluster", F.concat(F.lit("Name "), "cluster").alias("name"), F.array(F.concat(F.lit("week"), week), F.lit("deploy")).alias("terms"), "sessions", "cost_usd")
    usage = t.filter("skill is not null").groupBy("skill").agg(F.count("*").alias("turns")).select(F.concat(F.lit("deploy-week"), F.substring("skill", 7, 1)).alias("skill"), "turns", F.lit("2024-01-12").cast("timestamp").alias("first_ts"), (F.col("skill") == "skill-2").alias("dormant"))
    skill_map = cats.filter("cluster like 'k1-%'").select(F.lower("name").alias("name"), F.lit("deploy-week1").alias("skill"))
    dates = cl.join(t.groupBy(F.coalesce("parent_session_id", "session_id").alias("item")).agg(F.min("ts").alias("date")), "item").select("cluster", "date")
    return cats, usage, skill_map, dates


SKILL = """, rt AS (SELECT root, 'k' || (CAST(regexp_extract(root, '^u([0-9]+)', 1) AS BIGINT) % 4) || '-' || split_part(root, '-', 2) AS cluster, min(ts) AS date FROM t GROUP BY 1),
sk AS (SELECT 'deploy-week' || substr(skill, 7, 1) AS skill, skill = 'skill-2' AS dormant FROM t WHERE skill IS NOT NULL GROUP BY skill),
li AS (SELECT DISTINCT cluster, CASE WHEN cluster LIKE 'k1-%' THEN 'deploy-week1' ELSE s.skill END AS skill, CASE WHEN cluster LIKE 'k1-%' THEN 'map' ELSE 'terms' END AS link FROM rt LEFT JOIN sk s ON s.skill = 'deploy-week' || split_part(cluster, '-', 2) WHERE cluster LIKE 'k1-%' OR s.skill IS NOT NULL)
"""
add("skill_links", lambda t, p: (lambda c, u, m, d: C.skill_links(c, u, m))(*skill_tables(t)), SKILL + "SELECT cluster, skill, link FROM li")
add(
    "skill_roi",
    lambda t, p: (lambda c, u, m, d: C.skill_roi(c, C.skill_links(c, u, m), u, d, F.lit("2024-01-01").cast("timestamp"), now()).select("cluster", "skill", "link", "before_per_30", "after_per_30", "status", "realized_usd"))(*skill_tables(t)),
    SKILL + """, ro AS (SELECT cluster, li.skill, link, any_value(dormant) AS dormant, count(*) AS n, count(*) FILTER (date < TIMESTAMP '2024-01-12') AS bf, any_value(cnt) * 0.5 AS cost FROM rt JOIN li USING (cluster) JOIN sk ON sk.skill = li.skill JOIN (SELECT cluster, count(*) AS cnt FROM rt GROUP BY 1) USING (cluster) GROUP BY 1, 2, 3),
    r2 AS (SELECT *, bf / 11.0::DOUBLE * 30 AS b30, (n - bf) / 19.0::DOUBLE * 30 AS a30 FROM ro),
    r3 AS (SELECT *, CASE WHEN bf < 3 THEN 'insufficient-history' WHEN b30 - a30 <= 0 THEN 'no-change' WHEN dormant OR link <> 'map' THEN 'tracking' ELSE 'realized' END AS status FROM r2)
    SELECT cluster, skill, link, round(b30, 6) AS before_per_30, round(a30, 6) AS after_per_30, status, CASE WHEN status = 'realized' THEN round((b30 - a30) * cost / n, 8) END AS realized_usd FROM r3""",
)

# --- causes, evidence, targets ---

add(
    "cache_cause",
    lambda t, p: R.cache_cause(t, ("project",)).drop("dominant"),
    A + """, cs AS (SELECT session_id, bool_or(is_sidechain) AS side, sum(ctx) FILTER (idx <= n_turns // 2) AS e, sum(ctx) FILTER (idx > n_turns - n_turns // 2) AS l, sum(fresh) FILTER (idx > n_turns - n_turns // 2) AS lf FROM a GROUP BY 1),
    bk AS (SELECT project, fresh, CASE WHEN NOT side AND date_diff('microsecond', prev_ts, ts) / 1e6 > ttl THEN 'cold-restarts' WHEN NOT side AND n_turns < 4 THEN 'short-sessions'
      WHEN NOT side AND n_turns >= 8 AND e > 0 AND l > 0 AND l / e::DOUBLE >= 2 AND lf / l::DOUBLE >= 0.3 AND idx > n_turns - n_turns // 2 THEN 'context-churn' ELSE 'steady-state' END AS cause FROM a JOIN cs USING (session_id)),
    bt AS (SELECT project, cause, CAST(sum(fresh) AS BIGINT) AS tokens FROM bk GROUP BY 1, 2)
    SELECT project, cause, tokens, round(tokens / sum(tokens) OVER (PARTITION BY project)::DOUBLE, 6) AS share FROM bt WHERE tokens > 0""",
)
add(
    "rework_cause",
    lambda t, p: R.rework_cause(t, ("project",)).drop("dominant"),
    A + f""", rs AS (SELECT project, session_id, {total('spend', 'rework')} AS tok, coalesce(sum(spend) FILTER (activity = 'testing') / nullif(sum(spend), 0)::DOUBLE, 0) AS ts, count(*) FILTER (is_error) / count(*)::DOUBLE AS er, count(*) FILTER (prev_activity = 'testing' AND activity = 'coding') AS fx FROM a GROUP BY 1, 2),
    rb AS (SELECT project, CASE WHEN ts < 0.02 THEN 'no-test-gate' WHEN er > 0.3 THEN 'broad-failures' WHEN fx >= 3 THEN 'stacked-corrections' ELSE 'other-rework' END AS cause, CAST(sum(tok) AS BIGINT) AS tokens FROM rs WHERE tok > 0 GROUP BY 1, 2)
    SELECT project, cause, tokens, round(tokens / sum(tokens) OVER (PARTITION BY project)::DOUBLE, 6) AS share FROM rb""",
)


def conversations(t: DataFrame) -> DataFrame:
    return stored(R.conversation_metrics(M.compute_metrics(t, pr_sessions(t), now(), ("session_id",)), t))


BY_SESSION = A + f""", cv AS (SELECT session_id, arg_min(project, (ts, event_key)) AS project, {total('spend')} AS spend, {total('input_tokens')} AS inp, {total('spend', 'rework')} AS rework, {total('spend', 'retry')} AS retry, {total('fresh', 'cold')} AS cold, {total('fresh')} AS fresh,
  {total('spend', "premium AND activity IN ('exploration', 'conversation')")} AS waste, sum(cache_read_tokens) AS cr, sum(ctx) AS ctx, CAST(least(sum(returned * carried), sum(ctx)) AS BIGINT) AS carry FROM a WHERE NOT is_sidechain GROUP BY 1)
"""
EVIDENCE = {"low-cache-hit": "inp", "high-rework": "rework", "tool-retry-loops": "retry", "cold-restarts": "cold", "premium-misroute": "waste", "tool-result-bloat": "carry"}
add(
    "rule_evidence",
    lambda t, p: R.rule_evidence(conversations(t), t.sparkSession.createDataFrame([(k,) for k in EVIDENCE], "rule string")),
    BY_SESSION + ", sc AS (" + " UNION ALL ".join(f"SELECT '{k}' AS rule, session_id, project, CAST({v} AS DOUBLE) AS score FROM cv" for k, v in EVIDENCE.items()) + """), ev AS (SELECT *, CAST(row_number() OVER (PARTITION BY rule ORDER BY score DESC, session_id) AS INTEGER) AS place FROM sc WHERE score > 0)
    SELECT rule, session_id, project, score, place FROM ev WHERE place <= 3""",
)
add(
    "rule_targets",
    lambda t, p: R.rule_targets(conversations(t)),
    BY_SESSION + """, q AS (SELECT count(*) AS n, quantile_cont(CASE WHEN ctx > 0 THEN cr / ctx::DOUBLE ELSE 0 END, 0.75) AS hit, quantile_cont(rework / spend::DOUBLE, 0.25) AS rw, quantile_cont(CASE WHEN fresh > 0 THEN cold / fresh::DOUBLE ELSE 0 END, 0.25) AS co, quantile_cont(CASE WHEN ctx > 0 THEN carry / ctx::DOUBLE ELSE 0 END, 0.25) AS ca FROM cv WHERE spend >= 10000)
    SELECT x.rule, round(coalesce(CASE WHEN n >= 8 THEN x.own END, x.fixed), 6) AS target, n >= 8 AND x.own IS NOT NULL AS personal FROM q, LATERAL (VALUES ('low-cache-hit', hit, 0.8), ('high-rework', rw, 0.1), ('cold-restarts', co, 0.05), ('tool-result-bloat', ca, 0.1), ('premium-model-overuse', NULL, 0.5), ('context-floor-creep', NULL, 0.35), ('abandoned-work', NULL, 0.1)) x(rule, own, fixed)""",
)
add(
    "extended_cache_clause",
    # Volumes of the mapped tables are small; days as a fraction bring some projects over a dollar.
    lambda t, p: R.extended_cache_clause(M.extended_cache_opportunity(t, ("project",)), R.blended_rates(t, ("project",)), 0.001, ("project",)),
    A + RATES + """, op AS (SELECT project, session_id, coalesce(sum(fresh) FILTER (main_gap > 300 AND main_gap <= 3600), 0) AS rec, sum(cache_creation_tokens) AS wr FROM a WHERE NOT is_sidechain AND ttl = 300 GROUP BY 1, 2),
    o2 AS (SELECT project, sum(rec) AS rec, sum(wr) AS wr, count(*) FILTER (rec > 0) AS n FROM op GROUP BY 1)
    SELECT project, n AS recoverable_sessions, round((rec * (rate_input - rate_cache_read) - wr * rate_write_1h) * 30 / 0.001, 8) AS net_usd FROM o2 JOIN rr USING (project) WHERE rate_write_1h > 0 AND n > 0 AND (rec * (rate_input - rate_cache_read) - wr * rate_write_1h) * 30 / 0.001 >= 1""",
)


def realized(t: DataFrame) -> DataFrame:
    rated = stored(R.with_rates(M.compute_metrics(t, pr_sessions(t), now(), ("project",)), t, ("project",)))
    items = F.array(*(F.struct(F.lit(m).alias("rule"), F.lit(m).alias("metric"), F.lit(d).alias("direction"), (F.col(m) + (-0.1 if d == "up" else 0.1)).alias("baseline"), F.col(m).alias("current")) for m, d in (("cache_hit_ratio", "up"), ("rework_ratio", "down"), ("cold_share", "down"), ("think_to_code", "up"))))
    return R.realized_savings(rated.select("project", F.explode(items).alias("f")).select("project", "f.*"), rated, DAYS, ("project",))


add(
    "realized_savings",
    lambda t, p: realized(t),
    RATED[: RATED.rindex(", fi AS (")] + f""" SELECT project, rule, rule AS metric, round(now - was, 6) * way AS gain, CASE WHEN usd > 0 THEN round(usd, 8) END AS realized_usd FROM (SELECT project, unnest([
      {{'rule': 'cache_hit_ratio', 'now': cache_hit_ratio, 'was': cache_hit_ratio - 0.1::DOUBLE, 'way': 1, 'usd': 0.1 * (cache_read_tokens + input_tokens + cache_creation_tokens) * (rate_input - rate_cache_read) * 30 / {DAYS}}}, {{'rule': 'rework_ratio', 'now': rework_ratio, 'was': rework_ratio + 0.1::DOUBLE, 'way': -1, 'usd': 0.1 * spend_tokens * rate_spend * 30 / {DAYS}}},
      {{'rule': 'cold_share', 'now': cold_share, 'was': cold_share + 0.1::DOUBLE, 'way': -1, 'usd': 0.1 * main_fresh_tokens * (rate_input - rate_cache_read) * 30 / {DAYS}}}, {{'rule': 'think_to_code', 'now': think_to_code, 'was': think_to_code - 0.1::DOUBLE, 'way': 1, 'usd': NULL}}], recursive := true) FROM rated)""",
)

# --- team ---


def member_categories(t: DataFrame) -> DataFrame:
    """Categories of eight members, one per project of theirs; some repeat an id, one is not usable."""
    m = F.concat(F.lit("m"), F.col("user_id") % 8)
    c = t.groupBy(m.alias("identity"), "project").agg(F.countDistinct("session_id").alias("sessions"), F.sum("input_tokens").alias("tokens"))
    n = F.substring("project", 2, 4).cast("long")
    words = F.array(F.concat(F.lit("work"), n % 5), F.concat(F.lit("deploy"), n % 5), F.lit("common"))
    return c.select(
        "identity", F.concat(F.lit("name-"), "identity").alias("name"), (F.col("identity") == "m0").alias("unsigned"), fnv1a_hex(F.concat(F.lit("p"), n % 3)).alias("id"), F.when(n == 7, F.array().cast("array<string>")).otherwise(words).alias("terms"),
        "sessions", "tokens", (F.col("sessions") * 0.5).alias("cost_usd"), (n % 2 == 0).alias("estimated"), (n % 4 == 0).alias("duplicate"),
    )


def merged(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    usable = stored(Te.usable_categories(member_categories(t)))
    return usable, Te.merge_categories(usable, stored(cluster_items(usable.select("item", "terms"), 0.5, None)))


MC = """, mc AS (SELECT 'm' || (user_id % 8) AS identity, project, CAST(substr(project, 2) AS BIGINT) AS n, count(DISTINCT session_id) AS sessions, sum(input_tokens) AS tokens FROM t GROUP BY 1, 2),
us AS (SELECT * FROM mc WHERE n <> 7),
mg AS (SELECT n % 5 AS g, count(DISTINCT identity) AS members, count(DISTINCT identity) AS users, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(sessions) * 0.5, 8) AS cost_usd, bool_or(n % 2 = 0) AS estimated FROM us GROUP BY 1),
mm2 AS (SELECT *, members >= 2 AS cross_user, sessions * members AS score FROM mg)
"""
MERGED = "members, users, sessions, tokens, cost_usd, estimated, cross_user, score"
for _name, _query, _where in (("merge_categories", lambda m: m, ""), ("cross_user_duplicates", Te.cross_user_duplicates, " WHERE cross_user AND sessions >= 2"), ("org_skill_candidates", Te.org_skill_candidates, " WHERE sessions >= 2")):
    add(_name, lambda t, p, q=_query: q(merged(t)[1]).select(*MERGED.split(", ")), MC + f"SELECT {MERGED} FROM mm2{_where}")
add(
    "within_member_dups",
    lambda t, p: Te.within_member_dups(Te.usable_categories(member_categories(t))),
    MC + """, wd AS (SELECT identity, coalesce(sum(sessions * 0.5) FILTER (n % 4 = 0), 0) AS dup, identity = 'm0' AS unsigned FROM us GROUP BY 1)
    SELECT count(*) AS with_categories, round(sum(dup), 8)::DOUBLE AS dup_cost_usd, count(*) FILTER (dup > 0) AS dup_members, bool_or(unsigned) AS any_unsigned FROM wd""",
)


def exports(t: DataFrame) -> DataFrame:
    n = F.col("user_id") % 8
    return t.select(F.concat(F.lit("m"), n).alias("user"), F.lit("host").alias("host"), F.when(n < 6, F.concat(F.lit("key"), n)).alias("fingerprint")).distinct()


def keyring(t: DataFrame) -> DataFrame:
    n = F.col("user_id") % 8
    return t.filter(n < 4).select(F.concat(F.lit("m"), n).alias("user"), F.concat(F.lit("key"), F.when(n == 3, 4).otherwise(n)).alias("fingerprint")).distinct()


EX = ", ex AS (SELECT DISTINCT 'm' || (user_id % 8) AS \"user\", user_id % 8 AS n FROM t)"
add(
    "export_identity",
    lambda t, p: Te.export_identity(exports(t), keyring(t)).select("user", "identity", "unsigned", "name"),
    EX + " SELECT \"user\", CASE WHEN n < 6 THEN 'key' || n ELSE \"user\" || '@host' END AS identity, n >= 6 AS unsigned, CASE WHEN n = 4 AND EXISTS (SELECT 1 FROM ex WHERE n = 3) THEN 'm3' ELSE \"user\" END AS name FROM ex",
)
add("keyring_check", lambda t, p: Te.keyring_check(exports(t), keyring(t)), EX + " SELECT \"user\", 'key' || n AS fingerprint, CASE WHEN n > 3 THEN 'not-enrolled' WHEN n = 3 THEN 'mismatch' ELSE 'ok' END AS verdict FROM ex WHERE n < 6")


def coverage(t: DataFrame) -> DataFrame:
    last = t.filter("ts < '2024-01-29'").groupBy(F.concat(F.lit("m"), F.col("user_id") % 8).alias("name"), "source").agg(F.max("ts").alias("last"))
    return last.select("name", "source", F.datediff(F.lit(NOW[:10]), F.to_date("last")).alias("stale_days"))


add(
    "stale_members",
    lambda t, p: Te.stale_members(coverage(t)),
    f", cv AS (SELECT 'm' || (user_id % 8) AS name, source, CAST(date_diff('day', max(CAST(ts AS DATE)), DATE '{NOW[:10]}') AS INTEGER) AS stale_days FROM t WHERE ts < TIMESTAMP '2024-01-29' GROUP BY 1, 2) SELECT * FROM cv WHERE stale_days >= 3",
)
