"""Queries of what leaves the machine or comes back: anonymised sessions, payloads, models' answers, bills."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import responses as Re
from ..operators import anonymize as N
from ..operators import payload as P
from ..operators import team as Te
from ..sources import billing as B
from ..sources import bundles as Bu
from ..sources.claude import claude_turns
from ..tables import let_go, shared_dir, stored
from .core import rounded, share, total
from .mapping import DAYS, now, pr_sessions, sql, turns

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def add(name: str, query, oracle: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(query(turns(spark, sf_dir)))
    ORACLE_SQL[name] = sql(oracle)


# --- anonymised sessions ---

SHARED = "session_id, ts, model, tools, activity, parent_session_id, agent_type, input_tokens, cache_creation_1h_tokens, is_error"
ANONYMOUS = """, fa AS (SELECT root, min(ts) AS start, row_number() OVER (ORDER BY min(ts), root) AS family FROM t GROUP BY root),
ru AS (SELECT root, session_id AS sid, row_number() OVER (PARTITION BY root ORDER BY min((ts, event_key)), session_id) AS run FROM t WHERE is_sidechain GROUP BY 1, 2),
an AS (SELECT t.* REPLACE (TIMESTAMP '2026-01-01 09:00:00' + (ts - start) AS ts), family, coalesce(run, 0) AS run, row_number() OVER (PARTITION BY t.root, coalesce(run, 0) ORDER BY t.ts, event_key) - 1 AS nth
  FROM t JOIN fa ON fa.root = t.root LEFT JOIN ru ON is_sidechain AND ru.root = t.root AND ru.sid = t.session_id)
"""
add(
    "anonymize_sessions",
    lambda t: N.anonymize_sessions(t).withColumn("tools", F.array_join("tools", ",")).select("event_key", *SHARED.split(", "), "project", "git_branch"),
    ANONYMOUS + """SELECT CASE WHEN run > 0 THEN family || '-' || run ELSE 'session-' || family END || '-t' || nth AS event_key, CASE WHEN run > 0 THEN family || '-' || run ELSE 'session-' || family END AS session_id, ts, model,
      array_to_string(list_transform(tools, lambda x: CASE WHEN x LIKE 'mcp%' THEN 'mcp__server-1__tool-1' ELSE x END), ',') AS tools, activity, CASE WHEN run > 0 THEN 'session-' || family END AS parent_session_id,
      CASE WHEN run > 0 AND agent_type IS NOT NULL THEN 'general-purpose' END AS agent_type, input_tokens, cache_creation_1h_tokens, is_error, 'project-1' AS project, 'main' AS git_branch FROM an""",
)


def given_away(t: DataFrame) -> DataFrame:
    """Anonymised turns written in bundles and parsed again."""
    spark = t.sparkSession
    path, held = shared_dir(spark), shared_dir(spark)
    # A table: bundles are measured, cut and written, and each would render all lines anew.
    lines = stored(N.anonymized_lines(N.anonymize_sessions(t)), held, compression="zstd")
    let_go(spark)
    Bu.write_bundles(lines, path)
    let_go(spark, held)
    turns = claude_turns(Bu.read_bundles(spark, path))
    let_go(spark)
    return turns


add(
    "write_anonymized_sessions",
    lambda t: given_away(t).groupBy("session_id", "parent_session_id", "model", "activity").agg(
        F.count("*").alias("turns"), *(F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")), F.count(F.when(F.col("is_error"), 1)).alias("errors"), F.max("ts").alias("last"),
        F.sum(F.aggregate(F.coalesce(F.map_values("tool_result_chars"), F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, x: a + x)).alias("chars"),
    ),
    ANONYMOUS + f"""SELECT CASE WHEN run > 0 THEN family || '-' || run ELSE 'session-' || family END AS session_id, CASE WHEN run > 0 THEN 'session-' || family END AS parent_session_id, model, activity, count(*) AS turns, {total('input_tokens')} AS input_tokens, {total('output_tokens')} AS output_tokens,
      {total('cache_read_tokens')} AS cache_read_tokens, {total('cache_creation_tokens')} AS cache_creation_tokens, count(*) FILTER (is_error) AS errors, max(ts) AS last, CAST(coalesce(sum(result_chars), 0) AS BIGINT) AS chars
    FROM an WHERE spend + cache_read_tokens + cache_creation_tokens <> 0 GROUP BY ALL""",
)

# --- payload ---

PAYLOAD = "overall struct<turns: bigint, spendTokens: bigint, costUsd: double, cacheHitRatio: double, models: map<string, struct<tokens: bigint>>>, projects array<struct<project: string, spendTokens: bigint>>, expensiveSessions array<struct<spendTokens: bigint, turns: bigint>>, toolErrorRates array<struct<tool: string, turns: bigint, errorRate: double>>"


def payload(t: DataFrame) -> DataFrame:
    # A table: the document's parts read turns many times, each of which would map the events anew.
    t = stored(t)
    d = P.aggregate_payload(t, pr_sessions(t), now(), DAYS).select(F.from_json("doc", PAYLOAD).alias("d")).select("d.*")
    listed = lambda c, f: F.array_join(F.transform(c, f), " ")
    return d.select(
        "overall.turns", "overall.spendTokens", F.col("overall.costUsd").alias("cost"), F.col("overall.cacheHitRatio").alias("hit"),
        F.aggregate(F.map_values("overall.models"), F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("model_tokens"),
        listed("projects", lambda x: F.concat(x["project"], F.lit(":"), x["spendTokens"])).alias("projects"),
        listed("expensiveSessions", lambda x: F.concat(x["turns"], F.lit(":"), x["spendTokens"])).alias("expensive"),
        listed("toolErrorRates", lambda x: F.concat(x["tool"], F.lit(":"), x["turns"])).alias("failing"),
    )


add(
    "aggregate_payload",
    payload,
    f""", pj AS (SELECT project, {total('spend')} AS s FROM t GROUP BY 1 ORDER BY s DESC, project LIMIT 10),
    se AS (SELECT session_id, count(*) AS n, {total('spend')} AS s FROM t GROUP BY 1 HAVING NOT arg_min(is_sidechain, (ts, event_key)) ORDER BY s DESC, session_id LIMIT 8),
    tl AS (SELECT regexp_replace(tool, '^mcp__[^_]+__', '') AS tool, count(*) AS n, count(*) FILTER (is_error) AS e FROM (SELECT unnest(list_distinct(tools)) AS tool, is_error FROM t) GROUP BY 1)
    SELECT count(*) AS turns, {total('spend')} AS "spendTokens", round(sum(usd) FILTER (priced), 2) AS cost, {share('sum(cache_read_tokens)', 'sum(ctx)', 3)} AS hit, {total('spend')} AS model_tokens, (SELECT string_agg(project || ':' || s, ' ' ORDER BY s DESC, project) FROM pj) AS projects,
      (SELECT string_agg(n || ':' || s, ' ' ORDER BY s DESC, session_id) FROM se) AS expensive, coalesce((SELECT string_agg(tool || ':' || n, ' ' ORDER BY n DESC, tool) FROM tl WHERE e / n::DOUBLE > 0.05 AND n >= 20), '') AS failing FROM t""",
)

# --- models' answers ---


def answers(t: DataFrame) -> DataFrame:
    """A response a turn, of four kinds: prose around, a fence, a region that yields nothing before one that does, nothing that holds."""
    item = lambda metric, title, why: F.concat(F.lit(f'{{"metric":"{metric}","title":"'), title, F.lit('","rationale":"'), why, F.lit('"}'))
    k, key = F.floor(F.col("output_tokens") / 20), F.col("event_key")
    long_ = lambda n: F.concat(key, F.repeat(F.lit("x"), n))
    kind = key.cast("long") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit("See {note} and ["), F.lit("0] first: ["), item("reworkRatio", long_(130), long_(500)), F.lit(","), item("reworkRatio", key, key), F.lit(","), item("speed", key, key), F.lit("] as said.")))
        .when(kind == 1, F.concat(F.lit("```json\n["), item("floorShare", F.concat(F.lit("  "), key, F.lit(" } ] ")), key), F.lit("]\n```")))
        .when(kind == 2, F.concat(F.lit('[{"metric":"x"}] then {"interventions":['), item("retryShare", F.concat(F.lit('\\"{['), key), key), F.lit(","), item("coldRestartShare", F.lit(" "), key), F.lit("]} {")))
        .otherwise(F.concat(F.lit("nothing [1] "), k))
    )
    return stored(t.select(key.alias("id"), text.alias("text")))


def interventions(t: DataFrame) -> DataFrame:
    a = answers(t)
    items = stored(Re.checked(a))
    kept = Re.parse_interventions(a, items).select("id", "metric", "title", F.length("rationale").cast("long").alias("n"))
    dropped = Re.dropped_interventions(a, items).filter("dropped > 0")
    return kept.unionByName(dropped.select("id", F.lit("dropped").alias("metric"), F.lit(None).cast("string").alias("title"), F.col("dropped").alias("n")))


add(
    "parse_interventions",
    interventions,
    """, iv AS (SELECT event_key AS id, event_id % 4 AS kind, length(event_key) AS l FROM t)
    SELECT id, 'reworkRatio' AS metric, left(id || repeat('x', 130), 120) AS title, CAST(400 AS BIGINT) AS n FROM iv WHERE kind = 0
    UNION ALL SELECT id, 'floorShare', id || ' } ]', l FROM iv WHERE kind = 1 UNION ALL SELECT id, 'retryShare', '"{[' || id, l FROM iv WHERE kind = 2
    UNION ALL SELECT id, 'dropped', NULL, CASE kind WHEN 0 THEN 2 ELSE 1 END FROM iv WHERE kind IN (0, 2, 3)""",
)

# --- bills ---


def report_pages(t: DataFrame, vendor: str) -> DataFrame:
    """(file, value): a vendor's pages of ten days; each page but the first begins with the last bucket of the one before, which was not complete there."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01"))
    by = t.groupBy(day.alias("day"), "model").agg(*(F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")))
    if vendor == "openai":
        result = F.struct("model", (F.col("input_tokens") + F.col("cache_read_tokens")).alias("input_tokens"), F.col("cache_read_tokens").alias("input_cached_tokens"), "output_tokens")
    else:
        five = F.floor(F.col("cache_creation_tokens") / 2)
        result = F.struct("model", F.col("input_tokens").alias("uncached_input_tokens"), "output_tokens", F.col("cache_read_tokens").alias("cache_read_input_tokens"), F.struct(five.alias("ephemeral_5m_input_tokens"), (F.col("cache_creation_tokens") - five).alias("ephemeral_1h_input_tokens")).alias("cache_creation"))
    buckets = by.groupBy("day").agg(F.to_json(F.collect_list(result)).alias("results"), F.to_json(F.slice(F.collect_list(result), 1, 1)).alias("some"))
    start = F.concat(F.lit('{"' + B.START[vendor] + '":"'), "day", F.lit('","results":'))
    page = F.floor(F.col("day") / 10)
    whole = buckets.select(page.alias("page"), "day", F.concat(start, "results", F.lit("}")).alias("b"))
    cut = buckets.filter("day % 10 = 0").select((page - 1).alias("page"), "day", F.concat(start, "some", F.lit("}")).alias("b"))
    pages = whole.unionByName(cut).groupBy("page").agg(F.array_join(F.array_sort(F.collect_list("b")), ",").alias("b"))
    pages = pages.select(F.concat(F.lit("p"), F.lpad((F.col("page") + 1).cast("string"), 9, "0")).alias("file"), F.concat(F.lit('{"has_more":true,"data":['), "b", F.lit("]}")).alias("value"))
    return stored(pages.unionByName(pages.limit(1).select(F.lit("broken").alias("file"), F.lit('{"data":[{').alias("value"))))


def billed(t: DataFrame) -> DataFrame:
    """Both vendors' reports; the first one's leaves out every third user, and the second has a model without turns."""
    first = B.provider_usage(report_pages(t.filter("model like 'claude%' and user_id % 3 <> 0"), "anthropic"), "anthropic")
    second = B.provider_usage(report_pages(t.filter("model like 'gpt%'").unionByName(t.filter("model like 'gpt%'").withColumn("model", F.lit("gpt-elsewhere"))), "openai"), "openai")
    return first.unionByName(second)


BILLED = """, bi AS (
  SELECT model, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, CAST(sum(CASE WHEN model LIKE 'claude%' THEN cache_creation_tokens ELSE 0 END) AS BIGINT) AS cache_creation_tokens
  FROM (SELECT * FROM t WHERE (model LIKE 'claude%' AND user_id % 3 <> 0) OR model LIKE 'gpt%' UNION ALL SELECT * REPLACE ('gpt-elsewhere' AS model) FROM t WHERE model LIKE 'gpt%') GROUP BY 1),
bl AS (SELECT *, input_tokens + output_tokens + cache_read_tokens + cache_creation_tokens AS api_tokens FROM bi)
"""
add("read_provider_usage", billed, BILLED + "SELECT * FROM bl")
add(
    "reconcile_usage",
    lambda t: Te.reconcile_usage(t, billed(t)),
    BILLED + """, lo AS (SELECT model, CAST(sum(ctx + output_tokens) AS BIGINT) AS n FROM t GROUP BY 1)
    SELECT coalesce(lo.model, bl.model) AS model, coalesce(n, 0) AS local_tokens, coalesce(api_tokens, 0) AS api_tokens, round(CASE WHEN api_tokens > 0 THEN coalesce(n, 0) / CAST(api_tokens AS DOUBLE) ELSE 0 END, 6) AS coverage,
      CASE WHEN bl.model IS NULL THEN 'local-only' WHEN api_tokens > 0 AND n > api_tokens * 1.05::DOUBLE THEN 'local-exceeds-api' ELSE 'ok' END AS verdict FROM lo FULL JOIN bl ON bl.model = lo.model""",
)
