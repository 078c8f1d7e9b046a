"""One document of aggregates for each member: built, written as snapshots, read again, of any version's fields.

A document holds numbers only: metrics of all turns and of each project, coverage of each source,
the plan. Snapshots are written beside each other; a row in the folder of commits names the one
that holds, and is written after it. So a write that is killed leaves what was there readable.

Documents that are no JSON, of another version or without overall metrics are kept apart with
the reason; fields that a document lacks (older ones do) have their defaults, fields that are
unknown are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .metrics import compute_metrics
from .trends import source_coverage

VERSION = 1
MEMBER = ("user", "host")
# Names of the document's metrics by those of compute_metrics().
METRICS = {
    "events": "events", "conversations": "conversations", "input_tokens": "inputTokens", "output_tokens": "outputTokens", "cache_read_tokens": "cacheReadTokens", "cache_creation_tokens": "cacheCreationTokens",
    "thinking_tokens": "thinkingTokens", "spend_tokens": "spendTokens", "unpriced_tokens": "costUnpricedTokens", "error_events": "errorEvents", "rework_tokens": "reworkTokens", "retry_tokens": "retryTokens",
    "premium_waste_tokens": "premiumWasteTokens", "cold_restart_turns": "coldRestartTurns", "cold_restart_tokens": "coldRestartTokens", "main_fresh_tokens": "coldRestartBaseTokens",
    "trend_sessions": "trendSessions", "bloated_sessions": "bloatedSessions", "subagent_sessions": "subagentSessions", "subagent_tokens": "subagentSpendTokens",
    "extended_cache_tokens": "extendedCacheTokens", "extended_cache_sessions": "extendedCacheSessions", "returned_tokens": "toolResultTokens", "measured_turns": "toolResultTurns", "carry_tokens": "toolResultCarryTokens",
    "floor_sessions": "floorSessions", "floor_turns": "floorTurns", "floor_base_tokens": "floorBaseTokens", "shipped_sessions": "shippedSessions",
    "abandoned_streams": "abandonedStreams", "abandoned_tokens": "abandonedTokens", "open_streams": "openStreams", "open_tokens": "openTokens",
}
AMOUNTS = {"cost_usd": "costUsd", "floor_tokens": "sessionFloorTokens", "cost_per_shipped": "costPerShippedSession"}
RATIOS = {"cache_hit_ratio": "cacheHitRatio", "rework_ratio": "reworkRatio", "think_to_code": "thinkToCodeRatio", "bloat_share": "contextBloatShare", "cold_share": "coldRestartShare", "premium_waste_share": "premiumWasteShare",
    "retry_share": "retryShare", "subagent_share": "subagentShare", "carry_share": "toolResultCarryShare", "floor_share": "floorShare", "shipped_share": "shippedShare", "abandoned_share": "abandonedShare"}
ACTIVITIES = ("thinking", "exploration", "coding", "testing", "shipping", "conversation")
COVERAGE = {"source": "source", "active_days": "activeDays", "ratio": "ratio", "first": "first", "last": "last", "largest_gap": "largestGapDays", "stale_days": "staleDays"}

_ACTIVITY = "byActivity struct<" + ", ".join(f"{a}: struct<tokens: bigint>" for a in ACTIVITIES) + ">"
_METRICS = "struct<" + ", ".join([*(f"{n}: bigint" for n in METRICS.values()), *(f"{n}: double" for n in (*AMOUNTS.values(), *RATIOS.values())), "costEstimated: boolean", _ACTIVITY.replace(" ", ": ", 1)]) + ">"
_CATEGORY = "struct<id: string, name: string, terms: array<string>, sessions: bigint, projects: array<string>, tokens: bigint, cost: double, estimated: boolean, duplicate: boolean>"
DOCUMENT = (
    f"version bigint, user string, host string, generatedAt string, days bigint, overall {_METRICS}, byProject map<string, {_METRICS}>, plan string, sig struct<publicKey: string>, categories array<{_CATEGORY}>, categorizeDays bigint, "
    "coverage array<struct<source: string, activeDays: bigint, ratio: double, first: string, last: string, largestGapDays: bigint, staleDays: bigint>>, corrupt string"
)


def _document_metrics() -> Column:
    by_activity = F.struct(*(F.struct(F.col(f"{a}_activity").alias("tokens")).alias(a) for a in ACTIVITIES))
    return F.struct(*(F.col(c).alias(n) for c, n in (METRICS | AMOUNTS | RATIOS).items()), F.col("cost_estimated").alias("costEstimated"), by_activity.alias("byActivity"))


def build_exports(turns: DataFrame, pr_sessions: DataFrame, now: Column, days: int, plans: DataFrame | None = None) -> DataFrame:
    """user, host, doc: the JSON document of each member of turns (which has the columns user and host).

    plans: (user, plan). The parts of different grain are rows of one union, put together by one
    aggregation. A document has an entry a project and a source of its member, as asked for.
    """
    nothing = {"overall": F.lit(None), "project": F.lit(None), "coverage": F.lit(None)}

    def rows(df: DataFrame, **have: Column) -> DataFrame:
        return df.select(*MEMBER, *(have.get(n, v).alias(n) for n, v in nothing.items()))

    all_ = compute_metrics(turns, pr_sessions, now, MEMBER)
    by_project = compute_metrics(turns.filter("project is not null"), pr_sessions, now, (*MEMBER, "project"))
    coverage = source_coverage(turns, now, days, MEMBER)
    parts = rows(all_, overall=_document_metrics())
    parts = parts.unionByName(rows(by_project, project=F.struct("project", _document_metrics().alias("metrics"))))
    parts = parts.unionByName(rows(coverage, coverage=F.struct(*(F.col(c).alias(n) for c, n in COVERAGE.items()))))
    one = parts.groupBy(*MEMBER).agg(F.max("overall").alias("overall"), F.map_from_entries(F.array_sort(F.collect_list("project"))).alias("byProject"), F.array_sort(F.collect_list("coverage")).alias("coverage"))
    if plans is None:
        one = one.withColumn("plan", F.lit(None).cast("string"))
    else:
        one = one.join(plans.groupBy("user").agg(F.min("plan").alias("plan")), "user", "left")
    at = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    doc = F.struct("plan", F.lit(VERSION).alias("version"), "user", "host", at.alias("generatedAt"), F.lit(days).alias("days"), "overall", "coverage", "byProject")
    return one.select(*MEMBER, F.to_json(doc).alias("doc"))


def write_export(docs: DataFrame, path: str, now: Column) -> str:
    """Writes the documents as a new snapshot below path and then makes it the one that holds; its name."""
    spark = docs.sparkSession
    at = spark.range(1).select(F.date_format(now, "yyyyMMddHHmmssSSSSSS")).first()[0]
    name = f"{at}-{uuid.uuid4().hex}"
    docs.select("doc").write.text(f"{path}/snapshots/{name}")
    spark.range(1, numPartitions=1).select(F.lit(name).alias("value")).write.mode("append").text(f"{path}/commits")
    return name


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): the documents of the latest snapshot that was committed."""
    name = spark.read.text(f"{path}/commits").agg(F.max("value")).first()[0]
    text = spark.read.text(f"{path}/snapshots/{name}")
    return text.select(F.col("_metadata.file_path").alias("file"), "value")


def parsed(docs: DataFrame) -> DataFrame:
    """file, reason (why a document is turned down; null if it holds) and the document's fields."""
    d = docs.select("file", F.from_json("value", DOCUMENT, {"columnNameOfCorruptRecord": "corrupt"}).alias("d")).select("file", "d.*")
    reason = F.when(F.col("corrupt").isNotNull() | (F.col("version").isNull() & F.col("overall").isNull()), "no export")
    reason = reason.when(~F.col("version").eqNullSafe(F.lit(VERSION)), "other version").when(F.col("overall").isNull(), "no overall")
    return d.withColumn("reason", reason).drop("corrupt")


def _flat(m: str) -> list[Column]:
    """The columns of compute_metrics() that exports carry, from a struct of the document; what is missing has its default."""
    zero = {c: F.coalesce(F.col(f"{m}.{n}"), F.lit(0).cast("long")) for c, n in METRICS.items()}
    # Before runs of subagents were told apart, all fresh input was the main loop's.
    zero["main_fresh_tokens"] = F.coalesce(F.col(f"{m}.coldRestartBaseTokens"), zero["input_tokens"] + zero["cache_creation_tokens"])
    amounts = {c: F.coalesce(F.col(f"{m}.{n}"), F.lit(0.0)) for c, n in AMOUNTS.items()}
    activities = {f"{a}_activity": F.coalesce(F.col(f"{m}.byActivity.{a}.tokens"), F.lit(0).cast("long")) for a in ACTIVITIES}
    return [*(v.alias(c) for c, v in (zero | amounts | activities).items()), F.coalesce(F.col(f"{m}.costEstimated"), F.lit(False)).alias("cost_estimated")]


def member_exports(docs: DataFrame) -> DataFrame:
    """One row for each document that holds: file, user, host, fingerprint, generated_at, days, plan and its overall metrics, as merge_metrics() takes them."""
    ok = parsed(docs).filter("reason is null")
    # The fingerprint of a key is a hash of its bytes.
    key = F.unbase64(F.regexp_replace("sig.publicKey", r"-----[A-Z ]+-----|\s", ""))
    return ok.select("file", "user", "host", F.substring(F.sha2(key, 256), 1, 16).alias("fingerprint"), F.col("generatedAt").alias("generated_at"), "days", F.col("plan"), *_flat("overall"))


def export_projects(docs: DataFrame) -> DataFrame:
    """One row for each project of a document that holds: file, user, host, project and its metrics."""
    p = parsed(docs).filter("reason is null").select("file", "user", "host", F.explode("byProject").alias("project", "m"))
    return p.select("file", "user", "host", "project", *_flat("m"))


def export_coverage(docs: DataFrame) -> DataFrame:
    c = parsed(docs).filter("reason is null").select("file", "user", "host", F.explode("coverage").alias("c"))
    return c.select("file", "user", "host", *(F.col(f"c.{n}").alias(a) for a, n in COVERAGE.items()))


def export_rejects(docs: DataFrame) -> DataFrame:
    """(file, reason) of the documents that are turned down."""
    return parsed(docs).filter("reason is not null").select("file", "reason")
