"""Two windows compared, and how completely the window is covered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .annotate import with_sums
from .metrics import _sum, compute_metrics, ratio

FLAT = 0.005
WARN_RATIO, STALE_DAYS, RETENTION_SLACK = 0.6, 3, 1.5

# Label, metric column, format, better direction, column that must be measured in either window
ROWS = [
    ("Spend tokens", "spend_tokens", "tokens", None, None),
    ("Est. cost", "cost_usd", "usd", None, None),
    ("Sessions", "conversations", "int", None, None),
    ("Cache hit", "cache_hit_ratio", "pct", "up", None),
    ("Rework", "rework_ratio", "pct", "down", None),
    ("Think:code", "think_to_code", "ratio", None, None),
    ("Context bloat", "bloat_share", "pct", "down", None),
    ("Cold restarts", "cold_share", "pct", "down", None),
    ("Premium on exploration/chat", "premium_waste_share", "pct", "down", None),
    ("Retry loops", "retry_share", "pct", "down", None),
    ("Session floor", "floor_tokens", "tokens", "down", "floor_sessions"),
    ("Shipped sessions", "shipped_share", "pct", "up", "conversations"),
    ("Unshipped (idle) spend", "abandoned_share", "pct", "down", "conversations"),
    ("Tool-result carry", "carry_share", "pct", "down", "measured_turns"),
    ("Subagent share", "subagent_share", "pct", None, "subagent_sessions"),
]


def split_windows(turns: DataFrame, now: Column, days: int) -> DataFrame:
    """Adds window: current for the last days, previous for the days before; older turns are dropped."""
    back = lambda n: now - F.make_dt_interval(F.lit(n))  # noqa: E731  a comparison of ts alone reaches the scan
    return turns.filter(F.col("ts") >= back(2 * days)).withColumn("window", F.when(F.col("ts") >= back(days), "current").otherwise("previous"))


def filter_window(turns: DataFrame, now: Column, days: int) -> DataFrame:
    return turns.filter(F.col("ts") >= now - F.make_dt_interval(F.lit(days)))


def verdict(prev: Column, cur: Column, fmt: Column, good: Column) -> Column:
    d = cur - prev
    base = F.greatest(F.abs(prev), F.abs(cur), F.lit(1e-9))
    flat = ((fmt == "pct") & (F.abs(d) < 0.0005)) | ((fmt == "ratio") & (F.abs(d) < 0.005)) | (F.abs(d / base) < FLAT)
    return F.when(flat, "flat").when(good.isNull(), "neutral").when((d > 0) == (good == "up"), "better").otherwise("worse")


def trend_rows(turns: DataFrame, pr_sessions: DataFrame, now: Column, days: int) -> DataFrame:
    """(label, prev, cur, verdict): the metrics of both windows side by side, from one scan."""
    m = compute_metrics(split_windows(turns, now, days), pr_sessions, now, ("window",))
    items = F.array(
        *(
            F.struct(F.lit(i).alias("i"), F.lit(label).alias("label"), F.lit(fmt).alias("fmt"), F.lit(good).cast("string").alias("good"), F.col(c).cast("double").alias("v"), (F.col(need) > 0 if need else F.lit(True)).alias("some"))
            for i, (label, c, fmt, good, need) in enumerate(ROWS)
        )
    )
    rows = m.select("window", F.explode(items).alias("r")).select("window", "r.*")
    both = rows.groupBy("i", "label", "fmt", "good").agg(
        F.coalesce(F.max(F.when(F.col("window") == "previous", F.col("v"))), F.lit(0.0)).alias("prev"), F.coalesce(F.max(F.when(F.col("window") == "current", F.col("v"))), F.lit(0.0)).alias("cur"), F.max("some").alias("some")
    )
    return both.filter("some").select("label", "prev", "cur", verdict(F.col("prev"), F.col("cur"), F.col("fmt"), F.col("good")).alias("verdict"))


def project_movers(turns: DataFrame, now: Column, days: int, top: int = 5) -> DataFrame:
    """The projects whose spend changed most; one that vanished counts too."""
    t = with_sums(split_windows(turns, now, days))
    p = t.groupBy("project").agg(_sum("spend", F.col("window") == "previous").alias("prev"), _sum("spend", F.col("window") == "current").alias("cur"))
    return p.withColumn("delta", F.col("cur") - F.col("prev")).filter("delta <> 0").orderBy(F.desc(F.abs("delta")), "project").limit(top)


def trend_comparable(turns: DataFrame, now: Column, days: int) -> DataFrame:
    t = split_windows(turns, now, days)
    day = F.to_date("ts")
    c = t.agg(F.countDistinct(F.when(F.col("window") == "current", day)).alias("current_days"), F.countDistinct(F.when(F.col("window") == "previous", day)).alias("previous_days"))
    return c.withColumn("comparable", F.col("previous_days") >= F.col("current_days") * WARN_RATIO)


def source_coverage(turns: DataFrame, now: Column, days: int, scope=()) -> DataFrame:
    d = turns.select(*scope, "source", F.to_date("ts").alias("day")).distinct()
    d = d.withColumn("gap", F.datediff("day", F.lag("day").over(Window.partitionBy(*scope, "source").orderBy("day"))) - 1)
    c = d.groupBy(*scope, "source").agg(F.count("*").alias("active_days"), F.min("day").alias("first"), F.max("day").alias("last"), F.greatest(F.coalesce(F.max("gap"), F.lit(0)), F.lit(0)).alias("largest_gap"))
    return c.select(
        *scope,
        "source",
        "active_days",
        (F.col("active_days") / days if days > 0 else F.lit(0.0)).alias("ratio"),
        F.col("first").cast("string").alias("first"),
        F.col("last").cast("string").alias("last"),
        "largest_gap",
        F.greatest(F.lit(0), F.datediff(F.to_date(now), "last")).alias("stale_days"),
    )


def coverage_flags(turns: DataFrame, now: Column, days: int, retention_days: int = 30, retention_source: str = "claude-code") -> DataFrame:
    """Warnings per source, and whether older history was probably deleted before it could be collected."""
    c = source_coverage(turns, now, days)
    age = F.round((F.unix_micros(now) - F.unix_micros(F.to_timestamp("first"))) / 86_400_000_000).cast("long")
    return c.select(
        "source",
        ((F.col("ratio") < WARN_RATIO) | (F.col("largest_gap") >= STALE_DAYS)).alias("thin"),
        (F.col("stale_days") >= STALE_DAYS).alias("stale"),
        ((F.lit(days) > retention_days) & (F.col("source") == retention_source) & (age <= retention_days * RETENTION_SLACK)).alias("retention"),
    )


def stream_daily(turns: DataFrame) -> DataFrame:
    """Day, source and project: turns and tokens."""
    return turns.groupBy(F.to_date("ts").cast("string").alias("day"), "source", "project").agg(F.count("*").alias("turns"), _sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
