"""Columns that every chronological metric needs, added with one exchange by session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pricing import is_premium, price_turns
from ..schema import ACTIVITIES

TTL_SECONDS, LONG_TTL_SECONDS = 300, 3600
RESET_RATIO, RESET_MIN_CONTEXT = 0.5, 20_000
MIN_TREND_TURNS = 8


def root_of() -> Column:
    """The conversation a turn belongs to."""
    return F.coalesce(F.nullif("parent_session_id", F.lit("")), F.col("session_id"))


def session_window(scope=()) -> Window:
    return Window.partitionBy(*scope, "session_id").orderBy("ts", "event_key")


def with_sums(turns: DataFrame) -> DataFrame:
    """Adds spend, ctx, fresh, root, premium, act (a known activity) and the price columns."""
    return price_turns(turns).withColumns(
        {
            "spend": F.col("input_tokens") + F.col("output_tokens"),
            "ctx": F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_creation_tokens"),
            "fresh": F.col("input_tokens") + F.col("cache_creation_tokens"),
            "root": root_of(),
            "premium": is_premium(F.col("model")),
            "act": F.when(F.col("activity").isin(*ACTIVITIES), F.col("activity")).otherwise("conversation"),
            "chars": F.coalesce(F.aggregate(F.map_values("tool_result_chars"), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)),
        }
    ).withColumn("returned", F.when(F.col("chars") > 0, F.round(F.col("chars") / 4).cast("long")).otherwise(0))


def annotate(turns: DataFrame, scope=()) -> DataFrame:
    """with_sums() and, per session of the scope, all that depends on the order of turns.

    All windows share one partitioning and one order, so the plan has one exchange and one sort
    for them; the main-loop windows add a second partition column only inside the same session.
    """
    t = with_sums(turns)
    w = session_window(scope)
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    work = F.col("activity").isin("coding", "testing")
    t = t.withColumns(
        {
            "idx": F.row_number().over(w),
            "n_turns": F.count("*").over(all_),
            "prev_ctx": F.lag("ctx").over(w),
            "prev_activity": F.lag("activity").over(w),
            "prev_ts": F.lag("ts").over(w),
            "prev_error_tools": F.lag(F.when(F.col("is_error"), F.coalesce("tools", F.array().cast("array<string>")))).over(w),
            "failed_before": F.coalesce(F.max(F.col("is_error") & work).over(before), F.lit(False)),
            "main_writes": F.sum(F.when(~F.col("is_sidechain"), F.col("cache_creation_tokens"))).over(all_),
            "main_writes_1h": F.sum(F.when(~F.col("is_sidechain"), F.coalesce("cache_creation_1h_tokens", F.lit(0)))).over(all_),
            "main_turns": F.count(F.when(~F.col("is_sidechain"), 1)).over(all_),
            "main_idx": F.when(~F.col("is_sidechain"), F.count(F.when(~F.col("is_sidechain"), 1)).over(w.rowsBetween(Window.unboundedPreceding, 0))),
            "prev_main_ts": F.last(F.when(~F.col("is_sidechain"), F.col("ts")), True).over(before),
        }
    )
    reset = (F.col("prev_ctx") >= RESET_MIN_CONTEXT) & (F.col("ctx") < F.col("prev_ctx") * RESET_RATIO)
    t = t.withColumn("reset_idx", F.when(reset, F.col("idx")))
    long_tier = (F.coalesce("main_writes", F.lit(0)) > 0) & (2 * F.col("main_writes_1h") >= F.col("main_writes"))
    gap = F.unix_micros("ts") - F.unix_micros("prev_main_ts")
    t = t.withColumns(
        {
            "carried": F.coalesce(F.min("reset_idx").over(after), F.col("n_turns") + 1) - 1 - F.col("idx"),
            "ttl": F.when(long_tier, LONG_TTL_SECONDS).otherwise(TTL_SECONDS),
            "main_gap": F.when(~F.col("is_sidechain"), gap / 1e6),
            "rework": F.col("failed_before") & work,
            "retry": F.coalesce(F.arrays_overlap("tools", "prev_error_tools"), F.lit(False)),
        }
    )
    return t.withColumn("cold", F.coalesce(F.col("main_gap") > F.col("ttl"), F.lit(False)))


def halves(idx: Column, n: Column) -> tuple[Column, Column]:
    """(in the first half, in the last half) of n turns; the middle one of an odd number is in neither."""
    half = F.floor(n / 2)
    return idx <= half, idx > n - half
