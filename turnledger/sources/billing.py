"""Vendors' usage reports: pages of daily buckets with results by model.

A report is fetched in windows of at most ``BUCKETS`` days, each in pages. A chain of pages that
was taken up again after a failure repeats pages or overlaps earlier ones: of a bucket that
several pages hold, the last page by file name counts, as a whole. Pages that are no JSON give
nothing; a number that is missing or none counts 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Daily buckets of one request at most. Fixed value.
BUCKETS = 31
# The results' fields of each vendor. The second counts cached tokens inside its input.
RESULTS = {
    "anthropic": "model: string, uncached_input_tokens: bigint, output_tokens: bigint, cache_read_input_tokens: bigint, cache_creation: struct<ephemeral_5m_input_tokens: bigint, ephemeral_1h_input_tokens: bigint>",
    "openai": "model: string, input_tokens: bigint, input_cached_tokens: bigint, output_tokens: bigint",
}
START = {"anthropic": "starting_at", "openai": "start_time"}


def usage_windows(spark: SparkSession, start: Column, end: Column) -> DataFrame:
    """(start, end): the requests for the days from start up to end (left out)."""
    days = spark.range(1).select(F.to_date(start).alias("a"), F.to_date(end).alias("b")).filter("a < b")
    begin = F.explode(F.sequence("a", F.greatest("a", F.date_sub("b", 1)), F.make_dt_interval(F.lit(BUCKETS)).cast("interval day")))
    return days.select(begin.alias("start"), "b").select("start", F.least("b", F.date_add("start", BUCKETS)).alias("end"))


def usage_buckets(pages: DataFrame, vendor: str) -> DataFrame:
    """pages: (file, value). bucket, model and tokens, repeated pages resolved."""
    field = START[vendor]
    schema = f"data array<struct<{field}: string, results: array<struct<{RESULTS[vendor]}>>>>"
    buckets = pages.select("file", F.explode(F.from_json("value", schema)["data"]).alias("b")).select("file", F.col(f"b.{field}").alias("bucket"), "b.results")
    # A page's bucket is one; buckets without a start can't repeat.
    last = Window.partitionBy(F.coalesce("bucket", F.concat(F.lit("\0"), "file")))
    kept = buckets.withColumn("_last", F.max("file").over(last)).filter(F.col("file") == F.col("_last"))
    r = kept.select("bucket", F.explode("results").alias("r")).select("bucket", "r.*")
    n = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    if vendor == "openai":
        tokens = [(n("input_tokens") - n("input_cached_tokens")).alias("input_tokens"), n("output_tokens").alias("output_tokens"), n("input_cached_tokens").alias("cache_read_tokens"), F.lit(0).cast("long").alias("cache_creation_tokens")]
    else:
        written = n("cache_creation.ephemeral_5m_input_tokens") + n("cache_creation.ephemeral_1h_input_tokens")
        tokens = [n("uncached_input_tokens").alias("input_tokens"), n("output_tokens").alias("output_tokens"), n("cache_read_input_tokens").alias("cache_read_tokens"), written.alias("cache_creation_tokens")]
    return r.select("bucket", F.coalesce("model", F.lit("unknown")).alias("model"), *tokens)


def provider_usage(pages: DataFrame, vendor: str) -> DataFrame:
    """Tokens per model of all buckets, with api_tokens, the sum of all kinds."""
    kinds = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens"]
    u = usage_buckets(pages, vendor).groupBy("model").agg(*(F.sum(k).alias(k) for k in kinds))
    return u.withColumn("api_tokens", sum((F.col(k) for k in kinds[1:]), F.col(kinds[0])))
