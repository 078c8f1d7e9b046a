"""What tools and servers return, and what carrying it costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import server_of
from ..functions.pricing import price_table
from .annotate import annotate
from .metrics import _sum, ratio


def _sizes(turns: DataFrame) -> DataFrame:
    """One row per turn and measured tool: tool, tokens returned, turns that carry them, cache-read price of the model."""
    t = annotate(turns).filter("tool_result_chars is not null")
    t = t.select("event_key", "source", "model", "carried", F.explode("tool_result_chars").alias("tool", "tool_chars")).filter("tool_chars > 0")
    models = t.select("model").distinct().join(F.broadcast(price_table(turns.sparkSession)), F.expr("model rlike pattern"), "left")
    read = models.groupBy("model").agg(F.min_by("p_cache_read", "position").alias("read_price"))
    t = t.join(F.broadcast(read), "model", "left")  # one row per model
    returned = F.round(F.col("tool_chars") / 4).cast("long")
    return t.withColumn("returned", returned).withColumn("carry", F.col("returned") * F.col("carried"))


def tool_carry(turns: DataFrame) -> DataFrame:
    s = _sizes(turns).groupBy("tool").agg(
        F.count("*").alias("calls"),
        _sum("returned").alias("returned_tokens"),
        _sum("carry").alias("carry_tokens"),
        F.avg("carried").alias("mean_carried"),
        F.coalesce(F.sum(F.col("carry") * F.coalesce("read_price", F.lit(0.0)) / 1e6), F.lit(0.0)).alias("carry_usd"),
    )
    return s.withColumn("server", server_of(F.col("tool")))


def server_stats(turns: DataFrame) -> DataFrame:
    """Per server: tools, turns (a turn counts once), spend and errors of these turns, last day used."""
    t = annotate(turns).withColumn("tool", F.explode("tools")).withColumn("server", server_of(F.col("tool"))).filter("server is not null")
    tools = t.groupBy("server").agg(F.countDistinct("tool").alias("tools"))
    once = t.select("server", "source", "event_key", "spend", "usd", "is_error", "ts").dropDuplicates(["server", "source", "event_key"])
    s = once.groupBy("server").agg(
        F.count("*").alias("turns"), _sum("spend").alias("spend_tokens"), _sum("usd").alias("cost_usd"), F.count(F.when(F.col("is_error"), 1)).alias("errors"), F.to_date(F.max("ts")).cast("string").alias("last_day")
    )
    sizes = _sizes(turns).withColumn("server", server_of(F.col("tool"))).filter("server is not null").groupBy("server").agg(_sum("returned").alias("returned_tokens"), _sum("carry").alias("carry_tokens"))
    out = s.join(tools, "server").join(sizes, "server", "left").fillna(0, ["returned_tokens", "carry_tokens"])
    return out.withColumn("error_rate", ratio("errors", "turns")).drop("errors")


def server_set_difference(turns: DataFrame, declared: DataFrame) -> DataFrame:
    """(server, state): declared but unused, and used but not declared. declared has the column server."""
    used = turns.select(F.explode("tools").alias("tool")).select(server_of(F.col("tool")).alias("server")).filter("server is not null").distinct()
    known = declared.select("server").distinct()
    unused = known.join(used, "server", "left_anti").withColumn("state", F.lit("unused"))
    return unused.unionByName(used.join(known, "server", "left_anti").withColumn("state", F.lit("undeclared")))


def tool_surface_totals(turns: DataFrame) -> DataFrame:
    s = _sizes(turns).agg(F.count("*").alias("calls"), _sum("returned").alias("returned_tokens"), _sum("carry").alias("carry_tokens"))
    measured = turns.agg(F.coalesce(F.bool_or(F.col("tool_result_chars").isNotNull()), F.lit(False)).alias("measured"))
    return s.crossJoin(F.broadcast(measured))  # one row each
