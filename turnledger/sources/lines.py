"""Log lines as rows: (file, ord, value), where ord ascends inside a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all files below path. ord is taken at the scan, before any exchange: where the split starts, then the line in it."""
    text = spark.read.option("recursiveFileLookup", "true").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("ord"), "value")
