"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own = ""


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one only where that is unset and all runs in one process."""
    global _own
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not (spark.conf.get("spark.master", "") or "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = _own = _own or tempfile.mkdtemp(prefix="spark-shared-")
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None, **options: str) -> DataFrame:
    """df written as a table and read back, so that its lineage ends there. path: where, for let_go(); options: the writer's."""
    path = path or shared_dir(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession, path: str | None = None) -> None:
    """Gives disk back between jobs: the exchanges of jobs that are done, and the table at path, which nothing reads any more.

    Spark removes an exchange's files when the driver collects its plan, which a large heap may put off to the end.
    """
    spark.sparkContext._jvm.System.gc()
    if path:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def small(df: DataFrame, most: int = 1 << 18) -> DataFrame:
    """df as a table, to be broadcast if its rows, counted first, are no more than most; else joined as any other."""
    kept = stored(df)
    return F.broadcast(kept) if kept.limit(most + 1).count() <= most else kept


def numbered(df: DataFrame, by: list, name: str) -> DataFrame:
    """df with numbers from 1 without gaps in the order of by; no exchange brings all rows together."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    # One row a partition.
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = sizes.select("_part", "_first", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_at", "_part", "_first", "_before")
