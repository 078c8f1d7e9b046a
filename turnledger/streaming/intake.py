"""Streams over files of turns. Each runs until all files there are taken in, and resumes from its checkpoint."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import shared_dir

LATE = "7 days"
KEY = ["source", "event_key"]
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def turn_files(turns: DataFrame) -> str:
    """Writes turns as files of a new folder, for streams to read; gives the folder."""
    path = shared_dir(turns.sparkSession)
    turns.write.parquet(path)
    return path


def first_of_each(rows: pa.Table) -> pa.Table:
    """The first row of each (source, event_key), in the order of dedup_turns(); null counts as a value."""
    order = [(c, "ascending") for c in ("ts", "session_id", "input_tokens", "output_tokens") if c in rows.column_names]
    place = pc.sort_indices(rows, sort_keys=order, null_placement="at_start")
    keyed = rows.select(KEY).take(place).append_column("place", place)
    rank = keyed.append_column("rank", pa.array(range(len(place)), pa.int64())).group_by(KEY).aggregate([("rank", "min")])
    return rows.take(place.take(rank["rank_min"]))


def stream_collect(spark: SparkSession, source: str, schema, table: str, checkpoint: str, files: int = 1000, chunks: int = 256) -> None:
    """Appends the turns of new files in source to table, each (source, event_key) once, however late they come.

    The keys taken in so far are the query's state, in RocksDB: a batch looks up its own keys and
    reads nothing of the table, so its work grows with the batch alone. There is no watermark, as
    one would drop late turns that are no repeats; the state holds a key a turn and is spread
    over the shuffle partitions of the first run. Of a batch's own repeats the first by time
    stays: each of the chunks of keys, which hold no more than their share of a batch of so many
    files, is sorted by itself. A batch that is run again after a failure overwrites its own
    folder, and its state starts from the batch before.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    first = rows.groupBy(F.pmod(F.xxhash64(*KEY), F.lit(chunks)).alias("chunk")).applyInArrow(first_of_each, schema)

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        stream = first.dropDuplicates(KEY).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    stream.awaitTermination()


def stream_daily_usage(spark: SparkSession, source: str, schema, table: str, checkpoint: str, late: str = LATE) -> None:
    """Turns and tokens by day, source and project. Each batch writes the days it changed; the last batch of a day holds."""
    t = spark.readStream.schema(schema).parquet(source).withWatermark("ts", late)
    daily = t.groupBy(F.window("ts", "1 day").alias("w"), "source", "project").agg(F.count("*").alias("turns"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
    rows = daily.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "source", "project", "turns", "tokens")

    def add(batch: DataFrame, number: int) -> None:
        batch.withColumn("number", F.lit(number)).write.mode("overwrite").parquet(f"{table}/batch={number}")

    rows.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def daily_usage(spark: SparkSession, table: str) -> DataFrame:
    """The last state of each day in the table of stream_daily_usage()."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(table)
    w = Window.partitionBy("day", "source", "project").orderBy(F.desc("number"))
    return rows.withColumn("r", F.row_number().over(w)).filter("r = 1").select("day", "source", "project", "turns", "tokens")
