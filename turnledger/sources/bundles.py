"""Many small ordered files in few large ones.

The lines of all files, ordered by file and place, are cut into bundles of a bounded size; an index
says where in which bundle (or bundles) each file's lines stand, in bytes of the bundle's text.
Bundles are compressed: logs repeat themselves, and take a small part of their texts' size. No task
opens a file a session, and no folder is made for one. The index is written last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import let_go, shared_dir, stored

BUNDLE_BYTES = 8 << 20


def write_bundles(lines: DataFrame, path: str, bundle_bytes: int = BUNDLE_BYTES) -> None:
    """lines: (file, ord, value), value without line feeds. A file that is larger than a bundle lies in several."""
    spark, held = lines.sparkSession, shared_dir(lines.sparkSession)
    lines = lines.select("file", "ord", "value")
    total = lines.agg(F.sum(F.octet_length("value") + 1)).first()[0] or 0
    n = max(1, -(-total // bundle_bytes))
    order = [F.asc("file"), F.asc("ord")]
    placed = stored(lines.repartitionByRange(int(n), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), held, compression="zstd")
    let_go(spark)
    placed = placed.withColumn("bundle", F.shiftright("at", 33))
    placed.select("value", "bundle", "at").repartition(int(n), "bundle").sortWithinPartitions("bundle", "at").drop("at").write.partitionBy("bundle").text(f"{path}/bundles", compression="gzip")
    let_go(spark)
    # Only lengths are exchanged: texts that compress well would be put together by the gigabyte.
    sizes = placed.select("bundle", "file", "at", (F.octet_length("value") + 1).alias("size"))
    at = sizes.withColumn("start", F.sum("size").over(Window.partitionBy("bundle").orderBy("at")) - F.col("size"))
    index = at.groupBy("bundle", "file").agg(F.min("start").alias("offset"), F.sum("size").alias("length"))
    index.write.parquet(f"{path}/index")
    let_go(spark, held)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(bundle, file, offset, length)."""
    return spark.read.parquet(f"{path}/index")


def read_bundles(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """The lines (file, ord, value) of all files, or of those in files (file): only bundles that hold one are cut up."""
    index = read_index(spark, path)
    if files is not None:
        index = index.join(files.select("file").distinct(), "file", "left_semi")
    # A bundle is bounded, so are its entries.
    wanted = index.groupBy("bundle").agg(F.collect_list(F.struct("file", "offset", "length")).alias("entries"))
    whole = spark.read.option("recursiveFileLookup", "true").text(f"{path}/bundles", wholetext=True)
    # As many partitions as bundles, whatever their texts are compressed to.
    parts = max(1, index.agg(F.countDistinct("bundle")).first()[0])
    whole = whole.select(F.regexp_extract("_metadata.file_path", r"/bundle=(\d+)/", 1).cast("long").alias("bundle"), F.col("value").cast("binary").alias("content")).repartition(parts, "bundle")
    cut = whole.join(wanted, "bundle").select("bundle", "content", F.explode("entries").alias("e"))
    one = cut.select("bundle", "e.file", F.substring("content", F.col("e.offset").cast("int") + 1, F.col("e.length").cast("int") - 1).cast("string").alias("text"))
    lines = one.select("file", "bundle", F.posexplode(F.split("text", "\n")).alias("line", "value"))
    return lines.select("file", F.struct("bundle", "line").alias("ord"), "value")
