"""Token ids of documents as ORC files that can be read in parallel and pruned.

Documents are dealt out by ranges of doc_id and sorted, so the files, and the rows in
each, ascend. ORC stores ids with its integer run-length encoding, in stripes that
readers take separately; a row index and a Bloom filter on doc_id let a search for some
documents skip stripes and row groups.

Defined results: a null text is empty, so it has the end id alone. Null ids come first.
Rows that share an id stay separate, in the order of a hash of their texts, by which an id
that very many rows share is spread over files. Only doc_id and text are
read, so further columns have no effect. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as T
from .common import durable, parts, released, shared_dir, table, text_bytes
from .tokens import SLICE, default_tokenizer, encoder

END_ID = 2
SCHEMA = "doc_id long, row long, ids array<int>"


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, part_bytes: int = 32 << 20) -> None:
    """Writes (doc_id, row, ids) in ascending doc_id order; row counts from 0 in each file."""

    def encode(batches):
        enc = encoder(tokenizer or default_tokenizer())
        row = 0
        for batch in batches:
            for first, last, buf, off in T.slices(batch.column("text"), SLICE):
                ids, counts = enc.encode(buf, off)
                # One more place after each document for the end id.
                edge = np.r_[0, np.cumsum(counts + 1)]
                out = np.full(edge[-1], end_id, np.int32)
                inner = np.ones(edge[-1], bool)
                inner[edge[1:] - 1] = False
                out[inner] = ids
                lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(out))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[first:last], pa.array(np.arange(row, row + last - first)), lists], ["doc_id", "row", "ids"])
                row += last - first

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = parts(docs.sparkSession, text_bytes(docs), part_bytes)
    order = ("doc_id", F.xxhash64("text"))
    (
        docs.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(released(encode), SCHEMA)
        .write.option("compression", "zstd")
        .option("orc.stripe.size", 16 << 20)
        .option("orc.row.index.stride", 1000)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", 0.01)
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows of the files; with doc_ids, only those, found through row indexes and Bloom filters."""
    df = spark.read.schema(SCHEMA).orc(path)
    return df if doc_ids is None else df.filter(F.col("doc_id").isin(doc_ids))


def token_offsets(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what read_token_files() gives."""

    def digest(batches):
        for batch in batches:
            lists = batch.column("ids")
            edge = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(values[a:b]) for a, b in zip(edge[:-1], edge[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("row"), batch.column("doc_id"), pa.array(np.diff(edge).astype(np.int64)), pa.array(crc, pa.int64())], ["file", "row", "doc_id", "n_tokens", "ids_crc32"])

    # Files are numbered by their range; the number, not the name, is what orders them.
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    rows = files.select(number.alias("file"), "row", "doc_id", "ids")
    rows = durable(rows.mapInArrow(released(digest), "file long, row long, doc_id long, n_tokens long, ids_crc32 long"))
    # One row for each file: where its first id stands among all.
    files_ = rows.groupBy("file").agg(F.sum("n_tokens").alias("in_file"))
    before = files_.select("file", F.coalesce(F.sum("in_file").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(before, "file")
        .select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
    )


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_token_files(table(spark, sf_dir, "documents"), path)
    return token_offsets(read_token_files(spark, path))


QUERIES = {"op3_token_files": op3_token_files}
ORACLE_SQL: dict[str, str] = {}
