"""What the operators' queries share: reading tables, folds, durable intermediate tables."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: This process's folder where no shared one is configured (local tests).
_own = ""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """The test fold: crc32 of the id as text, modulo 5, is 0. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share.

    Only where that setting is absent and everything runs in one process (local tests) a
    temporary folder is set; on a cluster its absence is an error.
    """
    global _own
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not (spark.conf.get("spark.master", "") or "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = _own = _own or tempfile.mkdtemp(prefix="spark-shared-")
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there and lost executors don't matter."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work, a function for mapInArrow or mapInPandas, that at its task's end gives memory back to the system.

    Python workers live on between tasks, and Arrow and the C library keep what they once had.
    """

    def run(batches):
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def small(df: DataFrame, rows: int, most: int = 1 << 18) -> DataFrame:
    """df to be broadcast if its known number of rows is no larger than most; else joined as any table."""
    return F.broadcast(df) if rows <= most else df


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def parts(spark: SparkSession, n_bytes: float, each: int = 64 << 20) -> int:
    """Number of partitions for so many bytes; at least the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / each), 1)
