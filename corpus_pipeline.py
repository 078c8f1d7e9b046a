"""The corpus pipeline: language ID, near-duplicate removal, repeated strings, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. What a stage keeps is written as Parquet and read again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnledger.llm import language_id, mixing, near_dedup, packing, suffix_dedup
from turnledger.llm.common import durable, table

STAGES = [
    ("language_id", language_id.stage),
    ("near_dedup", near_dedup.stage),
    ("suffix_dedup", suffix_dedup.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: Hashing, tokenising and local search are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that the stages keep."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
