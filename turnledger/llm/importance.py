"""Quality by importance resampling.

Two generative models, of target and of raw text, are bags of hashed n-grams (single tokens
and pairs). A document's log-ratio is the sum of log(target / raw) over its n-grams; adding
Gumbel noise to it and taking the k largest draws k documents without replacement with odds
proportional to the ratio. The target model is counted on a sample of well-rated documents
whose expected size is bounded by ``sample_rows``; the raw model on all documents. The noise is
a hash of the id, so reruns agree. k is a share of all rows: by default the share of
well-rated documents among the rated ones.

The k-th largest key is found by refining a histogram, so no more than one bin's rows are
ever sorted together, however large k is.

Defined results: a null or empty text has no n-gram and a log-ratio of 0. Ties go to the
smaller id. Rows that share an id get the same noise, and of conflicting ratings of one id the
higher holds. Null ids come after all others, and stay or go together at a tie. Without
a rated document all ratios are 0 and all rows are kept. Further columns have no effect. An
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .common import durable, held_out, released, table

BUCKETS = 10_000
SAMPLE_ROWS = 20_000
SEED = 29
BINS = 2048

# Word characters: letters, digits, underscore and all of UTF-8's longer sequences; the rest but white space is punctuation.
_WORD = np.zeros(256, bool)
_WORD[np.r_[48:58, 65:91, 95, 97:123, 128:256]] = True


def ngrams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of the tokens and token pairs; tokens are runs of word characters or of punctuation."""
    kind = np.where(T.SEPARATOR[buf], 0, np.where(_WORD[buf], 1, 2)).astype(np.int8)
    change = np.ones(len(buf) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[off] = True
    edge = np.flatnonzero(change)
    start, end = edge[:-1], edge[1:]
    some = kind[start] > 0 if len(start) else np.zeros(0, bool)
    start, end = start[some], end[some]
    h = T.span_hash(T.prefix_sums(buf), start, end)
    doc = np.searchsorted(off, start, "right") - 1
    pair = T.mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:])
    inside = doc[1:] == doc[:-1]
    bucket = (np.concatenate([h, pair[inside]]) % np.uint64(BUCKETS)).astype(np.int64)
    return bucket, np.concatenate([doc, doc[1:][inside]])


def count_ngrams(flagged: DataFrame) -> DataFrame:
    """(bucket, raw, target) over rows (text, is_target)."""

    def count(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            is_target = np.array(batch.column("is_target").to_pylist(), bool)
            for first, last, buf, off in T.slices(batch.column("text")):
                bucket, doc = ngrams(buf, off)
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[is_target[first:last][doc]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at.astype(np.int32)), "raw": pa.array(raw[at]), "target": pa.array(target[at])})

    rows = flagged.select("text", "is_target").mapInArrow(released(count), "bucket int, raw long, target long")
    return rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """log(target / raw) of every bucket; share of well-rated documents among the rated ones."""
    rated = labels.select("doc_id", "quality").filter("doc_id is not null and quality is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n, good = rated.agg(F.count("*"), F.coalesce(F.sum((F.col("quality") > 0).cast("int")), F.lit(0))).first()
    wanted = rated.filter("quality > 0").select("doc_id", F.lit(True).alias("is_target"))
    if good > sample_rows:
        wanted = wanted.filter(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) < int((1 << 30) * sample_rows / good))
    # Bounded by sample_rows, so it can be sent to all tasks.
    flagged = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id", "left").select("text", F.coalesce("is_target", F.lit(False)).alias("is_target"))
    counts = count_ngrams(flagged).toPandas()  # at most BUCKETS rows
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[counts["bucket"]], target[counts["bucket"]] = counts["raw"], counts["target"]
    if not good or not target.sum():
        return np.zeros(BUCKETS), 1.0
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS)), good / n


def kth_largest(keys: DataFrame, k: int) -> tuple[float, int | None] | None:
    """(key, doc_id) of the k-th row by falling key, then by id (nulls last); None if there are fewer. keys: doc_id, key."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    if low is None or k < 1:
        return None
    rows = keys
    while True:
        width = (high - low) / BINS
        if width <= 0 or low + width == low:
            break
        bin_ = F.least(F.floor((F.col("key") - low) / width), F.lit(BINS - 1))
        counts = dict(map(tuple, rows.groupBy(bin_.alias("b")).count().collect()))  # at most BINS rows
        if sum(counts.values()) < k:
            return None
        for b in sorted(counts, reverse=True):
            if counts[b] >= k:
                break
            k -= counts[b]
        rows = rows.filter(bin_ == b)
        low, high = rows.agg(F.min("key"), F.max("key")).first()
        if counts[b] <= BINS:
            break
    if low < high:  # at most BINS rows
        last = rows.orderBy(F.desc("key"), F.asc_nulls_last("doc_id")).limit(k).orderBy("key", F.desc_nulls_first("doc_id")).first()
        return last["key"], last["doc_id"]
    # However many rows hold one key: their ids by the same refinement, none of them sorted.
    if rows.filter("doc_id is not null").count() < k:
        return low, None
    return low, _kth_smallest_id(rows, k)


def _kth_smallest_id(rows: DataFrame, k: int) -> int:
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    while low < high:
        width = -(-(high - low + 1) // BINS)
        # Division that rounds down, exact for every long.
        bin_ = F.expr(f"(doc_id - pmod(doc_id, {width}L)) div {width}L")
        counts = dict(map(tuple, rows.filter(F.col("doc_id").between(low, high)).groupBy(bin_.alias("b")).count().collect()))  # at most BINS rows
        for b in sorted(counts):
            if counts[b] >= k:
                break
            k -= counts[b]
        low, high = max(low, b * width), min(high, (b + 1) * width - 1)
    return low


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, log_ratio, key, kept of every row."""
    ratio, rated_share = log_ratios(docs, labels, sample_rows)

    def score(batches):
        for batch in batches:
            out = [np.zeros(0)]
            for first, last, buf, off in T.slices(batch.column("text")):
                bucket, doc = ngrams(buf, off)
                out.append(np.bincount(doc, weights=ratio[bucket], minlength=last - first))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "log_ratio": pa.array(np.concatenate(out))})

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(score), "doc_id long, log_ratio double")
    # A uniform number in (0, 1) from the id's hash, then Gumbel noise.
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rows = durable(scored.withColumn("key", F.col("log_ratio") - F.log(-F.log(uniform))))
    k = round((rated_share if share is None else share) * rows.count())
    last = kth_largest(rows, k)
    if last is None:
        return rows.withColumn("kept", F.lit(k > 0))
    key, doc_id = last
    tie = F.lit(True) if doc_id is None else F.coalesce(F.col("doc_id") <= doc_id, F.lit(False))
    return rows.withColumn("kept", (F.col("key") > key) | ((F.col("key") == key) & tie))


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op2_importance_resampling": op2_importance_resampling}
ORACLE_SQL: dict[str, str] = {}
