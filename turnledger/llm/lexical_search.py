"""Ranked lexical search in norm buckets.

A document is a vector with the impact of each term that any query of the batch holds, scaled by
the term's weight; a query is the counts of its terms. The score is their inner product. The
vectors are ordered by length and cut into buckets of a bounded number of documents:

* Cauchy and Schwarz: a bucket cannot hold anything for a query whose length times the bucket's
  greatest length is below the query's k-th best score so far.
* Coordinates: with the greatest value of each coordinate in the bucket, those coordinates of a
  query that together stay below that score are put aside; only documents that hold one of the
  others are looked at, and only those stay whose partial score plus a bound of the rest (the
  greatest values, or the lengths of both rests) reaches it.
* What survives is scored whole, in 64-bit integers.

The longest vectors are searched first, which gives each query a first k-th best score; then
all other buckets are, side by side, and every task raises the scores as it goes through its
buckets from long to short. Bounds only ever leave out documents that cannot be among the best k,
so the result is exact.

Queries are worked off in batches of a bounded number of terms (``BATCH_TERMS``); the batch's
terms, counts and scores so far go to all tasks, nothing that grows with the documents does.
Documents are read once for a batch, as whole texts in slices; terms are told apart by
64-bit hashes.

Defined results: a null or empty text has no terms. A query without terms, or none of whose
terms a document holds, has no rows. Equal scores go by ascending id, null ids last; rows that
share an id are documents (or queries) by themselves, and null ids take part. Fewer documents
above 0 than k give fewer rows. Further columns, whatever their names, stay out. Texts of any length count whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as T
from .common import durable, parts, released, table

#: Terms of the queries of one batch (repeats count): what goes to all tasks is about 20 bytes each.
BATCH_TERMS = 1 << 19
#: Documents of a bucket.
BUCKET = 2048
#: Longest vectors that are searched first, as a share of all and at most.
HEAD_SHARE, HEAD_MOST = 1 / 16, 1 << 17
#: Fixed values of the score.
UNIT, SLOPE, RISE, LONG = 1_000_000_000, 1000, 8, 75
#: Rounding of bounds, far above that of doubles.
SLACK = 1 + 1e-9

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def term_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document number) of each term, in order."""
    start, end, doc = T.spans(_SEPARATOR[buf], off)
    return T.span_hash(T.prefix_sums(T.LOWER[buf]), start, end), doc


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values in a row, how many each row has)."""
    off = column.offsets.to_numpy()
    return column.values.to_numpy()[off[0] : off[-1]], np.diff(off)


def query_terms(queries: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """row, id, n and hashes (all terms with repeats) of each query with a term."""

    def split(batches):
        for batch in batches:
            for a, b, buf, off in T.slices(batch.column(2)):
                h, doc = term_hashes(buf, off)
                counts = T.per_doc(doc, b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(counts), _lists(h.view(np.int64), counts)], ["row", "id", "n", "hashes"])

    some = queries.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return some.mapInArrow(released(split), "row long, id long, n long, hashes array<long>").filter("n > 0")


class Batch:
    """The queries of one batch: sorted hashes of their terms, and each query's terms and counts in a row."""

    def __init__(self, rows: list):
        self.row = [r["row"] for r in rows]
        self.id = [r["id"] for r in rows]
        each = [np.array(r["hashes"], np.int64).view(np.uint64) for r in rows]
        self.hashes = np.unique(np.concatenate(each))
        counted = [np.unique(np.searchsorted(self.hashes, h).astype(np.int32), return_counts=True) for h in each]
        self.terms = [t for t, _ in counted]
        self.counts = [c.astype(np.int64) for _, c in counted]
        self.weights = np.zeros(len(self.hashes), np.int64)


def postings(docs: DataFrame, batch: Batch, id_column: str, text_column: str) -> DataFrame:
    """id, n (all terms of the document), terms and tfs: those of the batch's terms that it holds; documents without a term are left out."""
    known = batch.hashes

    def count(batches):
        for rows in batches:
            for a, b, buf, off in T.slices(rows.column(1)):
                h, doc = term_hashes(buf, off)
                n = T.per_doc(doc, b - a)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[at] == h
                pair, tf = np.unique(doc[hit].astype(np.int64) * len(known) + at[hit], return_counts=True)
                held = T.per_doc(pair // len(known), b - a)
                out = pa.RecordBatch.from_arrays([rows.column(0)[a:b], pa.array(n), _lists((pair % len(known)).astype(np.int32), held), _lists(tf.astype(np.int32), held)], ["id", "n", "terms", "tfs"])
                yield out.filter(pa.array(n > 0))

    some = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return some.mapInArrow(released(count), "id long, n long, terms array<int>, tfs array<int>")


def weights(total: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def impacts(n: np.ndarray, tf: np.ndarray, total: int, terms: int) -> np.ndarray:
    """What one occurrence of a term in the query adds for a document, before the weight; n is the document's terms."""
    m = 100 - LONG + LONG * n * total // terms
    return UNIT * tf.astype(np.int64) // (SLOPE * tf + RISE * m)


class Bucket:
    """Documents of similar length: their vectors by document and by term."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, terms: np.ndarray, values: np.ndarray, counts: np.ndarray, width: int):
        self.ids, self.known, self.terms, self.values = ids, known, terms, values
        self.start = np.r_[0, np.cumsum(counts)]
        self.squares = np.zeros(len(ids))
        held = np.flatnonzero(counts)
        self.squares[held] = np.add.reduceat(values.astype(float) ** 2, self.start[:-1][held]) if len(held) else 0
        order = np.argsort(terms, kind="stable")
        self.by_term = order
        self.doc = np.repeat(np.arange(len(ids)), counts)[order]
        self.value = values[order]
        self.at = np.searchsorted(terms[order], np.arange(width + 1))
        self.top = np.zeros(width, np.int64)
        some = np.flatnonzero(np.diff(self.at))
        if len(some):
            self.top[some] = np.maximum.reduceat(self.value, self.at[:-1][some])
        self.longest = math.sqrt(self.squares.max(initial=0.0))

    def search(self, terms: np.ndarray, counts: np.ndarray, length: float, least: int, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, exact scores) of all that reach least; dense: the query's counts by term."""
        nothing = np.zeros(0, np.int64)
        if length * self.longest * SLACK < least:
            return nothing, nothing
        bound = counts * self.top[terms]
        order = np.argsort(-bound, kind="stable")
        bound, terms, counts = bound[order], terms[order], counts[order]
        rest = np.r_[np.cumsum(bound[::-1])[::-1], 0]  # what the coordinates from here on can add
        if rest[0] < least:
            return nothing, nothing
        focus = max(int(np.argmax(rest < least)) if rest[-1] < least else len(terms), 1)
        spans = [(self.at[t], self.at[t + 1]) for t in terms[:focus].tolist()]
        doc = np.concatenate([self.doc[a:b] for a, b in spans])
        value = np.concatenate([self.value[a:b] for a, b in spans])
        times = np.repeat(counts[:focus], [b - a for a, b in spans])
        n = len(self.ids)
        partial = np.bincount(doc, weights=value * times, minlength=n)  # exact below 2^53; the bounds' slack covers the rest
        seen = np.bincount(doc, minlength=n) > 0
        if focus < len(terms):
            squares = np.maximum(self.squares - np.bincount(doc, weights=value.astype(float) ** 2, minlength=n), 0) + 1e-6 * self.squares
            rest_length = math.sqrt(float((counts[focus:].astype(float) ** 2).sum()))
            partial = partial + np.minimum(float(rest[focus]), rest_length * np.sqrt(squares))
        docs = np.flatnonzero(seen & (partial * SLACK >= least))
        if not len(docs):
            return nothing, nothing
        size = self.start[docs + 1] - self.start[docs]
        begin = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(begin, size) + np.repeat(self.start[docs], size)
        score = np.add.reduceat(self.values[place] * dense[self.terms[place]], begin)  # a seen document holds a term
        good = score >= least
        return docs[good], score[good]


def best_rows(known: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: score falling, then ids rising, null ids last."""
    return np.lexsort((ids, ~known, -scores))[:k]


def _search(batch: Batch, vectors: DataFrame, k: int, least: list[int]) -> DataFrame:
    """query (its number in the batch), id, score: the best k of each task, where no worse than least; vectors come from long to short."""
    width = len(batch.hashes)
    given = (batch.terms, batch.counts)

    def work(batches):
        terms, counts = given
        lengths = [math.sqrt(float((c.astype(float) ** 2).sum())) for c in counts]
        floor = list(least)
        none = (np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64))
        best = [none] * len(terms)
        dense = np.zeros(width, np.int64)
        for rows in batches:
            ids = rows.column(0)
            known, ids = ids.is_valid().to_numpy(False), ids.fill_null(0).to_numpy()
            flat, size = _flat(rows.column(1))
            values, _ = _flat(rows.column(2))
            end = np.r_[0, np.cumsum(size)]
            for a in range(0, len(ids), BUCKET):
                b = min(a + BUCKET, len(ids))
                bucket = Bucket(ids[a:b], known[a:b], flat[end[a] : end[b]], values[end[a] : end[b]], size[a:b], width)
                for q in range(len(terms)):
                    dense[terms[q]] = counts[q]
                    docs, score = bucket.search(terms[q], counts[q], lengths[q], max(floor[q], 1), dense)
                    dense[terms[q]] = 0
                    if len(docs):
                        had = best[q]
                        now = tuple(np.concatenate(x) for x in zip(had, (bucket.known[docs], bucket.ids[docs], score)))
                        place = best_rows(*now, k)
                        best[q] = tuple(x[place] for x in now)
                        if len(place) == k:
                            floor[q] = max(floor[q], int(best[q][2][-1]))
        n = [len(x[1]) for x in best]
        if sum(n):
            known, ids, scores = (np.concatenate(x) for x in zip(*best))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(n)), n)), pa.array(ids, mask=~known), pa.array(scores)], ["query", "id", "score"])

    return vectors.select("id", "terms", "v").mapInArrow(released(work), "query long, id long, score long")


def _vectors(held: DataFrame, batch: Batch, total: int, all_terms: int) -> DataFrame:
    """id, terms, v and norm of every document that holds a term of weight."""
    weight = batch.weights

    def scale(batches):
        for rows in batches:
            terms, size = _flat(rows.column(2))
            tfs, _ = _flat(rows.column(3))
            n = np.repeat(rows.column(1).to_numpy(), size)
            v = impacts(n, tfs.astype(np.int64), total, all_terms) * weight[terms]
            norm = np.zeros(len(size))
            some = np.flatnonzero(size)
            if len(some):
                norm[some] = np.add.reduceat(v.astype(float) ** 2, (np.cumsum(size) - size)[some])
            yield pa.RecordBatch.from_arrays([rows.column(0), _lists(terms, size), _lists(v, size), pa.array(np.sqrt(norm))], ["id", "terms", "v", "norm"])

    return held.mapInArrow(released(scale), "id long, terms array<int>, v array<long>, norm double").filter("norm > 0")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_batch(docs: DataFrame, batch: Batch, k: int, doc_id: str, doc_text: str) -> DataFrame | None:
    """query, rank, id, score of one batch."""
    spark = docs.sparkSession
    held = durable(postings(docs, batch, doc_id, doc_text))
    total, all_terms, entries = held.agg(F.count("*"), F.sum("n"), F.sum(F.size("terms"))).first()
    if not entries:
        return None
    counted = held.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # a row for each of the batch's terms at most
    df = np.zeros(len(batch.hashes), np.int64)
    df[[r["term"] for r in counted]] = [r["count"] for r in counted]
    batch.weights = weights(total, df)
    vectors = _vectors(held, batch, total, all_terms)
    # From long to short; equal lengths are dealt by a hash, so they don't meet in one task.
    n = parts(spark, 12 * entries, 16 << 20)
    ordered = vectors.withColumn("salt", F.xxhash64("id", "terms")).repartitionByRange(n, F.desc("norm"), "salt").sortWithinPartitions(F.desc("norm"))
    ordered = durable(ordered.drop("salt"))
    head = max(BUCKET, min(HEAD_MOST, int(total * HEAD_SHARE)))
    cut = ordered.select("norm").orderBy(F.desc("norm")).limit(head).agg(F.min("norm")).first()[0]
    if cut is None:
        return None
    nothing = [0] * len(batch.id)
    first = durable(_best(_search(batch, ordered.filter(F.col("norm") > cut), k, nothing), k).drop("rank"))
    least = list(nothing)
    for r in first.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("score")).filter(F.col("n") == k).collect():  # a row a query of the batch at most
        least[r["query"]] = r["score"]
    rest = _search(batch, ordered.filter(F.col("norm") <= cut), k, least)
    return _best(first.unionByName(rest), k)


def search(docs: DataFrame, queries: DataFrame, k: int, doc_id: str = "doc_id", doc_text: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """query_id, rank, doc_id, score: the k best documents of every query."""
    spark = docs.sparkSession
    asked = durable(query_terms(queries, query_id, query_text))
    terms = asked.agg(F.sum("n")).first()[0] or 0
    out = spark.createDataFrame([], f"{query_id} long, rank int, {doc_id} long, score long")
    batches = -(-terms // BATCH_TERMS)
    for i in range(batches):
        rows = asked.filter(F.pmod(F.xxhash64("row"), F.lit(batches)) == i).orderBy("row").collect()  # about BATCH_TERMS terms
        if not rows:
            continue
        batch = Batch(rows)
        found = _search_batch(docs, batch, k, doc_id, doc_text)
        if found is not None:
            names = spark.createDataFrame(list(enumerate(batch.id)), "query long, item long")
            out = out.unionByName(found.join(F.broadcast(names), "query").select(F.col("item").alias(query_id), F.col("rank").cast("int").alias("rank"), F.col("id").alias(doc_id), "score"))
    return out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


QUERIES = {"op13_lexical_search": op13_lexical_search}

ORACLE_SQL = {
    "op13_lexical_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT row, doc_id, term, count(*)::BIGINT AS tf FROM d GROUP BY ALL),
len AS (SELECT row, sum(tf)::BIGINT AS n FROM tf GROUP BY 1),
all_ AS (SELECT count(*)::BIGINT AS N, sum(n)::BIGINT AS L FROM len),
w AS (SELECT term, floor(1000 * ln((2 * all_.N + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, all_ GROUP BY term, all_.N),
v AS (SELECT tf.row, tf.doc_id, tf.term, w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 75 + (75 * len.n * all_.N) // all_.L))) AS v FROM tf JOIN len USING (row) JOIN w USING (term), all_),
i AS (
  SELECT row, item_id, term, count(*)::BIGINT AS times FROM (
    SELECT row_number() OVER () AS row, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL),
s AS (SELECT i.row, i.item_id, v.row AS other, v.doc_id, sum(i.times * v.v)::BIGINT AS score FROM i JOIN v USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
""",
}
