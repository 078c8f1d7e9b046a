"""Language identification by error-correcting output codes.

Each language has a binary codeword. One linear n-gram classifier per codeword bit
says how far a text lies on either side of that bit; loss-weighted decoding takes the
language whose codeword has the least loss against all the margins, so a few wrong
bits are corrected, and a small lead over the second best marks the text as ambiguous.

The classifiers are naive Bayes over hashed character n-grams (1 to 3 letters, with
word ends) and whole words. They are fitted on a sample of labelled rows whose expected
size is bounded by ``sample_rows``; the counting is a Spark aggregation and only the
model's own tables (buckets x languages) come to the driver.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and not
ambiguous. Rows are independent, so ties, repeated rows, null ids and further columns
have no effect. Without any labelled row every text is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .common import held_out, released, table

BUCKETS = 1 << 16
SAMPLE_ROWS = 20_000
#: Texts whose lead over the second language is smaller are ambiguous.
MIN_LEAD = 0.02

# Letters for the features: ASCII letters and every byte of a longer UTF-8 sequence.
_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[np.r_[65:91, 97:123, 128:256]] = False


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1. All splits of the languages up to five; else random splits, kept apart."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        columns = [c for c in product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns, float).T
    bits, best = int(np.ceil(10 * np.log2(n))), None
    for seed in range(50):
        code = np.random.default_rng(seed).choice([-1.0, 1.0], (n, bits))
        if (np.abs(code.sum(0)) == n).any():
            continue
        apart = ((bits - code @ code.T) / 2 + bits * np.eye(n)).min()
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


def word_features(buf: np.ndarray, off: np.ndarray):
    """Words of a slice: their document numbers, index of the distinct word, and for each
    distinct word the (bucket, owner) pairs of its n-grams."""
    start, end, doc = T.spans(_NOT_LETTER[buf], off)
    low = T.LOWER[buf]
    hashes = T.span_hash(T.prefix_sums(low), start, end)
    distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    size = end[first] - start[first]
    # All distinct words in one buffer, each with a blank before and after.
    room = size + 2
    at = np.r_[0, np.cumsum(room)]
    line = np.full(at[-1], 0x20, np.uint8)
    owner = np.repeat(np.arange(len(size)), size)
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    line[at[:-1][owner] + 1 + inner] = low[start[first][owner] + inner]
    sums = T.prefix_sums(line)
    place = np.repeat(np.arange(len(size)), room)
    buckets, owners = [(distinct % np.uint64(BUCKETS)).astype(np.int64)], [np.arange(len(size))]
    for k in (1, 2, 3):
        h = T.rolling_hash(sums, k)
        same = place[: len(h)] == place[k - 1 : k - 1 + len(h)]
        h = T.mix(h + np.uint64(k))
        buckets.append((h[same] % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(place[: len(h)][same])
    return doc, inverse, np.concatenate(buckets), np.concatenate(owners), len(size)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits, float32
    bit_weight: np.ndarray
    min_lead: float = MIN_LEAD

    def decode(self, margins: np.ndarray):
        """(index of the best language, score, lead over the second) of each row of margins."""
        z = np.clip(4 * margins[:, None, :] * self.code[None], -30, 30)
        loss = (np.log1p(np.exp(-z)) * self.bit_weight).sum(2)
        order = np.argsort(loss, axis=1, kind="stable")
        best = order[:, 0]
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        ranked = np.take_along_axis(p, order, 1)
        lead = ranked[:, 0] - ranked[:, 1] if p.shape[1] > 1 else np.ones(len(p))
        return best, ranked[:, 0], lead

    def margins(self, buf: np.ndarray, off: np.ndarray):
        doc, inverse, buckets, owners, n = word_features(buf, off)
        bits, docs = self.code.shape[1], len(off) - 1
        if not n:
            return np.zeros((docs, bits)), np.zeros(docs)
        order = np.argsort(owners, kind="stable")
        per_word = T.sum_by_doc(self.weights[buckets[order]], owners[order], n)
        grams = np.bincount(owners, minlength=n).astype(float)
        total = T.sum_by_doc(per_word[inverse], doc, docs)
        count = T.sum_by_doc(grams[inverse], doc, docs)
        return total / np.maximum(count, 1)[:, None], count

    def predict(self, buf: np.ndarray, off: np.ndarray):
        """(language, score, ambiguous) of each document; und, 0 and not ambiguous without a letter."""
        margins, count = self.margins(buf, off)
        best, p, lead = self.decode(margins)
        ascii_letter = (T.LOWER[buf] >= 97) & (T.LOWER[buf] <= 122)
        seen = np.r_[0, np.cumsum(ascii_letter)]
        some = seen[off[1:]] > seen[off[:-1]]
        for i in np.flatnonzero(~some & (count > 0)):
            some[i] = any(c.isalpha() for c in buf[off[i] : off[i + 1]].tobytes().decode("utf-8", "ignore"))
        names = np.array(self.languages, object)[best]
        return np.where(some, names, "und"), np.where(some, p, 0.0), some & (lead < self.min_lead)


def count_features(labelled: DataFrame) -> DataFrame:
    """(lang, bucket, n) over the rows (text, lang)."""

    def count(batches):
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs], np.int64)
            tally = np.zeros((len(names), BUCKETS), np.int64)
            for first, last, buf, off in T.slices(batch.column("text")):
                doc, inverse, buckets, owners, n = word_features(buf, off)
                own = number[first:last][doc]
                for k in range(len(names)):
                    times = np.bincount(inverse[own == k], minlength=n)
                    tally[k] += np.bincount(buckets, weights=times[owners], minlength=BUCKETS).astype(np.int64)
            for k, name in enumerate(names):
                at = np.flatnonzero(tally[k])
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(tally[k][at])})

    rows = labelled.select("text", "lang").mapInArrow(released(count), "lang string, bucket int, n long")
    return rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def bounded_sample(df: DataFrame, rows: int) -> DataFrame:
    """All rows if they are at most so many, else a fixed pseudo-random share of that expected size, by a hash of the id."""
    n = df.count()
    if n <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int((1 << 30) * rows / n))


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Learns from the text and lang of the rows of docs that aren't held out."""
    known = docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null").filter(~held_out(F.col("doc_id")))
    counts = count_features(bounded_sample(known, sample_rows)).toPandas()
    if counts.empty:
        return None
    languages = sorted(counts["lang"].unique())
    n = np.zeros((len(languages), BUCKETS))
    n[[languages.index(x) for x in counts["lang"]], counts["bucket"]] = counts["n"]
    # Languages count alike, however many rows each has.
    p = (n + 0.05) / (n + 0.05).sum(1, keepdims=True)
    code = codewords(len(languages))
    weights = np.stack([np.log(p[code[:, b] > 0].mean(0)) - (np.log(p[code[:, b] < 0].mean(0)) if (code[:, b] < 0).any() else 0) for b in range(code.shape[1])], 1)
    # Margins of the languages' own counts: a bit that separates them well weighs more.
    own = p @ weights
    middle = np.array([(own[code[:, b] > 0, b].min() + (own[code[:, b] < 0, b].max() if (code[:, b] < 0).any() else 0)) / 2 for b in range(code.shape[1])])
    weights -= middle
    own -= middle
    spread = np.abs(own).mean(0) + 1e-9
    weights /= spread
    bit_weight = np.clip((own * code / spread).min(0), 0.05, None)
    return Model(list(languages), code, weights.astype(np.float32), bit_weight / bit_weight.mean())


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every row; only the text is an input."""

    def predict(batches):
        for batch in batches:
            n = batch.num_rows
            lang, score, unsure = np.full(n, "und", object), np.zeros(n), np.zeros(n, bool)
            for first, last, buf, off in T.slices(batch.column("text")):
                if model is None:
                    break
                lang[first:last], score[first:last], unsure[first:last] = model.predict(buf, off)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score), "ambiguous": pa.array(unsure)})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(released(predict), f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents without a language: no letter, or ambiguous between languages.

    Fitted on the stage's own input. Rows keep all their columns.
    """
    model = fit(docs)

    def judged(batches):
        for texts in batches:
            ok = np.zeros(len(texts), bool)
            for first, last, buf, off in T.slices(texts):
                if model is None:
                    break
                lang, _, unsure = model.predict(buf, off)
                ok[first:last] = (lang != "und") & ~unsure
            yield pa.array(ok)

    @F.arrow_udf("boolean")
    def clear(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from released(judged)(batches)

    return docs.filter(clear("text"))


QUERIES = {"op1_language_id": op1_language_id}
ORACLE_SQL: dict[str, str] = {}
