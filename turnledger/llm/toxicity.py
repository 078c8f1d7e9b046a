"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult (with a weight), threat, target, negation, report, or other.
Three small transducers read the symbols of a clause: one pairs insults and threats with a
target in the clause, one weakens what a negation shortly before governs, and one weakens what
a verb of report introduces. Their composition, made once, is a single machine that runs over
each clause holding an insult or a threat. The pairing holds back the weights of insults and
threats until a target comes, before or after them; at the end of a clause without a target
threats count nothing, and insults a small part (BARE) of their weight, for the labels call
texts toxic whose insults have no target. A document's score is a logistic function of the
summed clause weights.

The insult lexicon is a fixed seed list and what labels teach: words and word beginnings
(stems of 4 to 8 bytes) that occur in far more toxic than other documents, by a likelihood
ratio. Learning uses a sample of labelled rows whose expected size is bounded by
``sample_rows``; the lexicon is bounded by ``lexicon_size``.

Defined results: a null or empty text has no clause and gets the score of an empty text.
Texts of any length are read whole, in slices. Rows are independent, so ties, repeated rows, null ids and further columns have no effect.
Of conflicting labels of one id the higher holds. Without labels only the seed list scores. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .common import held_out, released, table

SAMPLE_ROWS = 12_000
LEXICON_SIZE = 20_000
STEMS = (4, 5, 6, 7, 8)
#: Least likelihood ratio (G), documents and log-odds of a learned entry.
MIN_G, MIN_DOCS, MIN_ODDS = 18.0, 3, 1.5

# Seed words of the classes in the four languages of the tables.
INSULTS = "idiot moron stupid dumb loser scum trash worthless pathetic disgusting clown fool dummkopf trottel imbécile connard idiota imbécil estúpido"
THREATS = "kill hurt destroy beat crush shoot stab umbringen töten tuer frapper matar golpear"
TARGETS = "you your yours u he she him her they them du dich dir ihr sie tu te toi vous usted ustedes eres él ella"
NEGATIONS = "not no never neither nor isn wasn aren don doesn nicht kein keine nie ne pas jamais nunca"
REPORTS = "said says say told wrote writes called calls quoted reported claimed sagte schrieb dit écrit dijo escribió"
SEED_WEIGHT = 2.0

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
NEGATION_REACH = 3  # words after a negation that it still governs
NEGATED, REPORTED, TARGETED = 0.4, 0.6, 1.25
#: What is left of an insult in a clause that names no target.
BARE = 0.25

_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[np.r_[65:91, 97:123, 128:256]] = False
_CLAUSE_END = np.zeros(256, bool)
_CLAUSE_END[np.frombuffer(b".!?;:\n", np.uint8)] = True


def word_hashes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    edge = np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)
    return T.span_hash(T.prefix_sums(T.LOWER[buf]), edge[:-1], edge[1:])


# --- transducers: (state, symbol) -> (state, factor on an insult or threat at this place, what happens to weights) ---

PASS, HOLD, RELEASE = range(3)


@dataclass(frozen=True)
class Transducer:
    start: int
    steps: dict  # (state, symbol) -> (state, factor, PASS: counts now, HOLD: waits, RELEASE: all that waits counts)


def negation() -> Transducer:
    """State: how many words a negation still governs."""
    steps = {}
    for left in range(NEGATION_REACH + 1):
        for symbol in range(6):
            steps[left, symbol] = (NEGATION_REACH if symbol == NEGATION else max(0, left - 1), NEGATED if left else 1.0, PASS)
    return Transducer(0, steps)


def reported_speech() -> Transducer:
    """State: 1 after a verb of report, to the clause's end."""
    return Transducer(0, {(s, y): (1 if s or y == REPORT else 0, REPORTED if s else 1.0, PASS) for s in (0, 1) for y in range(6)})


def abuse() -> Transducer:
    """Pairs insults and threats with a target. States: no target yet, one or more wait for a target, target named."""
    nothing, waiting, named = range(3)
    steps = {}
    for state in (nothing, waiting, named):
        for symbol in range(6):
            if symbol in (INSULT, THREAT):
                steps[state, symbol] = (named, TARGETED, PASS) if state == named else (waiting, TARGETED, HOLD)
            elif symbol == TARGET:
                steps[state, symbol] = (named, 0.0, RELEASE if state == waiting else PASS)
            else:
                steps[state, symbol] = (state, 0.0, PASS)
    return Transducer(nothing, steps)


def compose(*parts: Transducer) -> Transducer:
    """One machine that runs all parts at once: the product of their factors, the strongest of their acts. Only states that can be reached."""
    number = {tuple(p.start for p in parts): 0}
    queue, steps = list(number), {}
    for state in queue:
        for symbol in range(6):
            to = [p.steps[s, symbol] for p, s in zip(parts, state)]
            after = tuple(t[0] for t in to)
            if after not in number:
                number[after] = len(number)
                queue.append(after)
            steps[number[state], symbol] = (number[after], float(np.prod([t[1] for t in to])), max(t[2] for t in to))
    return Transducer(0, steps)


GRAMMAR = compose(abuse(), negation(), reported_speech())


def clause_parts(symbols, weights, grammar: Transducer = GRAMMAR) -> tuple[float, float]:
    """Weight of one clause that is paired with a target, and of insults without one: symbols and, for insults and threats, their weights."""
    state, total, insults, threats = grammar.start, 0.0, 0.0, 0.0
    for symbol, weight in zip(symbols, weights):
        state, factor, act = grammar.steps[state, symbol]
        if act == HOLD:
            if symbol == INSULT:
                insults += factor * weight
            else:
                threats += factor * weight
            continue
        if act == RELEASE:
            total += insults + threats
            insults = threats = 0.0
        total += factor * weight
    return total, insults * BARE / TARGETED  # what waits for a target in vain


def clause_weight(symbols, weights, grammar: Transducer = GRAMMAR) -> float:
    return sum(clause_parts(symbols, weights, grammar))


# --- words of a slice ---


def distinct_words(buf: np.ndarray, off: np.ndarray):
    """start, document and clause numbers of the words; index of the distinct word; features of each distinct word."""
    start, end, doc = T.spans(_NOT_LETTER[buf], off)
    low = T.prefix_sums(T.LOWER[buf])
    h = T.span_hash(low, start, end)
    distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    a, size = start[first], (end - start)[first]
    # A stem's hash differs from that of the same string as a whole word.
    stems = np.stack([np.where(size > n, T.span_hash(low, a, np.minimum(a + n, end[first])) ^ np.uint64(n), np.uint64(0)) for n in STEMS], 1) if len(a) else np.zeros((0, len(STEMS)), np.uint64)
    return start, doc, inverse, distinct, stems


def count_features(labelled: DataFrame) -> DataFrame:
    """(feature, n_toxic, n_other): documents with each word or stem, over rows (text, toxic)."""

    def count(batches):
        for batch in batches:
            toxic = np.array(batch.column("toxic").to_pylist(), bool)
            for first, last, buf, off in T.slices(batch.column("text")):
                _, doc, inverse, distinct, stems = distinct_words(buf, off)
                if not len(doc):
                    continue
                # Distinct (document, word) pairs, then distinct (document, feature) pairs.
                pair = np.unique(doc.astype(np.int64) * len(distinct) + inverse)
                d, w = pair // len(distinct), pair % len(distinct)
                f = np.concatenate([distinct[w], *(stems[w, k] for k in range(len(STEMS)))])
                dd = np.tile(d, 1 + len(STEMS))
                features, number = np.unique(f, return_inverse=True)
                both = np.unique(number.astype(np.int64) * (last - first) + dd)
                number, dd = both // (last - first), both % (last - first)
                is_toxic = toxic[first:last][dd]
                n1 = np.bincount(number[is_toxic], minlength=len(features))
                n0 = np.bincount(number[~is_toxic], minlength=len(features))
                ok = features != 0
                yield pa.RecordBatch.from_pydict({"feature": pa.array(features[ok].view(np.int64)), "n_toxic": pa.array(n1[ok].astype(np.int64)), "n_other": pa.array(n0[ok].astype(np.int64))})

    rows = labelled.select("text", "toxic").mapInArrow(released(count), "feature long, n_toxic long, n_other long")
    return rows.groupBy("feature").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_other").alias("n_other"))


@dataclass
class Model:
    entries: np.ndarray  # sorted feature hashes
    symbol: np.ndarray
    weight: np.ndarray
    slope: float = 1.5
    bias: float = -2.5

    def raw(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Summed clause weights of each document."""
        return self.parts(buf, off).sum(1)

    def parts(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Of each document two sums: weights of clauses that name a target, and of insults without one."""
        n = len(off) - 1
        start, doc, inverse, distinct, stems = distinct_words(buf, off)
        out = np.zeros((n, 2))
        if not len(start):
            return out
        symbol, weight = np.zeros(len(distinct), np.int8), np.zeros(len(distinct))
        for f in (distinct, *(stems[:, k] for k in range(len(STEMS)))):
            at = np.minimum(np.searchsorted(self.entries, f), len(self.entries) - 1)
            # A word that the grammar itself knows keeps its part in it, whatever its stems mean.
            hit = (self.entries[at] == f) & (f != 0) & (symbol <= INSULT) & (self.weight[at] >= weight) & ((symbol == OTHER) | (self.weight[at] > weight))
            symbol[hit], weight[hit] = self.symbol[at[hit]], self.weight[at[hit]]
        word_symbol = symbol[inverse]
        ends = np.cumsum(_CLAUSE_END[buf])
        clause = ends[start]
        bad = np.flatnonzero((word_symbol == INSULT) | (word_symbol == THREAT))
        done = (-1, -1)
        for i in bad:
            if (doc[i], clause[i]) == done:
                continue
            done = (doc[i], clause[i])
            a, b = i, i + 1
            while a > 0 and doc[a - 1] == doc[i] and clause[a - 1] == clause[i]:
                a -= 1
            while b < len(doc) and doc[b] == doc[i] and clause[b] == clause[i]:
                b += 1
            out[doc[i]] += clause_parts(word_symbol[a:b].tolist(), weight[inverse[a:b]].tolist())
        return out

    def score(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * np.log1p(raw) + self.bias)))


def _model(features: np.ndarray, weights: np.ndarray) -> Model:
    hashes, symbols, weight = [], [], []
    seeds = ((THREATS, THREAT, SEED_WEIGHT / 4), (TARGETS, TARGET, 0), (NEGATIONS, NEGATION, 0), (REPORTS, REPORT, 0), (None, INSULT, None), (INSULTS, INSULT, SEED_WEIGHT))
    for words, kind, w in seeds:
        h = features if words is None else word_hashes(words.split())
        hashes.append(h)
        symbols.append(np.full(len(h), kind))
        weight.append(weights if words is None else np.full(len(h), float(w)))
    h, s, w = np.concatenate(hashes), np.concatenate(symbols), np.concatenate(weight)
    # Of entries for the same word the first stays: one the grammar knows, then a learned one.
    h, first = np.unique(h, return_index=True)
    return Model(h, s[first].astype(np.int8), w[first])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, lexicon_size: int = LEXICON_SIZE) -> Model:
    """Learns from the labelled documents that aren't held out."""
    known = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > sample_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 30)) < int((1 << 30) * sample_rows / n))
    # Bounded by sample_rows, so it can be sent to all tasks.
    labelled = docs.select("doc_id", "text").join(F.broadcast(known.withColumn("toxic", F.col("toxic") > 0)), "doc_id")
    n1, n0 = (labelled.agg(F.count(F.when(F.col("toxic"), 1)), F.count(F.when(~F.col("toxic"), 1))).first()) if n else (0, 0)
    if not n1 or not n0:
        return _model(np.zeros(0, np.uint64), np.zeros(0))
    a, b = F.col("n_toxic"), F.col("n_other")
    share = n1 / (n1 + n0)
    odds = F.log((a + 0.5) / (n1 + 1.0)) - F.log((b + 0.5) / (n0 + 1.0))

    def part(k, expected):
        return F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)

    g = 2 * (part(a, (a + b) * share) + part(b, (a + b) * (1 - share)))
    found = count_features(labelled).filter(a >= MIN_DOCS).select("feature", odds.alias("odds"), g.alias("g")).filter((F.col("odds") >= MIN_ODDS) & (F.col("g") >= MIN_G))
    found = found.orderBy(F.desc("g"), "feature").limit(lexicon_size).toPandas()
    model = _model(found["feature"].to_numpy().astype(np.int64).view(np.uint64), found["odds"].to_numpy(float))

    # The logistic curve over the sample's own clause weights.
    def raw(batches):
        for batch in batches:
            values = np.concatenate([model.raw(buf, off) for _, _, buf, off in T.slices(batch.column("text"))] or [np.zeros(0)])
            yield pa.RecordBatch.from_pydict({"raw": pa.array(values), "toxic": batch.column("toxic")})

    pairs = labelled.select("text", "toxic").mapInArrow(released(raw), "raw double, toxic boolean").toPandas()  # at most the sample
    x = np.stack([np.log1p(pairs["raw"].to_numpy()), np.ones(len(pairs))], 1)
    y = pairs["toxic"].to_numpy(float)
    w = np.array([1.5, -2.5])
    for _ in range(30):  # Newton's method, with a small penalty as the classes may be separable
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 0.1 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
    model.slope, model.bias = float(max(w[0], 0.1)), float(w[1])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every row, and by_clause: whether matched clauses alone give that verdict. Only the text is an input."""

    def run(batches):
        for batch in batches:
            values = np.concatenate([model.parts(buf, off) for _, _, buf, off in T.slices(batch.column("text"))] or [np.zeros((0, 2))])
            p = model.score(values.sum(1))
            by_clause = (model.score(values[:, 0]) >= 0.5) == (p >= 0.5)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32)), "by_clause": pa.array(by_clause)})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {kind}, score double, predicted int, by_clause boolean")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "by_clause")


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLE_SQL: dict[str, str] = {}
