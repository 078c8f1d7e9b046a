"""Scores of op2 and op8 against plain Python over whole tables."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from turnledger.llm import importance as I
from turnledger.llm import toxicity as X

SF = "/root/testdata/sf0.001"
LETTERS = re.compile(rb"[A-Za-z\x80-\xff]+")


def entry_of(model, known, word):
    """Symbol and weight of a word: its own entry, or a stem's of more weight."""
    symbol, weight = X.OTHER, 0.0
    keys = [(word, 0)] + [(word[:n], n) for n in X.STEMS if len(word) > n]
    for key, n in keys:
        if (key, n) not in known:
            buf = np.frombuffer(key, np.uint8)
            h = X.T.span_hash(X.T.prefix_sums(buf), np.array([0]), np.array([len(key)]))[0] ^ np.uint64(n)
            at = np.searchsorted(model.entries, h)
            hit = at < len(model.entries) and model.entries[at] == h
            known[key, n] = (int(model.symbol[at]), float(model.weight[at])) if hit else None
        e = known[key, n]
        if e and symbol in (X.OTHER, X.INSULT) and (e[1] >= weight if symbol == X.OTHER else e[1] > weight):
            symbol, weight = e
    return symbol, weight


def parts_by_force(model, text, known):
    matched = bare = 0.0
    for clause in re.split(rb"[.!?;:\n]", (text or "").encode()):
        found = [entry_of(model, known, w.lower()) for w in LETTERS.findall(clause)]
        symbols = [s for s, _ in found]
        for i, (s, w) in enumerate(found):
            if s not in (X.INSULT, X.THREAT):
                continue
            w *= X.NEGATED if X.NEGATION in symbols[max(0, i - X.NEGATION_REACH) : i] else 1.0
            w *= X.REPORTED if X.REPORT in symbols[:i] else 1.0
            if X.TARGET in symbols:
                matched += w * X.TARGETED
            elif s == X.INSULT:
                bare += w * X.BARE
    return matched, bare


def test_toxicity_equals_plain_clauses(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = X.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = [r.text for r in docs.select("text").collect()]
    texts += [None, "", "you are no idiot at all", "they said you idiot. kill", "KILL them; trash", "not a single, idiot he said: fool", "é idiot\nyou"]
    known: dict = {}
    want = np.array([parts_by_force(model, t, known) for t in texts])
    got = np.concatenate([model.parts(buf, off) for _, _, buf, off in X.T.slices(pa.array(texts))])
    assert np.allclose(got, want) and (want.sum(1) > 0).sum() > 5
    again = {r.doc_id: r for r in X.op8_toxicity(spark, SF).collect()}
    for r, row in zip(docs.select("doc_id").collect(), want):
        assert abs(again[r.doc_id].score - float(model.score(row.sum()))) < 1e-9
        alone = int(model.score(row[0]) >= 0.5)
        assert again[r.doc_id].by_clause == (alone == again[r.doc_id].predicted)


def tokens(text):
    return re.findall(rb"[A-Za-z0-9_\x80-\xff]+|[^A-Za-z0-9_\x80-\xff\x20\x09-\x0d]+", (text or "").encode())


def buckets(text):
    """Buckets of a text's tokens and pairs of tokens, with repeats."""
    one = [X.T.span_hash(X.T.prefix_sums(np.frombuffer(t, np.uint8)), np.array([0]), np.array([len(t)])) for t in tokens(text)]
    pairs = [X.T.mix(a * np.uint64(0xD6E8FEB86659FD93) + b) for a, b in zip(one, one[1:])]
    return Counter(int(h[0] % np.uint64(I.BUCKETS)) for h in one + pairs)


def test_importance_equals_plain_counts(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = {r.doc_id for r in docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).select("doc_id").collect()}
    rated = {r.doc_id: r.quality for r in labels.collect() if r.doc_id not in held}
    bags = {r.doc_id: buckets(r.text) for r in docs.select("doc_id", "text").collect()}
    raw, target = Counter(), Counter()
    for i, bag in bags.items():
        raw.update(bag)
        if rated.get(i):
            target.update(bag)
    n_raw, n_target = raw.total() + I.BUCKETS, target.total() + I.BUCKETS
    ratio = {b: np.log((target[b] + 1) / n_target) - np.log((raw[b] + 1) / n_raw) for b in raw}
    rows = I.op2_importance_resampling(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(bags)
    for r in rows:
        assert abs(r.log_ratio - sum(ratio[b] * n for b, n in bags[r.doc_id].items())) < 1e-6
    k = round(sum(v > 0 for v in rated.values()) / len(rated) * len(rows))
    best = sorted(rows, key=lambda r: (-r.key, r.doc_id))[:k]
    assert {r.doc_id for r in rows if r.kept} == {r.doc_id for r in best}
