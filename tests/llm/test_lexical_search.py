from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from turnledger.llm import lexical_search as S

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_force(docs, queries, k):
    counted = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    total, terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for q, t in queries:
        asked = Counter(TERM.findall((t or "").translate(LOWER)))
        found = []
        for i, c in counted:
            m = 100 - 75 + (75 * sum(c.values()) * total) // terms
            score = sum(n * math.floor(1000 * math.log((2 * total + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 8 * m)) for x, n in asked.items() if x in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(q if q is not None else -1, r + 1, -1 if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def run(spark, docs, queries, k):
    d = spark.createDataFrame([(i, t, 0.5, 3) for i, t in docs], "doc_id long, text string, score double, rank int").repartition(3)
    q = spark.createDataFrame([(t, i, "x") for i, t in queries], "text string, item_id long, doc_id string")
    return sorted((-1 if r.item_id is None else r.item_id, r.rank, -1 if r.doc_id is None else r.doc_id, r.score) for r in S.search(d, q, k).collect())


@pytest.mark.parametrize("bucket", [4, 64, 2048])
def test_equal_to_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(S, "BUCKET", bucket)
    rng = random.Random(bucket)
    words = [f"W{i}" for i in range(60)] + ["é", "Éa", "中文", "x'y", "a-B", "\x00z", "ÀB"]
    text = lambda n: " ".join(words[min(int(rng.expovariate(0.08)), len(words) - 1)] for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 5, 40, 40, 40, 400]))) for i in range(500)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)]  # copies, so ties
    docs += [(1, docs[1][1]), (1, docs[1][1]), (None, docs[8][1]), (None, None), (2000, None), (2001, " .,- \n"), (2002, text(30_000))]
    queries = [(i, text(rng.choice([1, 3, 30]))) for i in range(40)] + [(90, None), (91, ""), (92, "nowhere to be found"), (93, "w3 W3 w3 é"), (93, "w5"), (None, "w1 w9"), (94, text(3000))]
    assert run(spark, docs, queries, 10) == by_force(docs, queries, 10)


def test_in_batches(spark, monkeypatch):
    monkeypatch.setattr(S, "BATCH_TERMS", 20)
    docs = [(i, f"a{i % 3} b{i % 5} common") for i in range(40)]
    queries = [(i, f"a{i % 3} common b{i % 7}") for i in range(30)]
    assert run(spark, docs, queries, 10) == by_force(docs, queries, 10)


def test_empty(spark):
    assert run(spark, [], [(1, "a")], 10) == []
    assert run(spark, [(1, "a")], [], 10) == []
    assert run(spark, [(1, None)], [(1, "a")], 10) == []
    assert run(spark, [(1, "a")], [(1, "a a")], 10) == by_force([(1, "a")], [(1, "a a")], 10)


def test_most_documents_are_ruled_out():
    """A rare term's holders are found without scoring the rest, and short buckets are not entered."""
    n, width = 2000, 50
    rng = np.random.default_rng(3)
    counts = np.full(n, 5)
    terms = np.concatenate([np.sort(rng.choice(width - 1, 5, replace=False)) for _ in range(n)]).astype(np.int32)
    values = rng.integers(1, 100, 5 * n).astype(np.int64)
    terms[-1], values[-1] = width - 1, 5000
    bucket = S.Bucket(np.arange(n), np.ones(n, bool), terms, values, counts, width)
    dense = np.zeros(width, np.int64)
    dense[[0, 1, width - 1]] = 1
    looked = []
    reduceat = np.add.reduceat

    class Spy:
        def __getattr__(self, name):
            return getattr(np, name)

        class add:
            @staticmethod
            def reduceat(x, at):
                looked.append(len(at))
                return reduceat(x, at)

    asked = np.array([0, 1, width - 1], np.int32), np.ones(3, np.int64)
    was, S.np = S.np, Spy()
    try:
        docs, score = bucket.search(*asked, math.sqrt(3), 1000, dense)
        assert docs.tolist() == [n - 1] and looked == [1]
        assert len(bucket.search(*asked, math.sqrt(3), 10_000, dense)[0]) == 0 and looked == [1]
    finally:
        S.np = was
