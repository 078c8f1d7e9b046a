from __future__ import annotations

import numpy as np
import pytest

from turnledger.llm import topk_search as K


def by_force(rows, k, is_query):
    ok = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(ok):
        if is_query(q):
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(ok) if m != n)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("n", [3, 40, 1500])
def test_equal_to_brute_force(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in rng.normal(size=12) * rng.choice([0.1, 1, 3])]) for i in range(n)]
    rows += [(n + i, rows[1][1]) for i in range(min(n, 700))]  # one common vector, so ties
    rows += [(10_000, None), (10_050, [1.0, None] + [0.0] * 10), (10_100, [float("nan")] * 12), (10_150, [float("inf")] * 12), (None, [1.0] * 12)]
    # Repeated queries and candidates, shorter vectors and an empty one.
    rows += [(50, rows[0][1]), (50, rows[2][1]), (50, rows[2][1]), (7, rows[0][1]), (100, [2.0, -1.0]), (20_001, [3.0] * 5), (20_050, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = sorted(tuple(r) for r in K.top_k(df, 5, lambda c: c % 50 == 0).collect())
    assert got == by_force(rows, 5, lambda i: i % 50 == 0)


def test_empty(spark):
    assert K.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), 5, lambda c: c % 50 == 0).count() == 0


def test_rules_out(spark):
    """On clusters of unequal length most rows are never compared, and the result is still the exact one."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 16)) * rng.choice([0.2, 0.5, 1, 2, 4], size=(60, 1))
    rows = [(i, [float(x) for x in centres[i % 60] + rng.normal(size=16) * 0.02]) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asks = lambda i: i % 100 == 0
    found, work = K.search(df, 5, asks)
    assert sorted(tuple(r) for r in found.collect()) == by_force(rows, 5, asks)
    scored = {r.query_id: r.scored for r in work.collect()}
    assert sorted(scored) == [i for i, _ in rows if asks(i)]
    assert sum(scored.values()) < 0.25 * len(scored) * len(rows)


def test_bands_by_length():
    assert K.band_starts(np.full(100, 65536.0)) == []
    assert K.band_starts(np.r_[np.full(50, 100.0), np.full(50, 10_000.0)]) == [10_000.0]
    assert K.band_starts(np.zeros(5)) == []


def test_scores_beyond_doubles(spark):
    """Squared lengths over 2^53: neighbouring scores differ in their last digit only."""
    big = float(1 << 21)
    rows = [(0, [big, big, 1 / 256])] + [(i, [big, big, i / 256]) for i in range(1, 30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in K.top_k(df, 5, lambda c: c == 0).collect()) == by_force(rows, 5, lambda i: i == 0)
