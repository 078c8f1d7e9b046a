from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnledger.llm import near_dedup as N
from turnledger.llm import suffix_dedup as S
from turnledger.llm.graph import components


def removed_by_force(rows, length):
    """(bytes left, spans) of each (doc_id, text) row in table order."""
    seen, out = set(), []
    for text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_suffix_dedup_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    piece = ["".join(rng.choice("ab \né") for _ in range(rng.randrange(20, 260))) for _ in range(12)]
    texts = ["".join(rng.choice(piece) for _ in range(rng.randrange(8))) for _ in range(60)] + ["a" * 400, "a" * 150, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = sorted(S.remove_repeats(docs).collect(), key=lambda r: r.doc_id)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == removed_by_force(texts, 100)


def test_suffix_dedup_in_blocks_and_without_trust_in_hashes(spark, monkeypatch):
    """A long document in several blocks, and hashes of gram and surroundings that collide all the time."""
    rng = random.Random(9)
    piece = ["".join(rng.choice("abc é") for _ in range(rng.randrange(90, 300))) for _ in range(6)]
    texts = ["".join(rng.choice(piece) + rng.choice("xyz") for _ in range(40)), *("".join(rng.choice(piece) for _ in range(3)) for _ in range(12))]
    monkeypatch.setattr(S, "BLOCK_BYTES", 700)
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    whole = list(zip(*S.anchors(buf, off, 100)))
    starts = lambda found: sorted((a, s) for a, lo, hi in found for s in range(lo, hi + 1))
    assert starts(whole) == starts(t for at, lo, hi, _ in S.blocked_anchors(buf, off, 100, 700) for t in zip(at, lo, hi))
    rows = []
    keys = [b"\0" * 8 + x for x in (b"s" * 40 + b"one" + b"e" * 80, b"s" * 40 + b"one" + b"e" * 80, b"s" * 40 + b"two" + b"e" * 80)]
    lefts = [b"l" * 68, b"k" + b"l" * 67, b"l" * 68]
    code = np.array([(100 << 16) | (0 << 8) | 68] * 3)
    entry = (np.array([1, 2, 3]), np.zeros(3, np.int32), code, keys, lefts)
    S._resolve([(0, i) for i in range(3)], S.shared_prefixes(keys).tolist(), [entry], 100, lambda *x: rows.extend(zip(*(c.tolist() for c in x))))
    # The second shares all but the first byte before; the third only what ends before its own word.
    assert sorted(rows) == [(2, 0, 33, 200), (3, 0, 32, 140)]


def test_suffix_dedup_awkward_rows(awkward, nothing):
    rows = S.remove_repeats(awkward).collect()
    assert len(rows) == awkward.count()
    # The rows with null ids come first, so of five equal texts all others go.
    gone = sorted(str(r.doc_id) for r in rows if r.n_bytes and r.n_removed == r.n_bytes)
    assert {"1", "2"} <= set(gone) and gone.count("2") == 2 and "None" not in gone
    assert S.remove_repeats(nothing).count() == 0
    out = S.stage(awkward.sparkSession, awkward, "")
    assert out.columns == awkward.columns and out.filter("doc_id = 9").count() == 2


def test_suffix_dedup_stage_cuts_each_row_by_itself(awkward):
    rng = random.Random(8)
    x, y, z, u = ("".join(rng.choice("abcdefg ") for _ in range(200)) for _ in range(4))
    more = [(20, x), (20, x), (21, y + " one"), (21, z + " two"), (22, "three " + z + y), (22, "four " + x), (None, u), (None, u), (None, u + " five")]
    docs = awkward.unionByName(awkward.sparkSession.createDataFrame([(i, t, "en", "a", len(t), True, "n", 0, 0.5) for i, t in more], awkward.schema))
    seen, want = set(), []
    for r in docs.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64(F.coalesce("text", F.lit("")))).collect():
        b = (r.text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        left = bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore")
        if not any(gone):
            want.append(tuple(r))
        elif left.strip(" \t\n\v\f\r"):
            want.append((r.doc_id, left, r.lang, r.source, len(left), *r[5:]))
    got = [tuple(r) for r in S.stage(awkward.sparkSession, docs, "").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[:2] == (20, x) for r in got) == 1  # of a repeated row the first stays


def test_loser_tree_merges_and_knows_shared_prefixes():
    rng = random.Random(4)
    for _ in range(30):
        runs = []
        for _ in range(rng.randrange(1, 9)):
            keys = sorted("".join(rng.choice("ab") for _ in range(rng.randrange(6))).encode() for _ in range(rng.randrange(12)))
            runs.append((keys, S.shared_prefixes(keys).tolist() if keys else []))
        order, shared = S.merge_runs(runs)
        merged = [runs[r][0][p] for r, p in order]
        assert merged == sorted(k for keys, _ in runs for k in keys)
        if merged:
            assert shared == S.shared_prefixes(merged).tolist()


def links_by_force(texts, k, percent):
    sets = []
    for t in texts:
        w = "".join(c.lower() if c.isascii() else c for c in (t or "")).split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    label = list(range(len(sets)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("k", [2, 5])
def test_near_dedup_equals_brute_force(spark, k):
    rng = random.Random(k)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(k, 90))]
        for _ in range(rng.randrange(1, 14)):  # variants around the threshold
            words = [w if rng.random() > 0.02 * rng.randrange(5) else f"v{rng.randrange(9999)}" for w in base]
            texts.append(" ".join(words))
    texts += [None, "", "one", "one", "One", "two words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = sorted(N.link_documents(docs, shingle_words=k).collect(), key=lambda r: r.doc_id)
    assert [(r.n_shingles, r.component_id) for r in rows] == links_by_force(texts, k, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_dedup_awkward_rows(awkward, nothing):
    rows = N.link_documents(awkward, shingle_words=2).collect()
    assert len(rows) == awkward.count()
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, set()).add(r.component_id)
        if r.doc_id is None:
            assert r.component_id is None and r.kept
    assert of[1] == of[2] == {1} and of[4] == {4} and of[5] == {5}
    assert N.link_documents(nothing).count() == 0
    kept = N.stage(awkward.sparkSession, awkward, "")
    assert kept.columns == awkward.columns and kept.filter("doc_id = 2").count() == 0
    again = N.stage(awkward.sparkSession, awkward.unionByName(awkward), "")
    ids = sorted((r.doc_id or 0, r.text or "") for r in again.collect())
    # Of repeated rows one stays; rows without an id or a word are linked with nothing.
    free = awkward.filter(r"doc_id is null or text is null or not text rlike '[^\\x20\\x09-\\x0D]'")
    assert ids == sorted([(r.doc_id or 0, r.text or "") for r in kept.collect()] + [(r.doc_id or 0, r.text or "") for r in free.collect()])


def test_frequent_shingles_in_cells(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL_ROWS", 3)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(w if rng.random() > 0.03 * rng.randrange(4) else f"v{rng.randrange(9999)}" for w in base) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(N.link_documents(docs, shingle_words=2).collect(), key=lambda r: r.doc_id)
    assert [(r.n_shingles, r.component_id) for r in rows] == links_by_force(texts, 2, 80)


def test_size_bound_is_of_each_text_of_an_id(spark):
    words = [f"w{i}" for i in range(100)]
    texts = [(1, " ".join(words)), (1, " ".join(f"v{i}" for i in range(1000))), (2, " ".join([*words[:98], "x", "y"]))]
    open_ = spark.createDataFrame([(1, 1, 999), (2, 2, 99)], "node long, comp long, n long")
    pairs = N._prefix_pairs(open_, spark.createDataFrame(texts, "node long, text string"), 2, 80)
    assert [tuple(r) for r in pairs.collect()] == [(1, 2)]


def test_estimate_is_corrected_for_chance():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (200, 140), dtype=np.uint8)
    b = rng.integers(0, 256, (200, 140), dtype=np.uint8)
    assert abs(N.estimate(a, b, 560).mean()) < 0.02 and N.estimate(a, a, 560).min() == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    label = {r.node: r.label for r in rows}
    assert all(label[i] == 0 for i in range(41)) and label[101] == label[102] == 100 and 200 not in label
