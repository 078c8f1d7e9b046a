from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from turnledger.llm import prefix_trie as P


def digest(role, text):
    r = (role or "").encode()
    return hashlib.sha256(str(len(r)).encode() + b":" + r + (text or "").encode()).hexdigest()[:32]


def by_force(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role, text), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + v[h:])
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    children, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for key in members:
        if key:
            children[key[:-1]] += 1
    for key in members:
        for d in range(len(key) + 1):
            leaves[key[:d]] += not children[key]
            saved[key[:d]] += (len(members[key]) - 1) * len(key[-1][1].encode()) if key else 0
    out = []
    for key, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(key))
        out.append((min(m), len(key), min(members[key[:-1]]) if key else -1, len(m), children[key], leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "conv_id long, turn long, role string, text string, num string, size double").repartition(3)
    return sorted(tuple(-1 if x is None else x for x in r) for r in P.trie(df, P.shared_heads).collect())


def talks(seed, n, words, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < 0.9:  # some are absent
            rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(words)) for t in range(rng.choice([1, 2, 3, 5, 8, longest]))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_bits, slab", [(10, 64), (2, 3)])
def test_equal_to_brute_force(spark, monkeypatch, shard_bits, slab):
    monkeypatch.setattr(P, "SHARD_BITS", shard_bits)
    monkeypatch.setattr(P, "SLAB", slab)
    rows = talks(1, 120, ["a", "é", "", "long " * 50], 12)
    rows += [(1000 + i, t, "user", f"copy {t}") for i in range(40) for t in range(9)]  # a group of copies
    rows += [(5, None, None, None), (5, None, "user", None), (5, 2, None, "x"), (5, 2, None, "x"), (None, 1, "user", "lost"), (7777, None, None, None)]
    rows += [(3001, 0, "user", "own")]  # its base is absent
    rows += [(4000, t, "user", "y" * (t % 7)) for t in range(150)] + [(4001, t, "user", "y" * (t % 7)) for t in range(200)]
    rows += [(2**62 + 3, 0, "user", "z" * 200_000), (2**62 + 3, 1, "user", "z")]
    assert run(spark, rows) == by_force(rows)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "user", "a")]) == []


def test_one_long_conversation(spark):
    """Slabs bound what a task holds; the deep chain is summed in rounds of doubling."""
    rows = [(0, t, "user", str(t % 10)) for t in range(5000)] + [(2, t, "user", str(t % 10)) for t in range(4000)]
    assert run(spark, rows) == by_force_chain(rows)


def by_force_chain(rows):
    n = sum(r[0] == 0 for r in rows)
    m = sum(r[0] == 2 for r in rows)  # built from the same first turns, so a prefix of the other
    size = [0] + [1] * n
    saved = [0] * (n + 2)
    for d in range(n, -1, -1):
        saved[d] = saved[d + 1] + (size[d] if d <= m else 0)
    ends = {n: "0", m: "2"}
    sha = lambda d: hashlib.sha256(ends.get(d, "").encode()).hexdigest()
    return sorted((0, d, 0 if d else -1, 1 + (d <= m), int(d < n), 1, saved[d], sha(d)) for d in range(n + 1))
