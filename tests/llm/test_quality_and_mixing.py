from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from turnledger.llm import importance as I
from turnledger.llm import mixing as M
from turnledger.llm import quality_rules as Q
from turnledger.llm import toxicity as X

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def features(text):
    text = text or ""
    w = WORD.findall(text)
    tri = Counter(zip(w, w[1:], w[2:]))
    cover = {i + j for i, t in enumerate(zip(w, w[1:], w[2:])) if tri[t] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


def test_rule_features_equal_brute_force(awkward, nothing):
    rows = Q.judge(awkward).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    got = Counter((r.doc_id, *list(r)[1:6]) for r in rows)
    assert got == Counter((d.doc_id, *features(d.text)) for d in awkward.collect())
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
    assert Q.judge(nothing).count() == 0


def rejected_by_force(text):
    """Whether a rule after the base rejects."""
    text = text or ""
    words, chars, symbols, dup, _ = features(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    upper = sum(unicodedata.category(c) == "Lu" for c in text)
    bullets = sum(bool(re.match(r"[\x20\x09-\x0D]*[-*\u2022\u25cf]", x)) for x in lines)
    dots = sum(bool(re.search(r"(\.\.\.|\u2026)[\x20\x09-\x0D]*$", x)) for x in lines)
    bare = sum(not re.search(r"[A-Za-z\u0080-\U0010ffff]", w) for w in WORD.findall(text))
    return 100 * symbols > 5 * chars or 100 * upper > 40 * chars or 100 * dup > 40 * len(lines) or chars > 15 * words or 100 * bullets > 90 * len(lines) or 100 * dots > 30 * len(lines) or 100 * bare > 50 * words


def test_verdicts_equal_brute_force(spark, awkward):
    words = ["alpha", "BETA", "12", "gamma...", "x\u2026", "#", "- a", "\u2022 b", "\n", "e\n", "\u00c9T\u00c9", "--", "longlonglonglonglong"]
    rng = random.Random(3)
    texts = [" ".join(rng.choice(rng.sample(words, 4) + [f"w{k}"]) for k in range(80)) for _ in range(150)]
    texts += [sign + "\n".join(f"{lead}line {i} of a text{end}" for i in range(20)) for sign in ("", "# ") for lead in ("", "- ", "* ") for end in ("", "...", "\u2026 ")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for d in (docs, awkward):
        for r in Q.judge(d).join(d.select("doc_id", "text"), "doc_id").collect():
            if d is docs:
                assert r.kept == (not r.base_failed and not rejected_by_force(r.text)), (r.text, r.rejected_by)
            assert r.kept == (not r.base_failed and r.rejected_by is None)


def test_costs_are_those_of_rules(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 300) for i in range(300)], "doc_id long, text string")
    dear = F.regexp_count("_text", F.lit(r"(\p{Lu}|\p{Ll}|\d)+?\s")) < 0
    rules = [Q.Rule("dear", dear), Q.Rule("cheap", F.col("n_words") < 0)]
    cost = {r.name: c for r, _, c in Q.measure(Q.with_features(docs), rules)}
    assert cost["dear"] > 5 * cost["cheap"]


def test_order_of_rules_leaves_the_verdict(awkward):
    rules = Q.default_rules()
    verdicts = [sorted(map(tuple, Q.judge(awkward, r).select(F.coalesce("doc_id", F.lit(-1)), "kept").collect())) for r in (rules, rules[::-1], rules[:0])]
    assert verdicts[0] == verdicts[1]
    measured = [(rules[0], 0.1, 1.0), (rules[1], 0.1, 0.1), (rules[2], 0.0, 0.01)]
    assert Q.order_rules(measured) == [rules[1], rules[0], rules[2]]


def test_targets():
    t = M.targets(pd.DataFrame({"source": ["b", None, "a"], "size": [100, 1000, 10]}))
    assert t["source"].tolist()[:2] == ["a", "b"] and t["target"].tolist() == [30, 300, 780]
    assert M.targets(pd.DataFrame({"source": [], "size": []})).empty


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), "abcde"[min(4, int(rng.exponential(1.2)))]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    narrow = M.sized(docs).select("doc_id", "source", "_size", "_h")
    drawn = M.draw(narrow, narrow).toPandas()
    by = drawn.assign(taken=drawn["_size"] * drawn["_copies"]).groupby("source").agg(t=("_target", "first"), k=("taken", "sum"))
    assert (abs(by["k"] - by["t"]) <= 1).all() and drawn["_copies"].between(0, 3).all()
    again = M.draw(narrow.repartition(5), narrow.repartition(3)).toPandas()
    key = ["doc_id", "_copies"]
    assert drawn.sort_values("doc_id")[key].reset_index(drop=True).equals(again.sort_values("doc_id")[key].reset_index(drop=True))
    mixed = M.mix(docs)
    counts = Counter(r.doc_id for r in mixed.collect())
    assert counts == Counter({i: c for i, c in zip(drawn["doc_id"], drawn["_copies"]) if c})


def test_every_shard_holds_the_sources_by_their_targets(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_WORDS", 50)
    # The hot source gives about half of its words, another one and a half times its words.
    sizes = {"hot": 6000, "mid": 2000, "low": 1400, "rare": 600}
    docs = spark.createDataFrame([(f"{s}{i}", "w w w w w", s) for s, n in sizes.items() for i in range(n)], "doc_id string, text string, source string")
    rows = M.mix(docs, weights=(3.0, 2.0, 3.0, 1.0)).groupBy("shard", "source").count().toPandas()
    table = rows.pivot_table(index="shard", columns="source", values="count", fill_value=0)
    share = table.sum() / table.to_numpy().sum()
    size = table.sum(axis=1)
    assert len(table) >= 10 and size.max() < 1.5 * size.min()
    sigma = np.sqrt(share * (1 - share) / M.SHARD_BLOCKS)
    assert (abs(table.div(size, axis=0) - share) <= 4.5 * sigma).all(axis=None)


def test_mixing_counts_the_mix(spark, awkward, nothing, monkeypatch):
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    narrow = M.sized(awkward).select("doc_id", "source", "_size", "_h")
    drawn = M.draw(narrow, narrow).select("doc_id", "_size", "_source_size", "_target", F.col("_size") * F.col("_copies"))
    got = M.taken(awkward)
    assert got.columns == columns and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, drawn.collect())))
    assert M.taken(nothing).count() == 0
    sf = "/root/testdata/sf0.001"
    by = M.op5_mixing(spark, sf).agg(F.sum("taken")).first()[0]
    real = M.shard_quotas
    monkeypatch.setattr(M, "shard_quotas", lambda *a: real(*a).filter("shard > 0"))  # a fault of the tree shows
    assert (M.op5_mixing(spark, sf).agg(F.sum("taken")).first()[0] or 0) < by


def test_shard_quotas_split_exactly(spark):
    blocks = [("a", 70), ("b", 5), (None, 30)]
    rows = M.shard_quotas(spark, blocks, 7).collect()
    for source, n in blocks:
        taken = sorted(x for r in rows if r.source == source for x in range(r.first, r.first + r.n))
        assert taken == list(range(n))
    per_shard = Counter()
    for r in rows:
        per_shard[r.shard] += r.n
    assert max(per_shard.values()) - min(per_shard.values()) <= 2


def test_mix_awkward_rows(awkward, nothing):
    spark = awkward.sparkSession
    narrow = M.sized(awkward).select("doc_id", "source", "_size", "_h")
    drawn = M.draw(narrow, narrow).collect()
    assert len(drawn) == awkward.count() and all(r._copies <= 3 for r in drawn)
    assert M.stage(spark, awkward, "").columns == awkward.columns
    assert M.stage(spark, nothing, "").count() == 0


def test_grammar():
    n = lambda symbols: X.clause_weight(symbols, [1.0 if s in (X.INSULT, X.THREAT) else 0.0 for s in symbols])
    plain = n([X.OTHER, X.INSULT])
    assert n([X.TARGET, X.OTHER, X.INSULT]) > plain > n([X.NEGATION, X.OTHER, X.INSULT])
    assert n([X.REPORT, X.INSULT]) < plain and n([X.TARGET, X.OTHER]) == 0
    assert n([X.NEGATION, *[X.OTHER] * 4, X.INSULT]) == plain  # too far away to govern


def test_only_matched_clauses_weigh_in_full():
    n = lambda *symbols: X.clause_weight(symbols, [1.0 if s in (X.INSULT, X.THREAT) else 0.0 for s in symbols])
    assert n(X.THREAT, X.OTHER, X.OTHER) == 0 < n(X.THREAT, X.TARGET) == n(X.TARGET, X.OTHER, X.THREAT)
    assert n(X.INSULT, X.OTHER, X.TARGET) == n(X.TARGET, X.INSULT) == 4 * X.TARGETED * n(X.INSULT)
    assert n(X.NEGATION, X.INSULT, X.TARGET) < n(X.INSULT, X.TARGET) and n(X.INSULT, X.TARGET, X.INSULT) == 2 * n(X.INSULT, X.TARGET)
    model = X._model(X.word_hashes(["you", "kill"]), np.array([3.0, 3.0]))  # labels don't take a word's part in the grammar
    texts = ["kill the process", "beat the eggs", "take out the trash", "idiot, that is you", "you idiot", "I will kill you", "kill it. You there"]
    raw = np.concatenate([model.raw(buf, off) for _, _, buf, off in X.T.slices(pa.array(texts))])
    assert raw.tolist() == [0, 0, X.BARE * X.SEED_WEIGHT, 2.5, 2.5, 0.625, 0]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    both = X.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    wrong = (both["predicted"] != both["toxic"]).mean()
    assert wrong < 0.08 and both["score"].between(0, 1).all()


def test_toxicity_awkward_rows(awkward, nothing, labels):
    model = X.fit(awkward, labels)
    rows = X.score(awkward, model).collect()
    assert len(rows) == awkward.count() and len({r.score for r in rows if r.doc_id in (4, 5, 6)}) == 1
    assert X.score(nothing, X.fit(nothing, labels.limit(0))).count() == 0


def test_kth_largest(spark):
    rng = np.random.default_rng(3)
    keys = [(int(i), float(np.round(x, 2))) for i, x in enumerate(rng.normal(size=9000))]
    df = spark.createDataFrame(keys, "doc_id long, key double")
    order = sorted(keys, key=lambda r: (-r[1], r[0]))
    for k in (1, 17, 4000, 9000):
        assert I.kth_largest(df, k) == (order[k - 1][1], order[k - 1][0])
    assert I.kth_largest(df, 9001) is None and I.kth_largest(df.limit(0), 1) is None


def test_kth_largest_among_ties(spark):
    ids = [int(x) for x in np.random.default_rng(4).choice([*range(-5000, 5000), 2**62, -(2**62)], 9000, replace=False)]
    df = spark.createDataFrame([(i, float(n % 2)) for n, i in enumerate(ids)] + [(None, 1.0)] * 3000, "doc_id long, key double")
    ones = sorted(i for n, i in enumerate(ids) if n % 2)
    for k in (1, 100, 4500):
        assert I.kth_largest(df, k) == (1.0, ones[k - 1])
    assert I.kth_largest(df, 4501) == (1.0, None)


def test_resampling(spark, awkward, nothing, labels):
    sf = "/root/testdata/sf0.001"
    rows = I.op2_importance_resampling(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    good, bad = (rows[rows["quality"] == q]["kept"].mean() for q in (1, 0))
    assert good > 0.9 and bad < 0.5
    some = I.resample(awkward, labels, share=0.5).collect()
    assert len(some) == awkward.count() and sum(r.kept for r in some) == round(0.5 * len(some))
    assert I.resample(nothing, labels).count() == 0
