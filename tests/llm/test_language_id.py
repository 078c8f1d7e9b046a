from __future__ import annotations

import numpy as np

from turnledger.llm import language_id as L


def test_codewords_tell_languages_apart():
    for n in (2, 3, 4, 5, 9):
        code = L.codewords(n)
        assert code.shape[0] == n
        far = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(far) >= 1
        assert not (np.abs(code.sum(0)) == n).any()


def test_a_wrong_bit_is_corrected():
    code = L.codewords(4)
    model = L.Model(["a", "b", "c", "d"], code, np.zeros((L.BUCKETS, 7), np.float32), np.ones(7))
    margins = code.copy()
    margins[np.arange(4), np.arange(4)] *= -1
    best, score, lead = model.decode(margins)
    assert best.tolist() == [0, 1, 2, 3] and (score > 0.25).all()
    assert model.decode(np.zeros((1, 7)))[2][0] < 1e-9  # nothing to go by: ambiguous


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.001"
    rows = L.op1_language_id(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    both = docs.merge(rows, on="doc_id")
    test = both[both["held_out"]]
    assert len(both) == len(docs) and (test["lang"] == test["lang_pred"]).mean() > 0.95


def test_awkward_rows(awkward, nothing):
    model = L.fit(awkward)
    rows = L.identify(awkward, model).collect()
    assert len(rows) == awkward.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        assert 0 <= r.score <= 1
    for i in (4, 5, 6, 12):
        assert by[i][0].lang_pred == "und"
    assert by[13][0].lang_pred != "und"  # letters outside ASCII count
    assert L.identify(nothing, L.fit(nothing)).count() == 0
    assert {r.lang_pred for r in L.identify(awkward, None).collect()} == {"und"}
    kept = L.stage(awkward.sparkSession, awkward, "")
    assert kept.columns == awkward.columns and kept.filter("text is null").count() == 0


def test_stage_keeps_what_the_query_gives_a_language(awkward):
    more = [(30 + i, t, None, "a", len(t), True, "n", 0, 0.5) for i, t in enumerate(["😀 🎉", "— – …", "“ ” « »", "€ ° § ±", "😀", "naïve"])]
    docs = awkward.unionByName(awkward.sparkSession.createDataFrame(more, awkward.schema))
    found = L.identify(docs, L.fit(docs)).filter("lang_pred <> 'und' and not ambiguous")
    kept = L.stage(docs.sparkSession, docs, "")
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in found.collect())
    assert kept.filter("doc_id between 30 and 34").count() == 0
