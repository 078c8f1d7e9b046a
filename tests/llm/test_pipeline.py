from __future__ import annotations

import corpus_pipeline as C

from turnledger.llm.common import table


def test_stages_hand_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    columns, n = docs.columns, docs.count()
    assert [s for s, _ in C.STAGES] == ["language_id", "near_dedup", "suffix_dedup", "mixing", "packing"]
    sizes = [n]
    for name, stage in C.STAGES[:3]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        docs = docs.persist()
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[1] > 0.97 * n
    packed = C.run(spark, sf)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert packed.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0


def test_awkward_and_empty_documents(spark, awkward, nothing, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns go through all stages; an empty table gives no rows."""
    awkward.unionByName(awkward).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    docs = table(spark, str(tmp_path / "a"), "documents")
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path / "a"))
        assert docs.columns == awkward.columns, name
        docs = docs.persist()
        if name == "near_dedup":  # of the equal texts 1, 2, 2, twice, one row is left
            assert docs.filter("doc_id in (1, 2)").count() == 1
    packed = C.run(spark, str(tmp_path / "a")).collect()
    assert packed and all(r.length <= 2048 for r in packed)
    nothing.write.parquet(str(tmp_path / "e" / "documents.parquet"))
    assert C.run(spark, str(tmp_path / "e")).count() == 0
