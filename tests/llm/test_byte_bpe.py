"""The sentencepiece model against tiktoken with the same ranks and pattern."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from turnledger.llm import byte_bpe as B
from turnledger.llm import text as T


@pytest.fixture(scope="module")
def truth():
    ranks = {p: i for i, p in enumerate(B.read_ranks(B.default_ranks()))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(texts):
    out = []
    for _, _, buf, off in T.slices(pa.array(texts, pa.string())):
        ids, counts = B.coder(B.default_ranks()).encode(buf, off)
        out += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    return out


def test_every_piece_is_itself(truth):
    bpe, ranks = B.coder(B.default_ranks()), B.read_ranks(B.default_ranks())
    mapped = [p.decode("latin-1").translate(bpe.letters) for p in ranks]
    assert bpe.model.encode(mapped, out_type=int) == [[i] for i in range(len(ranks))]
    text, size = bpe.decode(np.arange(len(ranks)))
    assert text.tobytes() == b"".join(ranks) and size.tolist() == [len(p) for p in ranks]


def test_texts(truth):
    rng = random.Random(12)
    texts = ["", " ", "   ", "a  b", "\x00\x00a", "don't we'll 'S", "<unk> ▁x <|endoftext|>", "x" * 3000, "äöü" * 500, " \n\n\t x y\u0085z\x1c\x1dq", "🙂👩‍👩‍👧 ok", "１２３ ²³ Ⅷ", None]
    alphabet = ["a", "é", " ", "  ", "\n", "'s", "'", "1", "!", " ", "中", "Ġ", "▁", "\x1c", "\x85", "<unk>", "word", ",", "é.", "×", "\n\n", "\t", "?!", "🙂", "ß2", "­", "́", "\x00", "re", "ll"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(3000)]
    want = [truth.encode_ordinary(t or "") for t in texts]
    assert ids_of(texts) == want
    assert ids_of(texts) == want  # once more, from memory
    bpe = B.coder(B.default_ranks())
    for t, ids in zip(texts, want):
        assert bpe.plain(t or "") == ids
        assert bpe.decode(np.array(ids, np.int64))[0].tobytes() == (t or "").encode()


def test_rows(spark, awkward, nothing, truth):
    coded = B.decode_ids(B.encode_texts(awkward))
    got = sorted((-1 if r.id is None else r.id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in coded.collect())
    want = []
    for r in awkward.collect():
        ids = np.array(truth.encode_ordinary(r.text or ""), "<u4")
        want.append((-1 if r.doc_id is None else r.doc_id, len(ids), ids.tobytes(), (r.text or "").encode()))
    assert got == sorted(want)
    assert B.decode_ids(B.encode_texts(nothing)).count() == 0


def test_query(spark, truth):
    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in B.op12_byte_bpe(spark, sf).collect())
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = np.array(truth.encode_ordinary(r.text or ""), "<u4")
        want.append((r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want)
