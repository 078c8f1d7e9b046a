from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions

from turnledger.llm import packing as P
from turnledger.llm import text as T
from turnledger.llm import token_files as F
from turnledger.llm.common import shared_dir
from turnledger.llm.tokens import Encoder, default_tokenizer


@pytest.fixture(scope="module")
def enc():
    return Encoder(default_tokenizer())


def ids_of(enc, texts):
    out = []
    for _, _, buf, off in T.slices(pa.array(texts, pa.string())):
        ids, counts = enc.encode(buf, off)
        out += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    return out


def test_equal_to_encoding_whole_texts(enc):
    rng = random.Random(1)
    texts = ["", " ", "  ", "a  b", " a", "a ", "a\n b", "x <|endoftext|> y", "don't 's", "a.b,c 12ab,é.x ×y÷ ü! it's5 '\n's\nx.\n\ny\t.", "\n<|endoftext|>\n,<|endoftext|>.a", "é à 中 文字", "a  b c", "x  y", None]
    alphabet = ["a", "é", " ", "  ", "\n", "'s", "1", "!", " ", "中", "Ġ", "\x1c", "<|endoftext|>", "<|end", "word", ",", "é.", "×", "\n\n", "\t", "?!", "🙂", "ß2", "\u00ad"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(1500)]
    assert ids_of(enc, texts) == [enc.plain(t or "") for t in texts]
    assert ids_of(enc, texts) == [enc.plain(t or "") for t in texts]  # once more, from memory


def test_forgetting_changes_nothing(enc, monkeypatch):
    from turnledger.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 10)
    small = Encoder(default_tokenizer())
    texts = [" ".join(f"w{i * j}" for i in range(30)) for j in range(20)]
    for _ in range(3):
        assert ids_of(small, texts) == [enc.plain(t) for t in texts]
    assert len(small.keys) <= 10


def test_files_round_trip(spark, awkward, nothing, enc):
    path = shared_dir(spark)
    F.write_token_files(awkward, path)
    read = F.read_token_files(spark, path)
    rows = sorted(F.token_offsets(read).collect(), key=lambda r: r.start)
    hashed = awkward.select("doc_id", "text", functions.xxhash64("text").alias("h")).collect()
    want = sorted((r.doc_id is not None, r.doc_id or 0, r.h, r.text or "") for r in hashed)
    start = 0
    for r, (known, i, _, text) in zip(rows, want, strict=True):
        ids = np.array(enc.plain(text) + [2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i if known else None, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    some = F.read_token_files(spark, path, [3, 9]).collect()
    assert sorted(r.doc_id for r in some) == [3, 9, 9]
    empty = shared_dir(spark)
    F.write_token_files(nothing, empty)
    assert F.token_offsets(F.read_token_files(spark, empty)).count() == 0


def test_local_search_empties_bins():
    lengths = np.array([6, 6, 4, 4, 5, 5, 3, 3, 2, 2])
    bins = [[0, 8], [1, 9], [2, 4], [3, 5], [6, 7]]  # each below 10
    better = P.improve([list(b) for b in bins], lengths, 10)
    assert sorted(i for b in better for i in b) == list(range(10))
    assert max(sum(lengths[i] for i in b) for b in better) <= 10 and len(better) <= len(bins)
    roomy = P.improve([list(b) for b in bins], lengths, 12)  # with places to spare, a bin empties
    assert sorted(i for b in roomy for i in b) == list(range(10)) and len(roomy) == 4


def test_packing_is_near_the_bound():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 2049, 2000)
    bin_of, offset = P.pack_lengths(lengths)
    used = np.bincount(bin_of, weights=lengths)
    assert used.max() <= 2048 and len(used) <= 1.01 * np.ceil(lengths.sum() / 2048)
    assert len({(b, o) for b, o in zip(bin_of, offset)}) == len(lengths)


def test_packed_rows(spark, awkward, nothing, enc):
    rows = P.pack_documents(awkward).collect()
    got = sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = []
    for d in awkward.collect():
        ids = np.array(enc.plain(d.text or "") + [0], "<u4")
        cut = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        want += [(d.doc_id or -1, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:]))]
    assert got == sorted(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert P.pack_documents(nothing).count() == 0


def test_memory_of_a_worker_is_bounded():
    import tracemalloc

    enc = P.encoder(default_tokenizer(), P.REMEMBERED)
    words = (f"w{i:x}" for i in range(1_000_000))
    texts = pa.array([" ".join(next(words) for _ in range(250)) for _ in range(4000)])
    tracemalloc.start()
    for _, _, buf, off in T.slices(texts, P.SLICE):
        enc.encode(buf, off)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6, peak
