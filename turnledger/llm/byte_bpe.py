"""Byte-level BPE encoding and decoding by a sentencepiece model made from a rank file.

A rank file lists byte strings by rank. Every byte string is written in a printable alphabet of
256 characters, one a byte, and becomes a piece of a sentencepiece BPE model whose score is the
negative rank: the library then always merges the pair of the lowest rank, as byte-level BPE
does. The model is serialised directly, with identity normalisation, no prefix and no escaping,
so a piece's number is its rank. Texts are split by the pattern first; each match is encoded by
itself, and a match that is a piece as a whole is that piece. Decoding maps the pieces'
characters back to bytes.

Each distinct run of a text between places where the pattern always splits goes through the
library once for a slice of texts (``tokens.Encoder``); runs are compared byte by byte.

Defined results: a null or empty text has no tokens (and decodes to nothing); a text of any length
is encoded whole, slice by slice; repeated rows and rows that share an id are encoded each by
itself, and a null id is kept. Tables without rows give none. Further columns, whatever their
names, stay out of the result.
"""

from __future__ import annotations

import base64
import functools
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .common import released, table
from .tokens import SLICE, Encoder

_BPE, _NORMAL, _UNKNOWN = 2, 1, 2  # fixed values of sentencepiece's model format


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> list[bytes]:
    """Byte strings by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = {int(rank): base64.b64decode(piece) for piece, rank in pairs}
    if sorted(out) != list(range(len(out))):
        raise ValueError(f"{path}: ranks are not 0 to {len(out) - 1}")
    return [out[i] for i in range(len(out))]


def alphabet() -> list[str]:
    """A printable character for each byte: Latin-1's own where it prints, else one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return [chr(b) if b in prints else chr(0x100 + others.index(b)) for b in range(256)]


def _field(number: int, kind: int) -> bytes:
    return _varint(number << 3 | kind)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _bytes(number: int, value: bytes) -> bytes:
    return _field(number, 2) + _varint(len(value)) + value


def _int(number: int, value: int) -> bytes:
    return _field(number, 0) + _varint(value)


def serialised_model(ranks: list[bytes]) -> bytes:
    """The sentencepiece model (a protocol buffer) of byte strings by rank; an unknown piece comes last."""
    letter = alphabet()

    def piece(text: str, score: float, kind: int) -> bytes:
        return _bytes(1, _bytes(1, text.encode()) + _field(2, 5) + struct.pack("<f", score) + _int(3, kind))

    pieces = [piece("".join(letter[b] for b in p), -float(rank), _NORMAL) for rank, p in enumerate(ranks)]
    pieces.append(piece("<unk>", 0.0, _UNKNOWN))
    none = (1 << 64) - 1  # -1: no such piece
    trainer = _int(3, _BPE) + _int(4, len(pieces)) + _int(40, len(ranks)) + b"".join(_int(n, none) for n in (41, 42, 43))
    normalizer = _bytes(1, b"identity") + _int(3, 0) + _int(4, 0) + _int(5, 0)
    return b"".join(pieces) + _bytes(2, trainer) + _bytes(3, normalizer)


class ByteBPE(Encoder):
    """Encoder of whole texts whose runs are encoded by the sentencepiece model."""

    def __init__(self, path: str, pattern: str | None = None):
        import public_tokenizers
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(ranks))
        self.letters = dict(enumerate(alphabet()))
        self.whole = {p: i for i, p in enumerate(ranks)}
        self.find = regex.compile(pattern or public_tokenizers.PATTERN).findall
        # The places where runs are cut are those of this one pattern.
        self.splits, self.uncut = pattern in (None, public_tokenizers.PATTERN), []
        self.line_feed = self.whole.get(b"\n")
        self.keys, self.bytes = np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        self.at, self.begin = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.size, self.length, self.met, self.ids = (np.zeros(0, np.int32) for _ in range(4))
        # For decoding: all pieces' bytes in a row, read back from the model.
        back = {c: b for b, c in self.letters.items()}
        pieces = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(ranks))]
        self.piece_size = np.array([len(p) for p in pieces], np.int64)
        self.piece_at = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def plain(self, text: str) -> list[int]:
        matches = [m.encode() for m in self.find(text)]
        ids = [self.whole.get(m) for m in matches]
        rest = [i for i, x in enumerate(ids) if x is None]
        if not rest:
            return ids
        encoded = self.model.encode([matches[i].decode("latin-1").translate(self.letters) for i in rest], out_type=int, num_threads=1)
        ids = [[x] for x in ids]
        for i, e in zip(rest, encoded):
            ids[i] = e
        return [x for e in ids for x in e]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes in a row, number of bytes of each id)."""
        size = self.piece_size[ids]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return self.piece_bytes[np.repeat(self.piece_at[ids], size) + step], size


@functools.lru_cache(maxsize=2)
def coder(path: str, pattern: str | None = None) -> ByteBPE:
    """This worker's coder."""
    return ByteBPE(path, pattern)


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary value a row, of counts bytes each."""
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(values))])


def encode_texts(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """id, n_tokens and ids (packed little-endian unsigned 32-bit numbers) of every row's whole text."""
    path = path or default_ranks()
    kind = df.schema[id_column].dataType.simpleString()

    def encode(batches):
        bpe = coder(path, pattern)
        for batch in batches:
            for a, b, buf, off in T.slices(batch.column(1), SLICE):
                ids, counts = bpe.encode(buf, off)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(counts, pa.int64()), _binary(ids.astype("<u4").view(np.uint8), 4 * counts)], ["id", "n_tokens", "ids"])

    some = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return some.mapInArrow(released(encode), f"id {kind}, n_tokens long, ids binary")


def decode_ids(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded (id, n_tokens, ids) with the column decoded: the bytes that the ids stand for."""
    path = path or default_ranks()
    kind = encoded.schema["id"].dataType.simpleString()

    def decode(batches):
        bpe = coder(path)
        for batch in batches:
            packed = batch.column(2).cast(pa.large_binary())
            off = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1]
            first = 0
            while first < len(packed):  # a few MB of ids at once
                last = min(max(int(np.searchsorted(off, off[first] + SLICE, "right")) - 1, first + 1), len(packed))
                ids = np.frombuffer(packed.buffers()[2], "<u4", int(off[last] - off[first]) // 4, int(off[first])) if off[last] > off[first] else np.zeros(0, "<u4")
                text, size = bpe.decode(ids)
                ends = np.r_[0, np.cumsum(size)][(off[first : last + 1] - off[first]) // 4]
                yield pa.RecordBatch.from_arrays([*(c[first:last] for c in batch.columns), _binary(text, np.diff(ends))], ["id", "n_tokens", "ids", "decoded"])
                first = last

    return encoded.mapInArrow(released(decode), f"id {kind}, n_tokens long, ids binary, decoded binary")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and what they decode to."""
    coded = decode_ids(encode_texts(table(spark, sf_dir, "documents")))
    return coded.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op12_byte_bpe": op12_byte_bpe}

#: Merging is not expressible in SQL; tests compare with another library.
ORACLE_SQL: dict[str, str] = {}
