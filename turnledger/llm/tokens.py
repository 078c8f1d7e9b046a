"""Whole texts to token ids with the tokenizers library.

A byte-level BPE tokenizer splits a text by a fixed pattern before it merges anything. Some
of these splits can be told from two neighbouring characters: before a blank that stands
alone, around a line feed that stands alone, and between ASCII (or Latin-1) letters, digits
and punctuation other than the apostrophe. Texts are cut there and nowhere else; each
distinct piece goes through the library once, and whole texts are put together from the
pieces' ids. The result is exactly what encoding the whole text gives. Added tokens of the
vocabulary are never cut. Other kinds of tokenizers encode each text whole.

Pieces are told apart by 64-bit hashes; a remembered piece is used only if its bytes agree.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np

from . import text as T

#: Distinct pieces that a worker remembers between slices (about 45 bytes each; a memory bound, not a limit on input).
REMEMBERED = 1_000_000
#: Bytes of text encoded at once: the larger, the fewer pieces are met anew.
SLICE = 1 << 20

# White space outside ASCII, in UTF-8 (fixed values of the Unicode standard).
_WIDE_SPACES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True

_UNKNOWN, _LETTER, _DIGIT, _MARK, _APOSTROPHE = range(5)
_KIND = np.zeros(256, np.int8)
_KIND[33:127] = _MARK
_KIND[np.r_[65:91, 97:123]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[0x27] = _APOSTROPHE


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def kinds(buf: np.ndarray) -> np.ndarray:
    """The kind of each byte's character; Latin-1's letters count, all else outside ASCII is unknown."""
    kind = _KIND[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    letter = lead[(buf[lead + 1] != 0x97) & (buf[lead + 1] != 0xB7)]  # the signs for times and divided
    kind[letter] = kind[letter + 1] = _LETTER
    return kind


def cuts(buf: np.ndarray, off: np.ndarray, whole: bytes, kind: np.ndarray, uncut: list[bytes]) -> np.ndarray:
    """Ascending places where pieces begin, the starts of all non-empty documents among them."""
    n = len(buf)
    # A byte before n that is the last of a white space, and one that is the first of one.
    ends, begins = np.zeros(n + 2, bool), np.zeros(n + 2, bool)
    ends[1:-1] = begins[1:-1] = _ASCII_SPACE[buf]
    for space in _WIDE_SPACES:
        if space[:1] in whole and space[:2] in whole:
            at = whole.find(space)
            while at >= 0:
                begins[1 + at] = ends[at + len(space)] = True
                at = whole.find(space, at + 1)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    alone = ~(ends[:-2] | begins[2:] | edge[:-1] | edge[1:])
    begin = np.zeros(n + 1, bool)
    begin[1:n] = (kind[1:] != kind[:-1]) & (kind[1:] != _UNKNOWN) & (kind[:-1] != _UNKNOWN) & (kind[1:] != _APOSTROPHE) & (kind[:-1] != _APOSTROPHE)
    begin[:-1] |= alone & (buf == 0x20)
    feed = np.flatnonzero(alone & (buf == 0x0A))
    begin[feed] = begin[feed + 1] = True
    for token in uncut:
        at = whole.find(token)
        while at >= 0:
            begin[at + 1 : at + len(token)] = False
            at = whole.find(token, at + 1)
    begin[off] = True
    return np.flatnonzero(begin[:n])


class Encoder:
    #: How many distinct pieces it keeps, if not REMEMBERED.
    remembered: int | None = None

    def __init__(self, path: str, remembered: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.remembered = remembered
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec.get("pre_tokenizer") or {}
        self.splits = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and not spec.get("normalizer")
        self.uncut = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.line_feed = self.tokenizer.token_to_id("Ċ")
        # Remembered pieces: sorted hashes, where each one's bytes and ids are, and how often it was met.
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.begin = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int32)
        self.met = np.zeros(0, np.int32)
        self.bytes = np.zeros(0, np.uint8)
        self.ids = np.zeros(0, np.int32)

    def plain(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _new(self, pieces: list[bytes], join: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, number of ids of each) of pieces; those with join may stand between line feeds."""
        ids, length = [np.zeros(0, np.int32)], np.zeros(len(pieces), np.int32)
        for i in range(0, len(pieces), 5000):
            group, fits = pieces[i : i + 5000], join[i : i + 5000]
            if fits.all() and self.line_feed is not None:
                row = np.array(self.plain(b"\n".join(group).decode("utf-8", "replace")), np.int32)
                feed = np.flatnonzero(row == self.line_feed)
                if len(feed) == len(group) - 1:
                    length[i : i + len(group)] = np.diff(np.r_[-1, feed, len(row)]) - 1
                    ids.append(np.delete(row, feed))
                    continue
            each = [self.plain(p.decode("utf-8", "replace")) for p in group]
            length[i : i + len(group)] = [len(e) for e in each]
            ids.append(np.array([x for e in each for x in e], np.int32))
        return np.concatenate(ids), length

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each) of a slice of texts."""
        n_docs, whole = len(off) - 1, buf.tobytes()
        if not self.splits:
            each = [self.plain(whole[a:b].decode("utf-8", "replace")) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            return np.array([x for e in each for x in e], np.int32), np.array([len(e) for e in each], np.int64)
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(n_docs, np.int64)
        kind = kinds(buf)
        start = cuts(buf, off, whole, kind, self.uncut)
        end = np.r_[start[1:], len(buf)]
        # Each distinct piece of the slice is looked up once.
        keys, first, inverse, times = np.unique(T.span_hash(T.prefix_sums(buf), start, end), return_index=True, return_inverse=True, return_counts=True)
        a, b = start[first], end[first]
        slot = np.full(len(keys), -1, np.int64)
        if len(self.keys):
            near = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = np.flatnonzero((self.keys[near] == keys) & (self.size[near] == b - a))
            size = (b - a)[hit]
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            same = buf[np.repeat(a[hit], size) + step] == self.bytes[np.repeat(self.at[near[hit]], size) + step]
            hit = hit[np.logical_and.reduceat(same, np.cumsum(size) - size)] if len(hit) else hit
            slot[hit] = near[hit]
            self.met[near[hit]] += times[hit].astype(np.int32)
        begin, length = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int32)
        known = slot >= 0
        begin[known], length[known] = self.begin[slot[known]], self.length[slot[known]]
        missing = np.flatnonzero(~known)
        pool = self.ids
        if len(missing):
            # Pieces whose ends are no white space, and that hold no line feed, are encoded many at a time.
            a, b = a[missing], b[missing]
            left = np.where(buf[a] == 0x20, np.minimum(a + 1, b - 1), a)
            feeds = np.r_[0, np.cumsum(buf == 0x0A)]
            join = (kind[left] != _UNKNOWN) & (kind[b - 1] != _UNKNOWN) & (feeds[a] == feeds[b])
            order = np.argsort(~join, kind="stable")
            missing, a, b, join = missing[order], a[order], b[order], join[order]
            many = int(join.sum())
            pieces = [whole[x:y] for x, y in zip(a.tolist(), b.tolist())]
            parts = [self._new(pieces[:many], join[:many]), self._new(pieces[many:], join[many:])]
            ids, sizes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            begin[missing], length[missing] = len(pool) + np.cumsum(sizes) - sizes, sizes
            pool = np.concatenate([pool, ids])
        piece = inverse
        n_ids = length[piece].astype(np.int64)
        step = np.arange(n_ids.sum()) - np.repeat(np.cumsum(n_ids) - n_ids, n_ids)
        out = pool[np.repeat(begin[piece], n_ids) + step]
        doc = np.searchsorted(off, start, "right") - 1
        counts = np.bincount(doc, weights=n_ids, minlength=n_docs).astype(np.int64)
        if len(missing):
            self._remember(keys[missing], pieces, begin[missing], length[missing], times[missing], pool)
        return out, counts

    def _remember(self, keys: np.ndarray, pieces: list[bytes], begin: np.ndarray, length: np.ndarray, times: np.ndarray, pool: np.ndarray) -> None:
        """Adds pieces; beyond the number to be remembered the half that was met most often stays."""
        near = np.searchsorted(self.keys, keys)
        fresh = np.append(self.keys, ~keys[-1:])[near] != keys  # a hash that other bytes have already stays theirs
        size = np.array([len(p) for p in pieces], np.int32)
        at = len(self.bytes) + np.cumsum(size) - size
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(pieces), np.uint8)])
        self.ids = pool
        keys = np.concatenate([self.keys, keys[fresh]])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        new = (at, size, begin, length, times.astype(np.int32))
        self.at, self.size, self.begin, self.length, self.met = (np.concatenate([x, y[fresh]])[order] for x, y in zip((self.at, self.size, self.begin, self.length, self.met), new))
        most = self.remembered or REMEMBERED
        if len(self.keys) > most:
            keep = np.sort(np.argsort(-self.met, kind="stable")[: most // 2])
            self.keys, self.at, self.size, self.begin, self.length, self.met = (x[keep] for x in (self.keys, self.at, self.size, self.begin, self.length, self.met))
            self.bytes, self.at = _packed(self.bytes, self.at, self.size)
            self.ids, self.begin = _packed(self.ids, self.begin, self.length)


def _packed(values: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the spans' values one after the other, where each begins)."""
    to = np.cumsum(size, dtype=np.int64) - size
    step = np.arange(size.sum()) - np.repeat(to, size)
    return values[np.repeat(at, size) + step], to


@functools.lru_cache(maxsize=2)
def encoder(path: str, remembered: int | None = None) -> Encoder:
    """This worker's encoder."""
    return Encoder(path, remembered)
