"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts earlier in the table
(smaller doc_id, or the same document and an earlier start). Only suffixes that can matter
are sorted:

1. Every string of ``length`` bytes has one anchor, the place in it whose ``GRAM``-byte gram
   has the least hash, so equal strings have equal anchors. Grams are exchanged by hash; an
   anchor whose gram occurs once in the table ends here.
2. For the others, the suffix from the anchor on (with the bytes before it that its strings
   may reach) enters a sorted run, each run front-coded: an entry holds the length of the
   prefix it shares with the one before, and the rest. Runs are exchanged by ranges of the
   gram's hash, which spreads them evenly; the order of suffixes is that of (hash, bytes).
3. A loser tree merges the runs of a range. It keeps, for every entry, how much it shares with
   the last output, so no byte that is known to be equal is compared again. What neighbours in
   the merged order share says which strings are equal from the anchor on, and the same
   lengths over the sorted bytes before the anchors say it for the other side; strings whose
   both sides agree are equal, byte for byte, and all but the first occurrence are removed.

Hashes only bring equal strings together; that they are equal is always told from their bytes.
Suffixes that repeat within one slice of documents are reduced to one before any exchange, so
a string that a third of all documents hold arrives once per slice. A long document is worked
on in blocks that overlap by one string.

Defined results: a null text is empty. A null doc_id comes before all others; rows without an
id, or that share one, are in the order of a hash of their texts; of fully equal rows one is
first. Only doc_id and text are read, so further columns have no effect. An empty table gives
no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as D

from . import text as T
from .common import parts, released, table, text_bytes

LENGTH = 100
GRAM = 32
#: Bytes of text whose anchors make one range of hashes, on average; a range is merged at once.
RANGE_BYTES = 4 << 20
#: Bytes of text whose ranges make one partition.
PART_BYTES = 64 << 20
#: Bytes of one document that are worked on at once.
BLOCK_BYTES = 8 << 20
#: Bytes of text whose anchors are found, or whose suffixes are sorted, at once (a run).
RUN_BYTES = 1 << 20

_NO_ID = -(1 << 30)  # added to sub where there is no id
_PLACE_BITS = 27  # a block is shorter than 2^27 bytes
_U64 = np.uint64


def anchors(buf: np.ndarray, off: np.ndarray, length: int):
    """place of each anchor, and of the first and last string (of `length` bytes) that it is the anchor of."""
    n, width = len(buf), length - GRAM + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 3
    g = T.rolling_hash(T.prefix_sums(buf), GRAM)
    m = (g >> _U64(_PLACE_BITS) << _U64(_PLACE_BITS)) | np.arange(len(g), dtype=np.uint64)
    reach = 1
    while reach * 2 <= width:
        m = np.minimum(m[:-reach], m[reach:])
        reach *= 2
    if reach < width:
        m = np.minimum(m[: len(m) - (width - reach)], m[width - reach :])
    # Strings that end in their own document.
    start = np.arange(len(m))
    doc = np.searchsorted(off, start, "right") - 1
    ok = start + length <= off[1:][doc]
    start, doc, at = start[ok], doc[ok], (m[ok] & _U64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    new = np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])] if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(at)] - 1 if len(first) else first
    return at[first], start[first], start[last]


def blocked_anchors(buf: np.ndarray, off: np.ndarray, length: int, block: int):
    """What anchors() gives, and the anchors' gram keys, block by block: strings that start in one block after the other."""
    for x in range(0, max(1, len(buf)), block):
        y = min(len(buf), x + block + length - 1)
        edge = np.clip(off, x, y) - x
        at, lo, hi = anchors(buf[x:y], np.unique(np.r_[0, edge, y - x]), length)
        if len(at):
            yield at + x, lo + x, hi + x, gram_keys(T.prefix_sums(buf[x:y]), at)


def gram_keys(sums: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The grams' hashes mixed once more: anchors have small hashes, ranges need even ones."""
    return T.mix(T.span_hash(sums, at, at + GRAM) + _U64(0x9E3779B97F4A7C15))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> _U64(32)) * _U64(buckets)) >> _U64(32)).astype(np.int32)


_GRAMS = "bucket int, kind int, k binary, sub binary, code binary, h binary"


def _emit(schema: list[str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "kind": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(name, pa.binary())) for name, c in zip(schema, zip(*rows))], schema)


def _exchange_grams(base: DataFrame, length: int, buckets: int, n_bytes: int) -> DataFrame:
    """(k, sub, code) of the anchors whose gram occurs elsewhere too; code holds place and reach."""
    names = ["bucket", "kind", "k", "sub", "code", "h"]

    def find(batches):
        for batch in batches:
            ks, subs = batch.column("k").to_numpy(), batch.column("sub").to_numpy()
            for first, last, buf, off in T.slices(batch.column("text"), RUN_BYTES):
                found = list(blocked_anchors(buf, off, length, BLOCK_BYTES))
                if not found:
                    continue
                at, lo, hi, h = (np.concatenate(c) for c in zip(*found))
                doc = np.searchsorted(off, at, "right") - 1
                code = ((at - off[doc]) << 16) | ((at - hi) << 8) | (at - lo)
                k, sub = ks[first:last][doc], subs[first:last][doc].astype(np.int32)
                order = np.argsort(h, kind="stable")
                hs = h[order]
                new = np.r_[True, hs[1:] != hs[:-1]]
                many = np.diff(np.r_[np.flatnonzero(new), len(hs)])
                local = np.repeat(many > 1, many)
                rows = []
                # Repeated in this slice: certain already; they travel to any range, and one hash tells the others.
                sure = order[local]
                if len(sure):
                    rows.append((int(h[sure[0]] % _U64(buckets)), 1, k[sure].tobytes(), sub[sure].tobytes(), code[sure].tobytes(), b""))
                    told = hs[new][many > 1]
                    b = _bucket(told, buckets)
                    for x, y in _runs(b):
                        rows.append((int(b[x]), 2, b"", b"", b"", told[x:y].tobytes()))
                single = order[~local]
                b = _bucket(h[single], buckets)
                for x, y in _runs(b):
                    i = single[x:y]
                    rows.append((int(b[x]), 0, k[i].tobytes(), sub[i].tobytes(), code[i].tobytes(), h[i].tobytes()))
                yield _emit(names, rows)

    def repeated(group: list[dict]):
        k, sub, code = [], [], []
        for r in group:
            if r["kind"] == 1:
                k.append(np.frombuffer(r["k"], np.int64))
                sub.append(np.frombuffer(r["sub"], np.int32))
                code.append(np.frombuffer(r["code"], np.int64))
        rest = [r for r in group if r["kind"] == 0]
        if rest:
            h = np.concatenate([np.frombuffer(r["h"], np.uint64) for r in rest])
            told = [np.frombuffer(r["h"], np.uint64) for r in group if r["kind"] == 2]
            values, inverse, times = np.unique(np.concatenate([h, *told]), return_inverse=True, return_counts=True)
            keep = (times > 1)[inverse[: len(h)]]
            k.append(np.concatenate([np.frombuffer(r["k"], np.int64) for r in rest])[keep])
            sub.append(np.concatenate([np.frombuffer(r["sub"], np.int32) for r in rest])[keep])
            code.append(np.concatenate([np.frombuffer(r["code"], np.int64) for r in rest])[keep])
        if k:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (k, sub, code)], ["k", "sub", "code"])

    grams = _dealt(base.mapInArrow(released(find), _GRAMS), buckets, n_bytes)
    return grams.mapInArrow(released(_by_bucket(repeated)), "k long, sub int, code long")


def _runs(b: np.ndarray):
    """(first, end) of the runs of equal values."""
    edge = np.r_[0, np.flatnonzero(b[1:] != b[:-1]) + 1, len(b)] if len(b) else [0]
    return zip(edge[:-1], edge[1:])


def _by_bucket(work):
    """A mapInArrow function that gives the rows of one range after the other to work."""

    def run(batches):
        bucket, group = None, []
        for batch in batches:
            buckets = batch.column("bucket").to_numpy()
            for x, y in _runs(buckets):
                if x == y:
                    continue
                if buckets[x] != bucket and group:
                    yield from work(group)
                    group = []
                bucket = buckets[x]
                group += batch.slice(x, y - x).to_pylist()  # one row for each slice of documents
        if group:
            yield from work(group)

    return run


def _dealt(runs: DataFrame, buckets: int, n_bytes: int) -> DataFrame:
    """The ranges' rows together and in the order of ranges; a partition holds many ranges."""
    return runs.repartition(min(buckets, parts(runs.sparkSession, n_bytes, PART_BYTES)), "bucket").sortWithinPartitions("bucket")


def shared_prefixes(keys: list[bytes]) -> np.ndarray:
    """How many bytes each key shares with the one before it (the first: 0)."""
    n = np.array([len(x) for x in keys])
    out = np.zeros(len(keys), np.int64)
    if len(keys) > 1:
        wide = max(1, int(n.max()))
        m = np.frombuffer(b"".join(x.ljust(wide, b"\0") for x in keys), np.uint8).reshape(len(keys), wide)
        differ = m[1:] != m[:-1]
        out[1:] = np.minimum(np.where(differ.any(1), differ.argmax(1), wide), np.minimum(n[1:], n[:-1]))
    return out


def _compare(a: bytes, b: bytes, known: int) -> tuple[bool, int]:
    """(a comes first or they are equal, shared bytes), given that the first `known` bytes are equal."""
    if a == b:
        return True, len(a)
    n = min(len(a), len(b))
    while known + 16 <= n and a[known : known + 16] == b[known : known + 16]:
        known += 16
    while known < n and a[known] == b[known]:
        known += 1
    return (a[known] < b[known]) if known < n else len(a) < len(b), known


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merges sorted runs (keys, bytes shared with the key before) with a loser tree.

    Gives (run, place) in order, and how much each output shares with the one before. A
    contender with a longer prefix in common with the last output is the smaller one; bytes
    are compared only where these lengths tie, and only behind them.
    """
    n = 1
    while n < len(runs):
        n *= 2
    keys = [r[0] for r in runs] + [[] for _ in range(n - len(runs))]
    shared = [r[1] for r in runs] + [[] for _ in range(n - len(runs))]
    size = [len(k) for k in keys]
    place = [0] * n
    loser, loser_shared = [0] * n, [0] * n

    def play(a: int, sa: int, b: int, sb: int) -> tuple[int, int, int, int]:
        """(winner, shared, loser, shared)."""
        if place[a] >= size[a]:
            return b, sb, a, sa
        if place[b] >= size[b] or sa > sb:
            return a, sa, b, sb
        if sb > sa:
            return b, sb, a, sa
        first, common = _compare(keys[a][place[a]], keys[b][place[b]], sa)
        return (a, sa, b, common) if first else (b, sb, a, common)

    winners = [(i, 0) for i in range(n)]
    node = n // 2
    while node >= 1:  # the tree's levels from the leaves up
        above = []
        for i in range(0, len(winners), 2):
            w, sw, lo, sl = play(*winners[i], *winners[i + 1])
            loser[node + i // 2], loser_shared[node + i // 2] = lo, sl
            above.append((w, sw))
        winners, node = above, node // 2
    current, common = winners[0]
    order, lcp = [], []
    for _ in range(sum(size)):
        order.append((current, place[current]))
        lcp.append(common)
        place[current] += 1
        common = shared[current][place[current]] if place[current] < size[current] else 0
        node = (current + n) // 2
        while node >= 1:
            other = loser[node]
            if place[current] >= size[current] or (place[other] < size[other] and loser_shared[node] >= common):
                current, common, loser[node], loser_shared[node] = play(current, common, other, loser_shared[node])
            node //= 2
    return order, lcp


_RUNS = "bucket int, kind int, k binary, sub binary, code binary, shared binary, sizes binary, tails binary, lefts binary"


def _exchange_suffixes(base: DataFrame, candidates: DataFrame, length: int, buckets: int, n_bytes: int) -> DataFrame:
    """(k, sub, first, last): byte ranges that occur earlier in the table."""
    names = ["bucket", "kind", "k", "sub", "code", "shared", "sizes", "tails", "lefts"]

    def sort(batches):
        for batch in batches:
            ks, subs = batch.column("k").to_numpy(), batch.column("sub").to_numpy()
            lists = batch.column("found").fill_null([])
            edge = lists.offsets.to_numpy()
            flat = lists.values
            own, codes = flat.field("sub").to_numpy(), flat.field("code").to_numpy()
            for first, last, buf, off in T.slices(batch.column("text"), RUN_BYTES):
                inner = np.arange(edge[first], edge[last])
                doc = np.searchsorted(edge[first : last + 1], inner, "right") - 1
                mine = own[inner] == subs[first:last][doc]  # rows that share an id get each other's candidates
                inner, doc = inner[mine], doc[mine]
                code = codes[inner]
                pos, jlo, jhi = code >> 16, (code >> 8) & 255, code & 255
                at = off[doc] + pos
                a, b = at - jhi, at + length - jlo
                h, whole = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
                for x in range(0, max(1, len(buf)), BLOCK_BYTES):
                    here = np.flatnonzero((at >= x) & (at < x + BLOCK_BYTES))
                    if len(here):
                        low = max(0, x - length)
                        sums = T.prefix_sums(buf[low : x + BLOCK_BYTES + length])
                        h[here] = gram_keys(sums, at[here] - low)
                        whole[here] = T.span_hash(sums, a[here] - low, b[here] - low)
                k, sub = ks[first:last][doc], subs[first:last][doc].astype(np.int32)
                # Equal surroundings in this slice: all but the first occurrence go at once.
                order = np.lexsort((pos, sub, k, sub >= 0, jhi, whole, h))
                same = np.zeros(len(order), bool)
                if len(order):
                    p, q = order[1:], order[:-1]
                    alike = np.flatnonzero((h[p] == h[q]) & (whole[p] == whole[q]) & (jhi[p] == jhi[q]) & (b[p] - a[p] == b[q] - a[q]))
                    same[1 + alike[_equal_bytes(buf, a[p[alike]], a[q[alike]], (b - a)[p[alike]])]] = True
                rows = []
                gone = order[same]
                if len(gone):
                    rows.append((int(h[gone[0]] % _U64(buckets)), 1, k[gone].tobytes(), sub[gone].tobytes(), code[gone].tobytes(), b"", b"", b"", b""))
                stay = order[~same]
                text = buf.tobytes()
                keys = [x.to_bytes(8, "big") + text[i:j] for x, i, j in zip(h[stay].tolist(), at[stay].tolist(), b[stay].tolist())]
                by = sorted(range(len(keys)), key=keys.__getitem__)
                stay, keys = stay[by], [keys[i] for i in by]
                bucket = _bucket(h[stay], buckets)
                for x, y in _runs(bucket):
                    i, run = stay[x:y], keys[x:y]
                    shared = shared_prefixes(run)
                    sizes = np.array([len(r) for r in run], np.uint8)
                    rows.append(
                        (
                            int(bucket[x]),
                            0,
                            k[i].tobytes(),
                            sub[i].tobytes(),
                            code[i].tobytes(),
                            shared.astype(np.uint8).tobytes(),
                            sizes.tobytes(),
                            b"".join(r[s:] for r, s in zip(run, shared.tolist())),
                            b"".join(text[s:e] for s, e in zip(a[i].tolist(), at[i].tolist())),
                        )
                    )
                if rows:
                    yield _emit(names, rows)

    def merge(group: list[dict]):
        ks, subs, firsts, lasts = [], [], [], []

        def remove(k, sub, first, last):
            ks.append(k)
            subs.append(sub)
            firsts.append(first)
            lasts.append(last)

        runs, entries = [], []
        for r in group:
            k, sub, code = np.frombuffer(r["k"], np.int64), np.frombuffer(r["sub"], np.int32), np.frombuffer(r["code"], np.int64)
            if r["kind"] == 1:
                remove(k, sub, (code >> 16) - (code & 255), (code >> 16) - ((code >> 8) & 255) + length)
                continue
            shared, sizes = np.frombuffer(r["shared"], np.uint8).tolist(), np.frombuffer(r["sizes"], np.uint8).tolist()
            keys, key, at = [], b"", 0
            for s, n in zip(shared, sizes):
                key = key[:s] + r["tails"][at : at + n - s]
                at += n - s
                keys.append(key)
            edge = np.r_[0, np.cumsum(code & 255)].tolist()
            lefts = [r["lefts"][i:j] for i, j in zip(edge[:-1], edge[1:])]
            runs.append((keys, shared))
            entries.append((k, sub, code, keys, lefts))
        if runs:
            order, lcp = merge_runs(runs)
            _resolve(order, lcp, entries, length, remove)
        if ks:
            out = [np.concatenate(x) for x in (ks, subs, firsts, lasts)]
            yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1].astype(np.int32)), pa.array(out[2].astype(np.int64)), pa.array(out[3].astype(np.int64))], ["k", "sub", "first", "last"])

    runs = base.join(_by_row(candidates, "found", "code"), "k").withColumn("found", _of_row("found")).mapInArrow(released(sort), _RUNS)
    return _dealt(runs, buckets, n_bytes).mapInArrow(released(_by_bucket(merge)), "k long, sub int, first long, last long")


def _by_row(entries: DataFrame, name: str, *fields: str) -> DataFrame:
    """k and a map name of the entries by sub. One exchange serves both groupings, and the join by k."""
    own = entries.repartition("k").groupBy("k", "sub").agg(F.collect_list(F.struct("sub", *fields)).alias("own"))
    return own.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("sub", "own"))).alias(name))


def _of_row(name: str) -> Column:
    """The entries of the row's own text: rows that share an id are joined by the id alone, so that one exchange of the texts serves all passes."""
    return F.try_element_at(name, F.col("sub"))


def _equal_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the (non-empty) spans of buf that begin at a and at b are equal."""
    if not len(a):
        return np.zeros(0, bool)
    first = np.cumsum(size) - size
    step = np.arange(size.sum()) - np.repeat(first, size)
    return np.logical_and.reduceat(buf[np.repeat(a, size) + step] == buf[np.repeat(b, size) + step], first)


def shared_before(lefts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(order of the strings when read from their ends, how many bytes each then shares with the one before)."""
    wide = max(1, max(map(len, lefts)))
    n = np.array([len(x) for x in lefts])
    # Bytes are raised by one, so that what fills up short strings differs from all of them.
    m = np.zeros((len(lefts), wide), ">u2")
    flat = np.frombuffer(b"".join(lefts), np.uint8).astype(np.uint16) + 1
    row = np.repeat(np.arange(len(n)), n)
    m[row, np.repeat(np.cumsum(n), n) - 1 - np.arange(len(flat))] = flat
    order = np.argsort(m.view(f"S{2 * wide}").ravel(), kind="stable")
    out = np.zeros(len(n), np.int64)
    differ = m[order[1:]] != m[order[:-1]]
    alike = np.where(differ.any(1), differ.argmax(1), wide)
    out[1:] = np.minimum(alike, np.minimum(n[order[1:]], n[order[:-1]]))
    return order, out


#: Suffixes in merged order that are resolved at once, or one gram's if they are more.
_CHUNK = 50_000


def _resolve(order, lcp, entries, length: int, remove) -> None:
    """Removes, among suffixes in merged order, all but the first occurrence of each string.

    The string that starts j bytes before an anchor is equal to another one if the suffixes
    share length - j bytes, which their neighbours' shared lengths tell, and the bytes before
    share j, told in the same way in the order of the reversed bytes before.
    """
    base = np.r_[0, np.cumsum([len(e[0]) for e in entries])]
    at = np.array([base[r] + p for r, p in order], np.int64)
    lcp = np.array(lcp, np.int64)
    # Suffixes that share no gram with a neighbour are done with.
    near = lcp >= 8 + GRAM
    keep = near | np.r_[near[1:], False]
    at, lcp = at[keep], lcp[keep]
    k, sub, code = (np.concatenate([e[i] for e in entries])[at] for i in (0, 1, 2))
    lefts = [x for e in entries for x in e[4]]
    # Whole groups of one gram at a time.
    edge = np.r_[np.flatnonzero(lcp < 8 + GRAM), len(at)]
    start = 0
    while start < len(edge) - 1:
        stop = max(start + 1, int(np.searchsorted(edge, edge[start] + _CHUNK, "right")) - 1)
        x = slice(edge[start], edge[stop])
        _resolve_groups(lcp[x], k[x], sub[x], code[x], [lefts[i] for i in at[x]], length, remove)
        start = stop


def _resolve_groups(lcp, k, sub, code, lefts: list[bytes], length: int, remove) -> None:
    n = len(lcp)
    pos, jlo, jhi = code >> 16, (code >> 8) & 255, code & 255
    by_left, left = shared_before(lefts)
    # The order of occurrences as a number.
    rank = np.empty(n, np.int64)
    rank[np.lexsort((pos, sub, k, sub >= 0))] = np.arange(n)
    gone, place = [], []
    for j in range(int(jlo.min()), int(jhi.max()) + 1):
        mine = np.flatnonzero((jlo <= j) & (j <= jhi))
        if len(mine) < 2:
            continue
        after = np.cumsum(lcp < 8 + length - j)
        before = np.empty(n, np.int64)
        before[by_left] = np.cumsum(left < j)
        pair = after[mine] * (n + 1) + before[mine]
        o = np.lexsort((rank[mine], pair))
        seen = np.r_[False, pair[o[1:]] == pair[o[:-1]]]
        gone.append(mine[o[seen]])
        place.append(np.full(int(seen.sum()), j))
    if not gone:
        return
    e, j = np.concatenate(gone), np.concatenate(place)
    if not len(e):
        return
    # Runs of neighbouring strings of one anchor go as one range.
    o = np.lexsort((-j, e))
    e, j = e[o], j[o]
    new = np.r_[True, (e[1:] != e[:-1]) | (j[1:] != j[:-1] - 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(e)] - 1
    remove(k[e[first]], sub[e[first]], pos[e[first]] - j[first], pos[e[first]] - j[last] + length)


def repeated_ranges(docs: DataFrame, length: int = LENGTH, carry: bool = False) -> DataFrame:
    """k, sub, text and the list of (sub, first, last) ranges of every row, for dedup and strip.

    With carry also row, the row's columns but the text, and missing, whether the text is null.
    """
    spark = docs.sparkSession
    n_bytes = text_bytes(docs)
    buckets = parts(spark, n_bytes, RANGE_BYTES)
    own = [F.struct(*(docs[c] for c in docs.columns if c != "text")).alias("row"), F.col("text").isNull().alias("missing")] if carry else []
    h, known = F.xxhash64("text"), F.col("doc_id").isNotNull()
    # Rows without an id are spread by their texts' hash.
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), h).alias("k"), known.alias("known"), h.alias("h"), F.coalesce("text", F.lit("")).alias("text"), *own)
    nth = F.row_number().over(Window.partitionBy("k").orderBy("known", "h"))
    base = base.withColumn("sub", F.when(F.col("known"), nth).otherwise(nth + _NO_ID)).drop("h")
    # Rows with the same id and text may be numbered the other way round each time; their ranges fit either.
    # All three passes over the texts read the same columns, so that one exchange of the texts serves them all.
    removed = _exchange_suffixes(base, _exchange_grams(base, length, buckets, n_bytes), length, buckets, n_bytes)
    return base.join(_by_row(removed, "ranges", "first", "last"), "k", "left").withColumn("ranges", _of_row("ranges"))


def _kept(batch: pa.RecordBatch):
    """(bytes of the text, bytes left, spans removed) of each row."""
    subs = batch.column("sub").to_numpy()
    lists = batch.column("ranges").fill_null([])
    edge = lists.offsets.to_numpy()
    own, first, last = (lists.values.field(c).to_numpy() for c in ("sub", "first", "last"))
    for i, text in enumerate(batch.column("text")):
        data = text.as_buffer().to_pybytes()
        a, b = edge[i], edge[i + 1]
        mine = own[a:b] == subs[i]
        x, y = first[a:b][mine], last[a:b][mine]
        if not len(x):
            yield data, data, 0
            continue
        order = np.argsort(x, kind="stable")
        x, y = x[order], np.maximum.accumulate(y[order])
        new = np.r_[True, x[1:] > y[:-1]]
        starts, ends = x[new], y[np.r_[np.flatnonzero(new)[1:], len(x)] - 1]
        keep, at = [], 0
        for s, e in zip(starts.tolist(), ends.tolist()):
            keep.append(data[at:s])
            at = e
        yield data, b"".join([*keep, data[at:]]), len(starts)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text of every row.

    kept_text is what is left as text; where a removed range cuts a character, its other bytes are left out.
    """

    def finish(batches):
        for batch in batches:
            found = list(_kept(batch))
            for i in range(0, len(found), 2000):
                part = found[i : i + 2000]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("k")[i : i + len(part)],
                        batch.column("known")[i : i + len(part)],
                        pa.array([len(d) for d, _, _ in part], pa.int64()),
                        pa.array([len(d) - len(x) for d, x, _ in part], pa.int64()),
                        pa.array([s for _, _, s in part], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for _, x, _ in part]),
                        pa.array([x.decode("utf-8", "ignore") for _, x, _ in part]),
                    ],
                    ["k", "known", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"],
                )

    done = repeated_ranges(docs, length).mapInArrow(released(finish), "k long, known boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    return done.select(F.when(F.col("known"), F.col("k")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def cut_rows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """row (the columns but the text), text (what is left of the row's own one) and n_removed of every row."""
    found = repeated_ranges(docs, length, carry=True)

    def finish(batches):
        for batch in batches:
            row, missing = batch.column("row"), batch.column("missing").to_pylist()
            kept = [(x.decode("utf-8", "ignore") if len(x) < len(d) else d.decode("utf-8", "replace"), len(d) - len(x)) for d, x, _ in _kept(batch)]
            for i in range(0, len(kept), 2000):
                part = kept[i : i + 2000]
                texts = pa.array([None if m else t for (t, _), m in zip(part, missing[i : i + 2000])], pa.string())
                yield pa.RecordBatch.from_arrays([row[i : i + len(part)], texts, pa.array([n for _, n in part], pa.int64())], ["row", "text", "n_removed"])

    schema = D.StructType([D.StructField("row", found.schema["row"].dataType), D.StructField("text", D.StringType()), D.StructField("n_removed", D.LongType())])
    return found.mapInArrow(released(finish), schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated strings out of each row's own text; n_chars follows, and a row whose cut left no word goes."""
    cut = cut_rows(docs).filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    kinds = dict(docs.dtypes)
    own = {c: F.col("row")[c] for c in docs.columns if c != "text"} | {"text": F.col("text")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(own["n_chars"]).cast(kinds["n_chars"])
    return cut.select(*(own[c].alias(c) for c in docs.columns))


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
