"""Vectorised helpers for whole texts inside Arrow batches.

Everything here works on one Arrow record batch at a time, in slices of a few MB,
so memory does not depend on the size of a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer document makes a slice of its own.
SLICE_BYTES = 1 << 20
#: Powers are kept for slices up to this size.
_KEPT_POWERS = 1 << 21

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

#: The word separators of the operators' contracts: space and 0x09 to 0x0D.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    # Spark's strings have 32-bit offsets; they are read where they lie.
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    off = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(off, int(off[first]) + size, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, last, buf[off[first] : off[last]], off[first : last + 1].astype(np.int64) - off[first]
        first = last


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept up to the size of a slice."""
    had = _powers.get(base)
    if had is not None and len(had) >= n:
        return had[:n]
    size = n if n > _KEPT_POWERS + 1 else 1 << (n - 1).bit_length() if n > 1 else 1
    out = np.empty(size, np.uint64)
    out[0] = 1
    m = 1
    while m < size:
        k = min(m, size - m)
        out[m : m + k] = out[:k] * np.uint64(pow(base, m, 1 << 64))
        m += k
    if n <= _KEPT_POWERS + 1:
        _powers[base] = out
    return out[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (in place where it can)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Sums from which span_hash() takes the hash of any span."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(_INVERSE, len(buf)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, the same wherever a span stands."""
    return mix((sums[end] - sums[start]) * powers(_BASE, len(sums))[start])


def rolling_hash(sums: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-byte windows."""
    n = len(sums) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((sums[k:] - sums[:-k]) * powers(_BASE, len(sums))[:n])


def spans(separator: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the runs without separator; no run crosses documents."""
    n = len(separator)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~separator
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edge = off[1:-1]
    at = edge[edge < n]
    begins[at] |= inside[1:-1][at]
    at = edge[edge > 0] - 1
    ends[at] |= inside[1:-1][at]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def words(buf: np.ndarray, off: np.ndarray, lower: bool = False):
    """(hash, document number) of each word ``[^\\x20\\x09-\\x0D]+``, in order."""
    start, end, doc = spans(SEPARATOR[buf], off)
    return span_hash(prefix_sums(LOWER[buf] if lower else buf), start, end), doc


def per_doc(counts_of: np.ndarray, n_docs: int) -> np.ndarray:
    """How many items each document has."""
    return np.bincount(counts_of, minlength=n_docs).astype(np.int64)


def sum_by_doc(values: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Sums of the rows of values (n or n x m) by document; doc ascends."""
    shape = (n_docs, *values.shape[1:])
    out = np.zeros(shape, np.float64)
    if len(values):
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        out[doc[first]] = np.add.reduceat(values, first, axis=0, dtype=np.float64)
    return out
