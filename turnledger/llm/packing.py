"""Best-fit packing of documents into sequences, improved by swap-based local search.

Documents are tokenised and, only if longer than a sequence, cut. Pieces are dealt into
groups of a bounded size. In a group, best fit by falling length gives a first packing;
then a local search empties the least full bins: it moves a piece into another underfull
bin, or exchanges one piece for one or two for one, whenever the fuller bin gets fuller
(the sum of squared fills rises, so the search ends). Pieces of bins that are still
underfull are then dealt into groups again, together with those of all other groups, and
packed once more.

Defined results: a null text is empty, so its document is the end id alone. Rows that
share an id are packed separately. Only doc_id and text are read, so further columns have
no effect. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .common import durable, parts, released, table
from .tokens import default_tokenizer, encoder

CAPACITY = 2048
END_ID = 0
#: Pieces of a group on average; each group is packed by one task.
GROUP_ROWS = 3000
#: Pieces that a task packs, group after group.
TASK_ROWS = 300_000

#: Bytes of text encoded at once, and distinct pieces that a worker remembers. Smaller than elsewhere, for in the
#: pipeline executors still hold what the stages before left in them (bounds on memory, not on input).
SLICE = 1 << 19
REMEMBERED = 300_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece, with the ids' crc32 and a number for dealing the rows into groups."""

    def cut(batches):
        enc = encoder(tokenizer or default_tokenizer(), REMEMBERED)
        here, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, last, buf, off in T.slices(batch.column("text"), SLICE):
                ids, counts = enc.encode(buf, off)
                edge = np.r_[0, np.cumsum(counts + 1)]
                out = np.full(edge[-1], end_id, "<u4")
                inner = np.ones(edge[-1], bool)
                inner[edge[1:] - 1] = False
                out[inner] = ids
                n = counts + 1
                many = -(-n // capacity)
                doc = np.repeat(np.arange(last - first), many)
                piece = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                head = (n - 1) % capacity + 1  # the first piece takes what is over
                start = np.where(piece > 0, head[doc] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, head[doc])
                begin = edge[:-1][doc] + start
                crc = [zlib.crc32(out[a : a + m]) for a, m in zip(begin, length)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[first:last].take(pa.array(doc)),
                        pa.array(piece.astype(np.int32)),
                        pa.array(start.astype(np.int64)),
                        pa.array(length.astype(np.int64)),
                        pa.array(crc, pa.int64()),
                        pa.array((here << 40) + row + np.arange(len(doc))),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "deal"],
                )
                row += len(doc)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(released(cut), f"{_PIECES}, deal long")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins (lists of item numbers) by best fit over falling lengths."""
    bins: list[list[int]] = []
    room_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin with r places is open
    for item in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[item])
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            at = room_bins[room].pop()
            if not room_bins[room]:
                rooms &= ~(1 << room)
            bins[at].append(item)
        else:
            room, at = capacity, len(bins)
            bins.append([item])
        left = room - n
        if left:
            room_bins[left].append(at)
            rooms |= 1 << left
    return bins


def improve(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Empties bins by moves and exchanges between underfull ones; every step raises the sum of squared fills."""
    size = lengths.tolist()
    fill = {k: sum(size[i] for i in b) for k, b in enumerate(bins)}
    open_ = sorted((k for k in fill if fill[k] < capacity), key=lambda k: fill[k])
    stuck: set[int] = set()
    while sum(capacity - fill[k] for k in open_ if bins[k]) >= capacity:
        live = [k for k in open_ if bins[k] and fill[k] < capacity]
        source = next((k for k in live if k not in stuck), None)
        if source is None:
            break
        others = [k for k in live if k != source and fill[k] >= fill[source]]
        if not _step(source, others, bins, size, fill, capacity):
            stuck.add(source)
        elif bins[source]:
            stuck.discard(source)
    return [b for b in bins if b]


def _step(source: int, others: list[int], bins, size, fill, capacity: int) -> bool:
    """One improving move or exchange out of the source bin; False if there is none."""
    mine = sorted(bins[source], key=lambda i: -size[i])
    best = None  # (gain, target, pieces out of source, pieces out of target)
    for target in others:
        room = capacity - fill[target]
        for x in mine:
            if size[x] <= room and (best is None or size[x] > best[0]):
                best = (size[x], target, (x,), ())
            for y in bins[target]:
                gain = size[x] - size[y]
                if 0 < gain <= room and (best is None or gain > best[0]):
                    best = (gain, target, (x,), (y,))
        if best and best[1] == target and best[0] == room:
            break  # the target is full now: no exchange with it is better
        for n, x in enumerate(mine):
            for z in mine[n + 1 :]:
                for y in bins[target]:
                    gain = size[x] + size[z] - size[y]
                    if 0 < gain <= room and (best is None or gain > best[0]):
                        best = (gain, target, (x, z), (y,))
        if best and best[1] == target and best[0] == room:
            break
    if best is None:
        return False
    gain, target, out, back = best
    bins[source] = [i for i in bins[source] if i not in out] + list(back)
    bins[target] = [i for i in bins[target] if i not in back] + list(out)
    fill[source] -= gain
    fill[target] += gain
    return True


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each item."""
    bins = improve(best_fit(lengths, capacity), lengths, capacity)
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, items in enumerate(bins):
        at = np.cumsum([0, *(int(lengths[i]) for i in items)])
        bin_of[items], offset[items] = k, at[:-1]
    return bin_of, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds sequence_id and offset to rows with the columns length and deal (a number of its own for each row)."""

    def grouped(df: DataFrame) -> DataFrame:
        rows = df.count()
        groups = max(1, -(-rows // group_rows))
        # Set by hand, for merging these small partitions would pack all groups in one task.
        tasks = min(groups, parts(df.sparkSession, rows, TASK_ROWS))
        return df.withColumn("grp", F.pmod(F.xxhash64("deal"), F.lit(groups))).repartition(tasks, "grp")

    def packer(turn: int):
        def one_group(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["length", "deal"]).reset_index(drop=True)
            bin_of, offset = pack_lengths(pdf["length"].to_numpy(), capacity)
            full = np.bincount(bin_of, weights=pdf["length"]) >= capacity
            pdf["sequence_id"] = pdf["grp"] * (1 << 24) + bin_of * 2 + turn
            pdf["offset"] = offset
            pdf["underfull"] = ~full[bin_of]
            return pdf.drop(columns="grp")

        return one_group

    schema = ", ".join(f"{c} {t}" for c, t in pieces.dtypes) + ", sequence_id long, offset long, underfull boolean"
    once = durable(grouped(pieces).groupBy("grp").applyInPandas(packer(0), schema))
    again = grouped(once.filter("underfull").drop("sequence_id", "offset", "underfull")).groupBy("grp").applyInPandas(packer(1), schema)
    return once.filter("not underfull").unionByName(again).drop("underfull")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(durable(token_pieces(docs, tokenizer, capacity, end_id)), capacity).drop("deal")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents left by the stages before; repeats are packed as documents of their own."""
    return pack_documents(docs)


QUERIES = {"op10_best_fit_packing": op10_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
