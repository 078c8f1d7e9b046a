"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is cut into blocks: a document's block is a hash of its id and text, so the blocks
of a source are a random permutation of its documents. Targets share out the words of the whole
table by weight; no target exceeds a fixed multiple of its source, and what is over goes to
the others. A source gives whole passes over its blocks and then a last, partial pass:
the first blocks, up to its target, and from the block at the cut the documents that fill
the rest best.

What is dealt to the output shards are the blocks really taken, once for each pass that takes
them, numbered in each source by a random permutation that has nothing to do with the cut. A
binary tree over the shards decides where they go. At each node the blocks there (a count for
each source) are split exactly between the two halves by a multivariate-hypergeometric draw,
seeded by the node, so every shard works out its own path from the root: how many blocks of
each source it gets, and from which number on. The shards' blocks are disjoint and together are
all that is taken, so shards are of even size and each holds the sources by their targets. Rows
are shuffled inside a shard only.

Copies are made before the exchange by shard, as they go to different shards; all that is taken
has about as many words as the table, so that much is exchanged. Tables with a row per source or
block are broadcast while they have at most 2^18 rows, else joined as any other.

Defined results: a null or empty text has 0 words and is never needed; the null source is
a source of its own, last in order. Rows that share an id are separate rows in the same
block. Without any word nothing is taken. Further columns are kept by ``mix`` and have no
effect. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, released, small, table

WEIGHTS = (1.0, 2.0, 3.0)
MOST_PASSES = 3
SEED = 17
#: Words of a block; more, so that there are at most MOST_BLOCKS and one for each source.
BLOCK_WORDS, MOST_BLOCKS = 20_000, 1 << 16
SHARD_BLOCKS = 64


def word_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of the text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: pd.DataFrame, weights=WEIGHTS, most: float = MOST_PASSES) -> pd.DataFrame:
    """Adds target to rows (source, size), one per source: shares of the total by weight, none above most * size."""
    known = sizes[sizes["source"].notna()]
    # Python compares strings by code point.
    order = [*sorted(known.index, key=lambda i: known.loc[i, "source"]), *sizes.index[sizes["source"].isna()]]
    out = sizes.loc[order].reset_index(drop=True)
    w = np.array([weights[i % len(weights)] for i in range(len(out))], float)
    size = out["size"].to_numpy(float)
    target, free, rest = np.zeros(len(out)), np.ones(len(out), bool), size.sum()
    while free.any():
        share = np.where(free, rest * w / w[free].sum(), 0)
        over = free & (share > most * size)
        if not over.any():
            target[free] = share[free]
            break
        target[over] = most * size[over]
        rest -= target[over].sum()
        free &= ~over
    out["target"] = target
    return out


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def sized(docs: DataFrame) -> DataFrame:
    """docs with _size, the words of a row, and _h, a hash of its text."""
    return docs.withColumns({"_size": word_count(F.col("text")), "_h": F.xxhash64("text")})


@dataclass
class Decisions:
    """What is taken of each source: small tables, and the blocks taken as (source, copy, block)."""

    seed: int
    per_source: DataFrame
    cuts: DataFrame
    whole: DataFrame
    filled: DataFrame
    units: list[tuple[str | None, int, int]]


def _in_blocks(df: DataFrame, per_source: DataFrame, seed: int) -> DataFrame:
    mixed = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_h")
    return df.join(per_source, _same("source", "_s")).drop("_s").withColumn("_block", F.pmod(mixed, F.col("_blocks")))


def _with_cuts(df: DataFrame, per_source: DataFrame, cuts: DataFrame, whole: DataFrame, seed: int) -> DataFrame:
    df = _in_blocks(df, per_source, seed).join(cuts, _same("source", "_s"), "left").drop("_s")
    df = df.join(whole, _same("source", "_w"), "left").drop("_w")
    return df.withColumn("_extra", (F.col("_block") <= F.coalesce("_last", F.lit(-1))).cast("int"))


def decide(narrow: DataFrame, weights=WEIGHTS, most: int = MOST_PASSES, seed: int = SEED) -> Decisions:
    """Decides from (doc_id, source, _size, _h) of all rows."""
    by_source = narrow.groupBy(F.col("source").alias("_s")).agg(F.sum("_size").alias("size")).toPandas()  # one row per source
    plan = targets(by_source.rename(columns={"_s": "source"}), weights, most)
    total = float(plan["size"].sum())
    block_words = max(BLOCK_WORDS, total / MOST_BLOCKS)
    plan["blocks"] = np.maximum(1, np.ceil(plan["size"] / block_words)).astype(np.int64)
    positive = plan["size"] > 0
    passes = np.where(positive, np.minimum(plan["target"] // plan["size"].where(positive, 1), most), 0)
    plan["passes"] = passes.astype(np.int64)
    plan["rest"] = np.where(positive & (passes < most), plan["target"] - passes * plan["size"], 0.0)
    spark = narrow.sparkSession
    listed = [(None if pd.isna(s) else s, int(z), float(t), int(b), int(p), float(r)) for s, z, t, b, p, r in plan[["source", "size", "target", "blocks", "passes", "rest"]].itertuples(index=False)]
    per_source = small(spark.createDataFrame(listed, "_s string, _source_size long, _target double, _blocks long, _passes long, _rest double"), len(listed))

    # At most MOST_BLOCKS rows and one per source: words before each block in its source.
    totals = _in_blocks(narrow, per_source, seed).groupBy(F.col("source").alias("_s"), F.col("_block").alias("_b")).agg(F.sum("_size").alias("words"), F.max("_rest").alias("rest")).toPandas()
    totals["key"] = totals["_s"].map(lambda s: (s is None or s != s, "" if s is None or s != s else s))
    totals = totals.sort_values(["key", "_b"])
    end = totals.groupby("key", sort=False)["words"].cumsum()
    totals["before"], totals["end"] = end - totals["words"], end
    cut = totals[(totals["before"] < totals["rest"]) & (totals["end"] > totals["rest"])]
    cuts = spark.createDataFrame([(None if k[0] else k[1], int(b), float(r - w)) for k, b, r, w in cut[["key", "_b", "rest", "before"]].itertuples(index=False)], "_s string, _cut long, _room double")
    cuts = small(cuts, len(cut))
    # Sources whose last pass ends exactly between two blocks, or that have none.
    ends = totals[totals["end"] <= totals["rest"]].groupby("key", sort=False)["_b"].max()
    whole = spark.createDataFrame([(None if k[0] else k[1], int(b)) for k, b in ends.items()], "_w string, _last long")
    whole = small(whole, len(ends))

    # A block is taken once in each whole pass, and once more before or at the cut.
    passes_of = {k: p for (k, *_), p in zip(listed, plan["passes"])}
    cut_of, end_of = dict(zip(cut["key"], cut["_b"])), ends.to_dict()
    units = []
    for k, b in totals[["key", "_b"]].itertuples(index=False):
        source = None if k[0] else k[1]
        extra = b <= end_of.get(k, -1) or b == cut_of.get(k, -1)
        units += [(source, copy, int(b)) for copy in range(1, int(passes_of[source]) + int(extra) + 1)]

    # In the one block at the cut: the documents that fill the rest best, larger ones first; equal rows as one with a count.
    at_cut = _with_cuts(narrow, per_source, cuts, whole, seed).filter("_block = _cut")
    at_cut = at_cut.groupBy("source", "doc_id", F.col("_h").alias("h")).agg(F.max("_size").alias("words"), F.max("_room").alias("room"), F.count("*").alias("n"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["words", "doc_id", "h"], ascending=[False, True, True], kind="stable")
        room, take = float(pdf["room"].iloc[0]), []
        for words, n in zip(pdf["words"], pdf["n"]):
            take.append(min(int(n), int(room // words)) if words else 0)
            room -= words * take[-1]
        pdf["take"] = np.array(take, "int64")
        return pdf[["source", "doc_id", "h", "take"]]

    kind = dict(narrow.dtypes)["doc_id"]
    # Arrow keeps a null id apart only as a nullable integer; as text it is safe.
    filled = at_cut.withColumn("doc_id", F.col("doc_id").cast("string")).groupBy("source").applyInPandas(fill, "source string, doc_id string, h long, take long")
    filled = filled.select(F.col("source").alias("_fs"), F.col("doc_id").cast(kind).alias("_fd"), F.col("h").alias("_fh"), F.col("take").alias("_take"))
    return Decisions(seed, per_source, cuts, whole, filled, units)


def draw(rows: DataFrame, narrow: DataFrame, weights=WEIGHTS, most: int = MOST_PASSES, seed: int = SEED) -> DataFrame:
    """Adds _source_size, _target, _block, _blocks and _copies (how often a row is taken) to rows.

    narrow has (doc_id, source, _size, _h) of all rows; what the decisions need of the whole
    table is taken from it. rows has these columns too, and any others.
    """
    return _drawn(rows, decide(narrow, weights, most, seed))


def _drawn(rows: DataFrame, d: Decisions) -> DataFrame:
    columns = rows.columns
    # One row for each distinct document at the cuts; of equal rows the first _take ones count.
    all_ = _with_cuts(rows, d.per_source, d.cuts, d.whole, d.seed)
    nth = F.row_number().over(Window.partitionBy("source", "_block", "doc_id", "_h").orderBy(F.lit(1)))
    inside = all_.filter("_block = _cut").withColumn("_nth", nth)
    inside = inside.join(d.filled, _same("source", "_fs") & _same("doc_id", "_fd") & _same("_h", "_fh"), "left")
    inside = inside.withColumn("_extra", (F.col("_nth") <= F.coalesce("_take", F.lit(0))).cast("int"))
    names = [*columns, "_source_size", "_target", "_block", "_blocks", "_passes", "_extra"]
    outside = all_.filter("_cut is null or _block <> _cut").select(*names)
    return outside.unionByName(inside.select(*names)).withColumn("_copies", F.col("_passes") + F.col("_extra")).drop("_passes", "_extra")


def shard_quotas(spark: SparkSession, blocks: list[tuple[str | None, int]], shards: int, seed: int = SEED) -> DataFrame:
    """(shard, source, first, n): of each source the shard's blocks are numbers first to first + n - 1."""
    names = [s for s, _ in blocks]
    counts = np.array([n for _, n in blocks], np.int64)

    def quota(batches):
        for pdf in batches:
            rows = []
            for shard in pdf["id"]:
                have, first, lo, hi = counts.copy(), np.zeros_like(counts), 0, shards
                while hi - lo > 1 and have.sum():
                    mid = (lo + hi) // 2
                    rng = np.random.default_rng([seed, lo, hi])
                    # The left half takes its share of all blocks, drawn without replacement.
                    left = rng.multivariate_hypergeometric(have, int(round(have.sum() * (mid - lo) / (hi - lo))), method="marginals")
                    if shard < mid:
                        have, hi = left, mid
                    else:
                        have, first, lo = have - left, first + left, mid
                rows += [(int(shard), names[i], int(first[i]), int(have[i])) for i in np.flatnonzero(have)]
            yield pd.DataFrame(rows, columns=["shard", "source", "first", "n"]).astype({"shard": "int64", "first": "int64", "n": "int64"})

    return spark.range(shards).mapInPandas(released(quota), "shard long, source string, first long, n long")


def dealt(spark: SparkSession, d: Decisions) -> DataFrame:
    """(shard, _s, _c, _b): the shard of each block taken, by source and copy; at most about MOST_BLOCKS rows and a few per source."""
    of_source: dict[str | None, list[tuple[int, int]]] = {}
    for source, copy, block in d.units:
        of_source.setdefault(source, []).append((copy, block))
    numbered = []
    for i, (source, taken) in enumerate(of_source.items()):
        order = np.random.default_rng([d.seed, i]).permutation(len(taken)).tolist()
        numbered += [(source, number, *unit) for number, unit in zip(order, taken)]
    blocks = [(source, len(taken)) for source, taken in of_source.items()]
    quotas = shard_quotas(spark, blocks, shard_count(d), d.seed)
    quotas = quotas.select("shard", F.col("source").alias("_q"), F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("_at"))
    units = spark.createDataFrame(numbered, "_s string, _number long, _c int, _b long")
    return quotas.join(small(units, len(numbered)), _same("_q", "_s") & (F.col("_at") == F.col("_number"))).select("shard", "_s", "_c", "_b")


def shard_count(d: Decisions) -> int:
    return max(1, -(-len(d.units) // SHARD_BLOCKS))


def _mixed(docs: DataFrame, d: Decisions) -> DataFrame:
    columns = docs.columns
    copies = _drawn(sized(docs), d).filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    unit = _same("source", "_s") & (F.col("_copy") == F.col("_c")) & (F.col("_block") == F.col("_b"))
    placed = copies.join(small(dealt(docs.sparkSession, d), len(d.units)), unit)
    return placed.repartition(shard_count(d), "shard").sortWithinPartitions("shard", F.xxhash64(F.lit(d.seed), "doc_id", "_copy")).select(*columns, "shard")


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_PASSES, seed: int = SEED) -> DataFrame:
    """The mix: every row as often as it is taken, with its output shard, shuffled inside the shard."""
    return _mixed(docs, decide(durable(sized(docs).select("doc_id", "source", "_size", "_h")), weights, most, seed))


def taken(docs: DataFrame, weights=WEIGHTS, most: int = MOST_PASSES, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken (words in the mix) of every row, counted in the mix as it was written."""
    narrow = durable(sized(docs).select("doc_id", "source", "_size", "_h"))
    d = decide(narrow, weights, most, seed)
    written = durable(_mixed(docs.select("doc_id", "source", "text"), d))
    key = ["doc_id", "source", "_h"]
    found = written.select("doc_id", "source", F.xxhash64("text").alias("_h")).groupBy(*(F.col(c).alias(f"m{c}") for c in key)).agg(F.count("*").alias("_found"))
    rows = narrow.groupBy(*key).agg(F.count("*").alias("_rows"), F.max("_size").alias("size"))
    same = _same("doc_id", "mdoc_id") & _same("source", "msource") & _same("_h", "m_h")
    rows = rows.join(found, same, "left").join(d.per_source, _same("source", "_s"))
    # Equal rows share what was found of them as draw() deals it: alike, the first ones once more.
    rows = rows.withColumn("_found", F.coalesce("_found", F.lit(0))).withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
    copies = F.floor(F.col("_found") / F.col("_rows")) + (F.col("_nth") <= F.col("_found") % F.col("_rows")).cast("long")
    return rows.select("doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("size") * copies).alias("taken"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all rows: a row is there as often as it was taken."""
    return mix(docs).drop("shard")


QUERIES = {"op5_mixing": op5_mixing}
ORACLE_SQL: dict[str, str] = {}
