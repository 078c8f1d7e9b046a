"""Prefix trie of conversations by vertical bitmaps.

Conversations are numbered in the order of their ids and dealt to shards of
``2^SHARD_BITS`` neighbours; turns are dealt to slabs of ``SLAB`` positions. A shard and slab holds, for each
(position, turn), the bitset of its conversations that have this turn there. Depth first, a
node's bitset meets the postings of the next position: every intersection that is not empty is a
child, its population count the members, its lowest bit the smallest member, and what has no next
turn is the node's end list. A node's key is a hash chain over its turns, so the nodes of
different shards meet by key, and a slab goes on from the keys that the slab before ends with.

What a subtree holds is summed by doubling: in round k every node adds its sum to the ancestor
2^k above it and learns the one 2^(k+1) above; the number of rounds is the logarithm of the depth,
and only nodes that deep take part. End lists are hashed shard by shard, in order, as a stream.

No task holds more than one shard's conversations of ``SLAB`` turns, however long a
conversation or large a group of copies is: positions are numbered by ranges of the sorted
turns, not by conversation, and copies are bits.

Defined results: turns without a conv_id take no part; a null role or text counts as empty. Turns
of one conversation with equal numbers (or none) go by the hash of role and text, and repeated
rows are turns by themselves. Texts of any length count whole (by SHA-256, of which 128 bits tell
turns apart). A table without conversations gives no rows. Further columns have no effect.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, parts, released, table

#: A shard has 2^SHARD_BITS conversations at most, a slab SLAB positions.
SHARD_BITS, SLAB = 10, 64
#: Bytes of a turn's digest.
DIGEST = 16
_ROOT = bytes(16)


def _packed(a: int, b: int) -> bytes:
    return struct.pack("<qq", a, b)


def _unpacked(key: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", key)


def _below(key: bytes, digest: bytes) -> bytes:
    return hashlib.blake2b(key + digest, digest_size=16).digest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv, turn, digest (hex), size in bytes of each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    df = conversations.filter("conv_id is not null")
    return df.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.substring(whole, 1, 2 * DIGEST).alias("digest"), F.octet_length(text).cast("long").alias("size"))


def in_order(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns with part and at, pieces): at numbers a part's rows, a conversation's rows in a part are a piece.

    pieces has conv, part, first (its first at), before (the conversation's turns in earlier parts) and n (all its turns).
    """
    order = [F.asc("conv"), F.asc_nulls_first("turn"), F.asc("digest")]
    n = parts(turns.sparkSession, 0)
    at = durable(turns.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    at = at.withColumn("part", F.shiftright("at", 33))
    own = Window.partitionBy("conv")
    pieces = at.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return at, pieces.select("conv", "part", "first", before.alias("before"), F.sum("rows").over(own).alias("n"))


def as_they_are(conv: Column) -> tuple[Column, Column]:
    """The rule that leaves every conversation alone: no turns from another one."""
    return conv, F.lit(0).cast("long")


def rebuilt(conversations: DataFrame, rule=as_they_are) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv, num, length; turns: conv, num, length, pos, digest, size).

    rule(conv) names a conversation and a number h of at most 8: the first h turns are taken
    from that one (as far as it has them) and replace the conversation's own first h.
    """
    at, pieces = in_order(turns_of(conversations))
    pieces = durable(pieces)
    base, h = rule(F.col("conv"))
    own = pieces.filter("before = 0").select("conv", "n", base.alias("base"), h.cast("long").alias("h"))
    had = own.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    own = own.join(had, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)).cast("long")))
    own = own.select("conv", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    # Ascending numbers, though not without gaps.
    ranged = own.repartitionByRange(parts(conversations.sparkSession, 0), "conv").sortWithinPartitions("conv")
    own = durable(ranged.withColumn("num", F.monotonically_increasing_id()))
    # Joined by piece, so the turns of a long conversation don't meet in one task.
    placed = at.join(pieces.drop("n").join(own, "conv"), ["conv", "part"]).withColumn("pos", F.col("at") - F.col("first") + F.col("before") + 1)
    kept = placed.filter("pos > h").select("conv", "num", "length", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "size")
    heads = placed.filter("pos <= 8").select(F.col("conv").alias("base"), "pos", "digest", "size")  # 8 rows a conversation at most
    taken = heads.join(own, "base").filter("pos <= h").select("conv", "num", "length", "pos", "digest", "size")
    return own.select("conv", "num", "length"), kept.unionByName(taken)


def slabs(convs: DataFrame, turns: DataFrame, size: int) -> DataFrame:
    """conv, num, length, slab, a and b (key where the slab begins), digests (packed), sizes: so many turns a row at most."""
    slab = F.floor((F.col("pos") - 1) / size)
    rows = turns.groupBy("conv", "num", "length", slab.alias("slab")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "size"))).alias("t"))
    rows = rows.select("conv", "num", "length", "slab", F.unhex(F.array_join("t.digest", "")).alias("digests"), F.col("t.size").alias("sizes"))
    empty = convs.filter("length = 0").select("conv", "num", "length", F.lit(0).cast("long").alias("slab"), F.unhex(F.lit("")).alias("digests"), F.array().cast("array<long>").alias("sizes"))
    rows = durable(rows.unionByName(empty))
    start = rows.filter(F.col("length") <= size).withColumns({"a": F.lit(0).cast("long"), "b": F.lit(0).cast("long")})
    deep = rows.filter(F.col("length") > size).repartition("conv").sortWithinPartitions("conv", "slab")

    def chain(batches):
        """The key before each slab; only the last one is remembered."""
        last, key = None, _ROOT
        for batch in batches:
            a, b = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for i, (conv, digests) in enumerate(zip(batch.column(0).to_pylist(), batch.column(4).to_pylist())):
                if conv != last:
                    last, key = conv, _ROOT
                a[i], b[i] = _unpacked(key)
                for j in range(0, len(digests), DIGEST):
                    key = _below(key, digests[j : j + DIGEST])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a), pa.array(b)], [*batch.schema.names, "a", "b"])

    schema = "conv long, num long, length long, slab long, digests binary, sizes array<long>, a long, b long"
    return start.unionByName(deep.mapInArrow(released(chain), schema))


NODE = "a long, b long, up_a long, up_b long, depth long, n long, conv long, size long, shard long, ends string"


def shard_nodes(group: pa.Table, shard_bits: int, slab_size: int) -> pa.Table:
    """The nodes of one shard and slab."""
    group = group.sort_by("num")
    ids, lengths, starts = group["conv"].to_pylist(), group["length"].to_pylist(), list(zip(group["a"].to_pylist(), group["b"].to_pylist()))
    slab, shard = group["slab"][0].as_py(), group["num"][0].as_py() >> shard_bits
    turns = [[d[i : i + DIGEST] for i in range(0, len(d), DIGEST)] for d in group["digests"].to_pylist()]
    sizes = group["sizes"].to_pylist()
    # The vertical index: bitsets of the conversations by (position, turn), by length, and by the key they start with.
    postings: list[dict[bytes, int]] = [{} for _ in range(slab_size)]
    ended = [0] * (slab_size + 1)
    begun: dict[bytes, int] = {}
    for i, row in enumerate(turns):
        bit = 1 << i
        for at, turn in zip(postings, row):
            at[turn] = at.get(turn, 0) | bit
        if lengths[i] - slab * slab_size <= slab_size:
            ended[lengths[i] - slab * slab_size] |= bit
        start = _packed(*starts[i])
        begun[start] = begun.get(start, 0) | bit
    out: list[list] = [[] for _ in range(10)]
    stack = [(key, None, bits, 0) for key, bits in begun.items()]
    while stack:
        key, up, bits, depth = stack.pop()
        first = (bits & -bits).bit_length() - 1
        end = bits & ended[depth]
        if depth or not slab:  # else the slab before has this node
            names, left = [], end
            while left:
                low = left & -left
                names.append(str(ids[low.bit_length() - 1]))
                left ^= low
            node = (*_unpacked(key), *(_unpacked(up) if up is not None else (None, None)), slab * slab_size + depth, bits.bit_count(), ids[first], sizes[first][depth - 1] if depth else 0, shard, ",".join(names) if names else None)
            for column, value in zip(out, node):
                column.append(value)
        left = bits & ~end if depth < slab_size else 0
        while left:
            turn = turns[(left & -left).bit_length() - 1][depth]
            child = bits & postings[depth][turn]
            left &= ~child
            stack.append((_below(key, turn), key, child, depth + 1))
    names = [c.split()[0] for c in NODE.split(", ")]
    return pa.table({n: pa.array(v, pa.string() if n == "ends" else pa.int64()) for n, v in zip(names, out)})


def end_hashes(nodes: DataFrame) -> DataFrame:
    """a, b, ends_sha256 of the nodes at which conversations end: their ids in order, comma-joined, hashed as a stream."""

    def digest(batches):
        last, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for a, b, ends in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(3).to_pylist()):
                if (a, b) != last:
                    if last is not None:
                        done.append((*last, state.hexdigest()))
                    last, state = (a, b), hashlib.sha256(ends.encode())
                else:
                    state.update(b"," + ends.encode())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done) if done else ([], [], []), (pa.int64(), pa.int64(), pa.string()))], ["a", "b", "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([last[1]]), pa.array([state.hexdigest()])], ["a", "b", "ends_sha256"])

    rows = nodes.filter("ends is not null").select("a", "b", "shard", "ends")
    return rows.repartition("a", "b").sortWithinPartitions("a", "b", "shard").mapInArrow(released(digest), "a long, b long, ends_sha256 string")


def subtree_sums(nodes: DataFrame, values: list[str], deepest: int) -> DataFrame:
    """a, b and the sums of values over all nodes below (the node itself left out), for nodes that have one."""
    # reach: nodes at depth 2^k or more, with the ancestor 2^k above and the sums of all less than 2^k below.
    reach = nodes.filter("depth >= 1").select("a", "b", "up_a", "up_b", "depth", *values)
    given, k = [], 1
    while True:
        added = reach.groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(*(F.sum(v).alias(v) for v in values))
        given.append(added)
        k *= 2
        if deepest < k:
            break
        above = reach.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("up_a").alias("next_a"), F.col("up_b").alias("next_b"))
        sums = added.select("a", "b", *(F.col(v).alias(f"more_{v}") for v in values))
        moved = reach.filter(F.col("depth") >= k).join(above, ["up_a", "up_b"]).join(sums, ["a", "b"], "left")
        reach = durable(moved.select("a", "b", F.col("next_a").alias("up_a"), F.col("next_b").alias("up_b"), "depth", *((F.col(v) + F.coalesce(F.col(f"more_{v}"), F.lit(0))).alias(v) for v in values)))
    all_given = given[0]
    for g in given[1:]:
        all_given = all_given.unionByName(g)
    return all_given.groupBy("a", "b").agg(*(F.sum(v).alias(v) for v in values))


def trie(conversations: DataFrame, rule=as_they_are) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (bytes), ends_sha256."""
    spark = conversations.sparkSession
    shard_bits, slab_size = SHARD_BITS, SLAB
    found = slabs(*rebuilt(conversations, rule), slab_size).withColumn("shard", F.shiftright("num", shard_bits))
    found = durable(found.groupBy("shard", "slab").applyInArrow(lambda group: shard_nodes(group, shard_bits, slab_size), NODE))
    merged = found.groupBy("a", "b").agg(F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"), F.min("depth").alias("depth"), F.sum("n").alias("n"), F.min("conv").alias("conv"), F.max("size").alias("size"))
    merged = durable(merged)
    deepest, least = merged.agg(F.max("depth"), F.min("conv")).first()
    if deepest is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    children = merged.filter("depth >= 1").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("n_children"))
    up = merged.filter("depth >= 1").select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv").alias("parent"))
    # The root is the parent of a node of depth 1: no join for that one.
    parents = merged.filter("depth >= 2").join(up, ["up_a", "up_b"]).select("a", "b", "parent")
    nodes = merged.join(children, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = durable(nodes.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n") - 1) * F.col("size")}))
    below = subtree_sums(nodes, ["leaves", "saved"], deepest).withColumnsRenamed({"leaves": "more_leaves", "saved": "more_saved"})
    nodes = nodes.join(parents, ["a", "b"], "left").join(below, ["a", "b"], "left").join(end_hashes(found), ["a", "b"], "left")
    none = F.lit(0).cast("long")
    return nodes.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.when(F.col("depth") == 1, F.lit(least)).otherwise(F.col("parent")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        "n_children",
        (F.col("leaves") + F.coalesce("more_leaves", none)).alias("n_leaves"),
        (F.col("saved") + F.coalesce("more_saved", none)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def shared_heads(conv: Column) -> tuple[Column, Column]:
    """The query's rule: conversation c begins with the first crc32(c) % 9 turns of c - c % 5."""
    return conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"), shared_heads)


QUERIES = {"op11_prefix_trie": op11_prefix_trie}

ORACLE_SQL = {
    "op11_prefix_trie": """
WITH t AS (
  SELECT conv_id, turn, strlen(coalesce(text, '')) AS size, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] AS digest
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos FROM t),
k AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 AS h
  FROM t GROUP BY conv_id),
r AS (
  SELECT k.conv_id, o.pos, o.digest, o.size FROM k JOIN o ON o.conv_id = k.base AND o.pos <= k.h
  UNION ALL
  SELECT k.conv_id, o.pos - k.h + least(k.h, coalesce(b.n, 0)), o.digest, o.size FROM k JOIN o ON o.conv_id = k.conv_id AND o.pos > k.h LEFT JOIN k AS b ON b.conv_id = k.base),
p AS (SELECT conv_id, list(digest ORDER BY pos) AS ds, list(size ORDER BY pos) AS ss FROM r GROUP BY conv_id),
f AS (SELECT k.conv_id, coalesce(ds, []) AS ds, coalesce(ss, []) AS ss FROM k LEFT JOIN p ON p.conv_id = k.conv_id),
m AS (SELECT conv_id, d, array_to_string(ds[1:d], ',') AS key, len(ds) = d AS ends, CASE WHEN d > 0 THEN ss[d] ELSE 0 END AS size FROM (SELECT *, unnest(range(0, len(ds) + 1)) AS d FROM f)),
n AS (
  SELECT m.d, m.key, min(conv_id) AS conv_id, count(*) AS n, max(size) AS size, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM m GROUP BY m.d, m.key),
u AS (SELECT n.*, array_to_string(ds[1:n.d - 1], ',') AS up, ds FROM n JOIN f ON f.conv_id = n.conv_id),
c AS (SELECT d - 1 AS d, up AS key, count(*) AS n_children FROM u WHERE d > 0 GROUP BY ALL),
v AS (SELECT u.*, coalesce(n_children, 0) AS n_children, (n - 1) * size AS saved FROM u LEFT JOIN c ON c.d = u.d AND c.key = u.key),
s AS (
  SELECT j, array_to_string(ds[1:j], ',') AS key, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM v) GROUP BY ALL)
SELECT v.conv_id, v.d::BIGINT AS depth, up.conv_id AS parent_conv_id, v.n AS n_convs, v.n_children, s.n_leaves, s.saved_tokens, v.ends_sha256
FROM v JOIN s ON s.j = v.d AND s.key = v.key LEFT JOIN n AS up ON v.d > 0 AND up.d = v.d - 1 AND up.key = v.up
""",
}
