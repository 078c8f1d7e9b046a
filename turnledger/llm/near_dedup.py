"""Near-duplicate documents by b-bit MinHash.

One pass gives each document its set of word shingles (as 64-bit hashes), band keys made
of full minima, and a packed signature of the low bits of all minima. Documents with equal
sets are one class from then on. Classes that share a band key are candidates; the bit
counts of their signatures, corrected for chance agreement, estimate the similarity and
drop what is far below the threshold; the rest is confirmed on the full sets.

Large bands are not expanded into all pairs. In each band all members are first compared
with one leader; members that are linked then belong to one component, and only pairs across
components are still open. Bands that hold more than one component leave those pairs to an
exact prefix filter: in any fixed order of shingles, two sets at the threshold share a shingle
among the first n - ceil(threshold * n) + 1 of each. With rare shingles first, variants of one
text that differ too much share none of these, so they never meet. So every candidate pair is
compared, lies inside a component already, or is ruled out exactly, and components come out as
if all had been compared.

Defined results: a document without a word (or with a null text) has an empty set and is
linked with nothing. Rows that share an id each keep their own set, but a link of either
links that id. Rows with a null id have a null component, are linked with nothing and are
kept. Further columns have no effect. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as T
from .common import durable, released, table
from .graph import components

#: 80 bands of 7 minima: a pair at 0.8 shares no band with probability 6.6e-9.
BANDS, ROWS = 80, 7
#: Low bits kept of each minimum.
BITS = 2
#: Counters of the table by which shingles are ordered from rare to common; any order gives the same links.
COUNTERS, COUNTER_CHUNK = 1 << 18, 1 << 12
#: Rows of one shingle that meet as many others in a task.
CELL_ROWS = 500
#: Standard deviations below the threshold at which an estimate rules a pair out.
MARGIN = 6.0


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def shingle_hashes(buf: np.ndarray, off: np.ndarray, k: int):
    """(hashes, document number) of all k-word shingles; a shorter text is one shingle."""
    h, doc = T.words(buf, off, lower=True)
    n = len(off) - 1
    count = T.per_doc(doc, n)
    out = np.zeros(len(h), np.uint64)
    size = len(h) - k + 1
    if size > 0:
        acc = h[:size].copy()
        for j in range(1, k):
            acc = T.mix(acc * np.uint64(0xD6E8FEB86659FD93) + h[j : j + size])
        out[:size] = acc
    keep = np.zeros(len(h), bool)
    first = np.cumsum(count) - count
    within = np.arange(len(h)) - first[doc]
    keep[within <= count[doc] - k] = True
    for d in np.flatnonzero((count > 0) & (count < k)):
        acc = np.uint64(count[d])
        for x in h[first[d] : first[d] + count[d]]:
            acc = T.mix(np.array([acc * np.uint64(0x9FB21C651E98DF25) + x]))[0]
        out[first[d]] = acc
        keep[first[d]] = True
    return out[keep], doc[keep]


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    with np.errstate(over="ignore"):
        h, doc = shingle_hashes(buf, off, k)
    edge = np.r_[0, np.cumsum(T.per_doc(doc, len(off) - 1))]
    return [np.unique(h[a:b]) for a, b in zip(edge[:-1], edge[1:])]


def minima(sets: list[np.ndarray], n_hashes: int) -> np.ndarray:
    """n_hashes minima of each (non-empty) set."""
    a, b = _coefficients(n_hashes)
    out = np.empty((len(sets), n_hashes), np.uint32)
    first = 0
    while first < len(sets):  # so many sets that their values stay in a core's cache
        last, total = first, 0
        while last < len(sets) and (last == first or total + len(sets[last]) <= 48_000):
            total += len(sets[last])
            last += 1
        x = np.concatenate([s >> np.uint64(32) for s in sets[first:last]]).astype(np.uint32)
        starts = np.r_[0, np.cumsum([len(s) for s in sets[first : last - 1]])].astype(np.int64)
        v = np.empty_like(x)
        for i in range(n_hashes):
            np.multiply(x, a[i], out=v)
            np.add(v, b[i], out=v)
            out[first:last, i] = np.minimum.reduceat(v, starts)
        first = last
    return out


def sketches(docs: DataFrame, shingle_words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_key, signature, bands of every row."""

    def sketch(batches):
        for batch in batches:
            for first, last, buf, off in T.slices(batch.column("text")):
                sets = shingle_sets(buf, off, shingle_words)
                some = [i for i, s in enumerate(sets) if len(s)]
                keys, signs, bands_ = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                if some:
                    m = minima([sets[i] for i in some], bands * rows)
                    low = ((m * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint8)
                    bits = np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - BITS :].reshape(len(some), -1)
                    packed = np.packbits(bits, axis=1)
                    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(some), bands)).copy()
                    for j in range(rows):
                        acc = T.mix(acc * np.uint64(0xD6E8FEB86659FD93) + m[:, j::rows].astype(np.uint64))
                    acc = acc.view(np.int64)
                    for n, i in enumerate(some):
                        keys[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                        signs[i] = packed[n].tobytes()
                        bands_[i] = acc[n]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[first:last], pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary()), pa.array(bands_, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "set_key", "signature", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(sketch), "doc_id long, n_shingles long, set_key binary, signature binary, bands array<long>")


def estimate(a: np.ndarray, b: np.ndarray, n_hashes: int) -> np.ndarray:
    """Similarities estimated from the bit counts of packed signatures (rows of bytes), corrected for chance agreement."""
    x = np.unpackbits(a ^ b, axis=1)[:, : n_hashes * BITS].reshape(len(a), n_hashes, BITS)
    same = 1 - x.any(2).mean(1)
    chance = 0.5**BITS
    return (same - chance) / (1 - chance)


def _plausible(pairs: DataFrame, nodes: DataFrame, percent: int, n_hashes: int) -> DataFrame:
    """The pairs whose sizes and signatures don't rule out the threshold."""
    threshold = percent / 100
    chance = 0.5**BITS
    p = threshold + (1 - threshold) * chance
    least = threshold - MARGIN * np.sqrt(p * (1 - p) / n_hashes) / (1 - chance)

    def judge(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
                yield batch.filter(pa.array(estimate(a, b, n_hashes) >= least)).select(["a", "b"])

    def side(c: str) -> DataFrame:
        return nodes.select(F.col("node").alias(c), F.col("signature").alias(f"s{c}"), F.col("n").alias(f"n{c}"))

    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return both.select("a", "b", "sa", "sb").mapInArrow(released(judge), "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """The pairs whose full sets meet the threshold; texts has (node, text)."""

    def compare(batches):
        for batch in batches:
            ok = []
            sides = []
            for c in ("ta", "tb"):
                sets: list[np.ndarray] = []
                for _, _, buf, off in T.slices(batch.column(c)):
                    sets += shingle_sets(buf, off, shingle_words)
                sides.append(sets)
            for x, y in zip(*sides):
                inter = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(100 * inter >= percent * (len(x) + len(y) - inter))
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(released(compare), "a long, b long").distinct()


def _shingle_counts(texts: DataFrame, shingle_words: int) -> np.ndarray:
    """How many sets have a shingle of each counter: a table of fixed size."""

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, _, buf, off in T.slices(batch.column("text")):
                sets = shingle_sets(buf, off, shingle_words)
                total += np.bincount((np.concatenate(sets) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        chunks = total.reshape(-1, COUNTER_CHUNK)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(np.arange(len(chunks), dtype=np.int32)), "n": pa.array(list(chunks), pa.list_(pa.int64()))})

    # Counted per place of the table with partial sums, so no task holds more than the table.
    rows = texts.select("text").mapInArrow(released(count), "chunk int, n array<long>").select("chunk", F.posexplode("n").alias("place", "n")).filter("n > 0")
    total = np.zeros(COUNTERS, np.int64)
    for chunk, place, n in rows.groupBy("chunk", "place").agg(F.sum("n")).toLocalIterator():  # COUNTERS numbers at most
        total[chunk * COUNTER_CHUNK + place] = n
    return total


def _prefix_pairs(open_: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of rows (node, comp) in different components whose prefixes meet and whose sizes fit."""
    texts = durable(texts.join(open_.select("node"), "node", "left_semi"))
    counts = _shingle_counts(texts, shingle_words)

    def prefixes(batches):
        for batch in batches:
            for first, last, buf, off in T.slices(batch.column("text")):
                out, number, sizes = [], [], []
                for s in shingle_sets(buf, off, shingle_words):
                    keep = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                    by = np.lexsort((s, counts[(s % np.uint64(COUNTERS)).astype(np.int64)]))
                    out.append(s[by[:keep]].view(np.int64))
                    number.append(keep)
                    sizes.append(len(s))
                node = batch.column("node")[first:last].take(pa.array(np.repeat(np.arange(last - first), number)))
                place = np.concatenate([np.arange(k) for k in number])
                yield pa.RecordBatch.from_arrays([node, pa.array(np.concatenate(out)), pa.array(place.astype(np.int32)), pa.array(np.repeat(np.array(sizes, np.int64), number))], ["node", "shingle", "place", "n"])

    # n is the size of the text's own set: texts that share an id have each their own.
    rows = texts.mapInArrow(released(prefixes), "node long, shingle long, place int, n long").join(open_.select("node", "comp"), "node")
    rare = rows.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("many")).filter("lo <> hi")
    # A frequent shingle's rows are cut in cells on both sides, and every two cells meet in a task of their own.
    cells = F.ceil(F.col("many") / CELL_ROWS).cast("int")
    rows = durable(rows.join(rare.select("shingle", "many"), "shingle").withColumn("cells", cells).withColumn("cell", F.pmod(F.xxhash64("node", "place"), F.col("cells")).cast("int")).drop("many"))
    every = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))

    def side(c: str, own: str, other: str) -> DataFrame:
        return rows.select("shingle", F.col("cell").alias(own), every.alias(other), *(F.col(x).alias(x + c) for x in ("node", "comp", "n", "place")))

    # Where the first shared shingle stands bounds what two sets can share from there on.
    most = F.least(F.col("na") - F.col("placea"), F.col("nb") - F.col("placeb"))
    fits = (100 + percent) * most >= percent * (F.col("na") + F.col("nb"))
    both = side("a", "x", "y").join(side("b", "y", "x"), ["shingle", "x", "y"])
    meet = both.filter((F.col("nodea") < F.col("nodeb")) & (F.col("compa") != F.col("compb")) & fits)
    return meet.select(F.col("nodea").alias("a"), F.col("nodeb").alias("b")).distinct()


def link_documents(docs: DataFrame, shingle_words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row: components of documents with 100 * intersection >= percent * union."""
    rows_ = durable(sketches(docs, shingle_words, bands, rows))
    usable = rows_.filter("doc_id is not null and set_key is not null")
    classes = durable(usable.groupBy("set_key").agg(F.min("doc_id").alias("node")))
    of = classes.select(F.col("set_key").alias("key_"), "node")
    firsts = usable.join(of, (F.col("set_key") == F.col("key_")) & (F.col("doc_id") == F.col("node")))
    nodes = durable(firsts.select("node", F.col("n_shingles").alias("n"), "signature").dropDuplicates(["node", "signature"]))

    # Leaders come from partial minima, and the join with them may split a band that very many share.
    banded = durable(firsts.select("node", "bands"))
    member = banded.select(F.explode("bands").alias("key"), "node")
    leaders = member.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).filter("leader <> last").select("key", "leader")
    members = durable(member.join(leaders, "key"))
    in_bands = members.select("node").distinct()
    texts = durable(docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(in_bands, "node", "left_semi"))

    def verified(pairs: DataFrame) -> DataFrame:
        likely = durable(_plausible(pairs, nodes, percent, bands * rows))
        return durable(_confirmed(likely, texts, shingle_words, percent))

    # Rows that share an id: its sets are linked through it.
    twice = usable.join(classes, "set_key").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).filter("a <> b").join(nodes.select(F.col("node").alias("a")), "a", "left_semi")
    first = durable(members.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct())
    edges = durable(verified(first).union(twice))

    # Bands that still hold more than one component, beyond the pairs with their leaders.
    label = components(edges)
    labelled = members.select("key", "node").join(label, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")
    open_keys = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).filter("lo <> hi and size > 2").select("key")
    open_ = durable(labelled.join(open_keys, "key", "left_semi").select("node", "comp").distinct())
    rest = durable(_prefix_pairs(open_, texts, shingle_words, percent).join(first, ["a", "b"], "left_anti"))
    more = verified(rest)
    if more.limit(1).count():
        label = components(durable(edges.union(more)))

    of_class = classes.join(label, "node", "left").select("set_key", F.coalesce("label", "node").alias("component"))
    return (
        rows_.select("doc_id", "n_shingles", "set_key")
        .join(of_class, "set_key", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"), shingle_words=2)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest id, of each group of near duplicates (five-word shingles, 0.8).

    Of rows that share a kept id and all their words one stays; rows without an id all stay.
    """
    gone = link_documents(docs).filter("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = durable(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    if not twice.limit(1).count():
        return left
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.sha2(F.trim(F.regexp_replace(low, r"[\x20\x09-\x0D]+", " ")), 256)
    # Rows without a word are linked with nothing, so they stay; apart by their row number among equals.
    order = Window.partitionBy("doc_id", "words_").orderBy(F.xxhash64("text"))
    some = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    again = left.join(twice, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("row"), F.col("doc_id"), F.col("text"), words.alias("words_"), some.alias("some_"))
    first = again.withColumn("nth_", F.row_number().over(order)).filter("nth_ = 1 or not some_").select("row.*")
    return left.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(first)


QUERIES = {"op9_minhash_near_dedup": op9_minhash_near_dedup}

ORACLE_SQL = {
    "op9_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
      ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, x.b FROM reach r JOIN both_ways x ON x.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
""",
}
