"""Exact top-k by inner product with a pivot-distance index.

Vectors are parted into bands by length. In a band inner products become distances: a vector
v gets one more coordinate, sqrt(M - |v|^2) with M the band's largest squared length, and a
query is stretched to that length and gets 0 there, so a higher score is a smaller distance. Every vector is keyed by the
nearest pivot of its band and its distance from it; a pivot's vectors lie in annuli, cut at
quantiles of that distance. By the triangle inequality no vector of an annulus [low, high] is
nearer to a query at distance d from the pivot than max(d - high, low - d), which gives the
highest score that may be found there; the product of the two lengths is another such bound.
A query first searches the few pivots that score highest themselves, and then all annuli of
others whose bound reaches its k-th best score so far; the rest are ruled out, so the result is exact.

A pivot's vectors are stored as blocks of a bounded number of rows, and queries are sent to
pivots in groups of a bounded number, each once with a bit for every annulus it asks for; so a
common vector or a crowded annulus is spread over tasks. Bands, pivots and bounds of annuli (at
most ``MAX_PIVOTS * RINGS`` rows) go to all tasks. Bands and pivots are fitted on a bounded
sample; the bands' largest lengths and the annuli are those of all rows.

Defined results: vectors that are null, hold null or non-finite components, or have a null id
take no part. Shorter vectors, empty ones too, count as if zeros followed. Ties go to the
smaller id; rows that share an id are separate queries and separate candidates, and only a
query's own row is left out of its result. Fewer candidates than k give fewer rows. Further
columns have no effect. An empty table gives no rows. Scores are exact while squared lengths
stay below 2^63.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, released, table

SCALE = 256
PIVOT_SAMPLE = 4096
MAX_PIVOTS = 256
#: Bands by length, and the least ratio of the squared lengths at which two of them begin.
MAX_BANDS, BAND_RATIO = 16, 1.5
#: Annuli of a pivot; each is a bit of a number.
RINGS = 16
BLOCK_ROWS = 512
#: Pivots whose rows a query is compared with before its final round.
FIRST_PIVOTS = 2
#: Stands for the score of a row that a query isn't compared with.
NONE = np.iinfo(np.int64).min


def quantized(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """id, v: floor(256 * x) of every component as packed 32-bit numbers' doubles."""
    x = F.transform(vector_column, lambda c: c.cast("double"))
    df = vectors.select(F.col(id_column).cast("long").alias("id"), x.alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    df = df.filter(F.col("id").isNotNull() & F.col("x").isNotNull() & finite)
    return df.select("id", F.transform("x", lambda c: F.floor(c * SCALE).cast("double")).alias("v"))


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """n centres of the sample by a few rounds of k-means from a fixed start."""
    rng = np.random.default_rng(3)
    centres = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)]
    for _ in range(6):
        near = _distances(sample, centres).argmin(1)
        for k in range(len(centres)):
            if (near == k).any():
                centres[k] = sample[near == k].mean(0)
    return centres


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(d, 0))


def _lift(m: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the coordinate that makes all of them equally long."""
    return np.c_[m, np.sqrt(np.maximum(top - (m * m).sum(1), 0))]


def band_starts(squares: np.ndarray) -> list[float]:
    """Squared lengths at which the bands after the first begin: quantiles of the sample's, where they differ enough."""
    starts, last = [], max(float(squares.min()), 1.0)
    for edge in np.quantile(squares, np.arange(1, MAX_BANDS) / MAX_BANDS, method="higher"):
        if edge >= last * BAND_RATIO:
            starts.append(float(edge))
            last = float(edge)
    return starts


def top_k(vectors: DataFrame, k: int, is_query, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score; is_query is a function of the id column."""
    return search(vectors, k, is_query, id_column, vector_column)[0]


def search(vectors: DataFrame, k: int, is_query, id_column: str = "vec_id", vector_column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """top_k()'s rows, and (query_id, scored): the number of rows that each query was compared with."""
    spark = vectors.sparkSession
    base = quantized(vectors, id_column, vector_column)
    # A number for each row, fixed by writing it.
    base = durable(base.withColumn("row", F.monotonically_increasing_id()))
    rows, dim = base.agg(F.count("*"), F.max(F.size("v"))).first()
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long"), spark.createDataFrame([], "query_id long, scored long")
    dim = max(dim, 1)
    base = base.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("v"))))
    sample = np.array([r[0] for r in base.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("v").collect()])  # bounded
    starts = band_starts((sample * sample).sum(1))
    base = base.withColumn("square", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    base = base.withColumn("band", sum((F.when(F.col("square") >= s, 1).otherwise(0) for s in starts), F.lit(0)))
    # One row a band.
    tops = {r[0]: r[1] for r in base.groupBy("band").agg(F.max("square")).collect()}
    exact_doubles = max(tops.values()) < 2**53

    centres, pivot_band = [], []
    in_band = np.array([bisect_right(starts, x) for x in (sample * sample).sum(1)])
    most = int(np.clip(np.sqrt(rows) / 2, 1, MAX_PIVOTS - len(tops)))
    for b in sorted(tops):
        mine = sample[in_band == b] if (in_band == b).any() else np.zeros((1, dim))
        found = _pivots(_lift(mine, tops[b]), max(1, most * len(mine) // len(sample)))
        centres.append(found)
        pivot_band += [b] * len(found)
    pivots, pivot_band = np.concatenate(centres), np.array(pivot_band)
    pivot_top = np.array([tops[b] for b in pivot_band])

    def key(batches):
        for pdf in batches:
            if len(pdf):
                m = np.stack(pdf["v"])
                bands = pdf["band"].to_numpy()
                near, dist = np.zeros(len(m), np.int32), np.zeros(len(m))
                for b in np.unique(bands):
                    own, of = np.flatnonzero(bands == b), np.flatnonzero(pivot_band == b)
                    d = _distances(_lift(m[own], tops[b]), pivots[of])
                    near[own], dist[own] = of[d.argmin(1)], d.min(1)
                yield pd.DataFrame({"id": pdf["id"], "row": pdf["row"], "pivot": near, "dist": dist, "len": np.sqrt(pdf["square"]), "v": [r.tobytes() for r in m]})

    keyed = durable(base.mapInPandas(released(key), "id long, row long, pivot int, dist double, len double, v binary"))
    # One row a pivot.
    cuts = keyed.groupBy("pivot").agg(F.percentile_approx("dist", [i / RINGS for i in range(1, RINGS)], 1000).alias("cuts"), F.count("*").alias("n")).collect()
    cuts = F.broadcast(spark.createDataFrame(cuts, "pivot int, cuts array<double>, n long"))
    placed = keyed.join(cuts, "pivot").withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("dist"))).cast("int")).drop("cuts")
    # One row an annulus: at most MAX_PIVOTS * RINGS.
    rings = placed.groupBy("pivot", "ring").agg(F.min("dist").alias("low"), F.max("dist").alias("high"), F.max("len").alias("longest"), F.count("*").alias("n")).orderBy("pivot", "ring").toPandas()
    low, high, longest, ring_rows = (rings[c].to_numpy() for c in ("low", "high", "longest", "n"))
    ring_pivot, ring_bit = rings["pivot"].to_numpy(), 1 << rings["ring"].to_numpy(np.int64)
    ring_top = pivot_top[ring_pivot]

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ring", "id", "row"])
        return pd.DataFrame({"pivot": pdf["pivot"].iloc[:1], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "rows": [pdf["row"].to_numpy(np.int64).tobytes()], "rings": [pdf["ring"].to_numpy(np.int64).tobytes()], "vs": [b"".join(pdf["v"])]})

    salted = placed.withColumn("salt", F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / BLOCK_ROWS))).drop("n", "dist", "len")
    blocks = durable(salted.groupBy("pivot", "salt").applyInPandas(block, "pivot int, ids binary, rows binary, rings binary, vs binary"))

    def bounds(m: np.ndarray) -> np.ndarray:
        """The highest score that each query may find in each annulus, with a slack for rounding."""
        q = np.sqrt((m * m).sum(1))[:, None]
        # Queries as long as the band's vectors.
        unit = m / np.maximum(q, 1e-300) @ pivots[:, :dim].T
        d = np.sqrt(np.maximum(pivot_top + (pivots * pivots).sum(1) - 2 * np.sqrt(pivot_top) * unit, 0))[:, ring_pivot]
        near = np.maximum(np.maximum(d - high, low - d) - 1e-6 * np.sqrt(ring_top), 0)
        cosine = 1 - near * near / np.maximum(2 * ring_top, 1e-300)
        return q * np.minimum(cosine * np.sqrt(ring_top), longest) + 1e-9 * (q * q + ring_top)

    def slices(batches):
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK_ROWS):
                part = pdf.iloc[at : at + BLOCK_ROWS]
                yield part, np.frombuffer(b"".join(part["v"])).reshape(len(part), dim)

    def choose(batches):
        """Queries with the pivots they visit first: those with the highest scores themselves."""
        held = np.unique(ring_pivot)
        for part, m in slices(batches):
            first = np.argsort(-(m @ pivots[held, :dim].T), axis=1, kind="stable")[:, :FIRST_PIVOTS]
            yield part.assign(first=list(held[first].astype(np.int32)))

    queries = placed.filter(is_query(F.col("id"))).select("id", "row", "v")
    queries = durable(queries.mapInPandas(released(choose), "id long, row long, v binary, first array<int>"))
    groups = max(1, -(-queries.count() // BLOCK_ROWS))

    def asked(found: DataFrame | None) -> DataFrame:
        """(id, row, pivot, mask, n, v, least): the annuli of each pivot that a query asks for, and their rows.

        Without what has been found those of its first pivots; else all others that may hold better rows.
        """
        if found is None:
            state = queries.withColumn("least", F.lit(float("-inf")))
        else:
            kth = found.filter(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").cast("double").alias("least"))
            state = queries.join(kth, "row", "left").select("id", "row", "v", "first", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
        begins = found is None

        def ask(batches):
            for part, m in slices(batches):
                first = (np.stack(part["first"])[:, :, None] == ring_pivot).any(1)
                want = first if begins else ~first & (bounds(m) >= part["least"].to_numpy(float)[:, None])
                q, r = np.nonzero(want)
                rows = pd.DataFrame({"at": q, "pivot": ring_pivot[r], "mask": ring_bit[r], "n": ring_rows[r]})
                rows = rows.groupby(["at", "pivot"], as_index=False).sum()
                yield rows.join(part[["id", "row", "v", "least"]].reset_index(drop=True), on="at")[["id", "row", "pivot", "mask", "n", "v", "least"]]

        return state.select("id", "row", "v", "first", "least").mapInPandas(released(ask), "id long, row long, pivot int, mask long, n long, v binary, least double")

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"pivot": pdf["pivot"].iloc[:1], "q_ids": [pdf["id"].to_numpy(np.int64).tobytes()], "q_rows": [pdf["row"].to_numpy(np.int64).tobytes()], "q_masks": [pdf["mask"].to_numpy(np.int64).tobytes()], "q_vs": [b"".join(pdf["v"])], "q_least": [pdf["least"].to_numpy(np.float64).tobytes()]})

    def score(batches):
        for pdf in batches:
            out = [pd.DataFrame({"query_id": [], "query_row": [], "vec_id": [], "score": []}).astype("int64")]
            for r in pdf.itertuples(index=False):
                ids, row, masks, q_ids, q_row = (np.frombuffer(x, np.int64) for x in (r.ids, r.rows, r.q_masks, r.q_ids, r.q_rows))
                c, q = np.frombuffer(r.vs).reshape(len(ids), dim), np.frombuffer(r.q_vs).reshape(len(q_ids), dim)
                if not exact_doubles:
                    c, q = c.astype(np.int64), q.astype(np.int64)
                s = np.full((len(q), len(c)), NONE)
                ring, begin = np.unique(np.frombuffer(r.rings, np.int64), return_index=True)
                for g, b, e in zip(ring, begin, [*begin[1:], len(c)]):
                    asks = np.flatnonzero(masks >> g & 1)
                    if len(asks):
                        s[asks, b:e] = (q[asks] @ c[b:e].T).astype(np.int64)
                s[q_row[:, None] == row[None]] = NONE
                least = np.frombuffer(r.q_least)
                if len(c) > k:
                    least = np.maximum(least, np.partition(s, -k, axis=1)[:, -k])
                i, j = np.nonzero((s > NONE) & (s >= least[:, None]))
                # By query, then score, then id: the first k of each.
                order = np.lexsort((ids[j], -s[i, j], i))
                i, j = i[order], j[order]
                best = np.arange(len(i)) - np.searchsorted(i, i) < k
                i, j = i[best], j[best]
                out.append(pd.DataFrame({"query_id": q_ids[i], "query_row": q_row[i], "vec_id": ids[j], "score": s[i, j]}))
            yield pd.concat(out)

    def answers(asked: DataFrame) -> DataFrame:
        """The best k of each block for each query that asks for its annuli, where no worse than what it has."""
        salted = asked.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(groups)))
        packed = salted.groupBy("pivot", "salt").applyInPandas(group, "pivot int, q_ids binary, q_rows binary, q_masks binary, q_vs binary, q_least binary")
        return packed.join(blocks, "pivot").drop("pivot").mapInPandas(released(score), "query_id long, query_row long, vec_id long, score long")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    first = asked(None)
    found = durable(best(answers(first)))
    rest = asked(found)
    out = best(found.drop("rank").unionByName(answers(rest)))
    work = first.select("id", "row", "n").union(rest.select("id", "row", "n")).groupBy("id", "row").agg(F.sum("n").alias("scored"))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), work.select(F.col("id").alias("query_id"), "scored")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), 5, lambda c: c % 50 == 0)


QUERIES = {"op7_topk_search": op7_topk_search}

ORACLE_SQL = {
    "op7_topk_search": """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id,
    coalesce(list_sum(list_transform(range(1, least(len(q.e), len(c.e)) + 1), lambda i: q.e[i] * c.e[i])), 0)::BIGINT AS score
  FROM v AS q JOIN v AS c ON q.n <> c.n WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
}
