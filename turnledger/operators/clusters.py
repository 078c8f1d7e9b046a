"""Clusters of items by the cosine of their terms, with a cap on their size.

Items are merged along their links, most similar first, as long as a cluster stays within the
cap. Items with equal terms are one node (a full one at the cap), so no group of equal items is
expanded into pairs.

Links have numbers in their order and are settled in blocks of it. Of a block all links are
looked up at once: sizes only grow, so a link whose two clusters don't fit together never will,
and is struck out, and of the links between two clusters only the best can matter. What is left
of a block, whose size is bounded, one task merges link by link. So the number of rounds grows
with the number of links over the size of a block, whatever the shape of the graph: a hub that
takes in 49 neighbours one after the other costs no 49 rounds. Blocks in which little was open
are followed by longer ones.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fnv1a_hex, label_of
from ..tables import numbered, stored
from .similarity import SIMILAR, similar_sessions, term_idf

CAP = 50
#: Open links that one task may settle in order; a block has LEAST at least.
BLOCK, LEAST = 1 << 19, 32


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that can be reached over edges (a, b), by labels that jump."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = low.select(F.col("node").alias("low"), F.col("low").alias("next"))
        moved = stored(low.join(jump, "low").select("node", F.col("label").alias("was"), F.col("next").alias("label")))
        labels = moved.select("node", "label")
        if not moved.filter("was <> label").limit(1).count():
            return labels


def merge_in_order(nodes: pd.DataFrame, links: pd.DataFrame, cap: int) -> pd.DataFrame:
    """(top, to, total): where the clusters (top, total) go when links (x, y, place) are taken in order and merged while sizes fit."""
    parent = {n: n for n in nodes["top"]}
    size = dict(zip(nodes["top"], nodes["total"]))

    def end(n):
        while parent[n] != n:
            parent[n] = n = parent[parent[n]]
        return n

    links = links.sort_values("place")
    for x, y in zip(links["x"], links["y"]):
        x, y = end(x), end(y)
        if x != y and size[x] + size[y] <= cap:
            x, y = (x, y) if size[x] >= size[y] else (y, x)
            parent[y], size[x] = x, size[x] + size[y]
    to = [end(n) for n in parent]
    return pd.DataFrame({"top": list(parent), "to": to, "total": [size[n] for n in to]})


def merge_rounds(nodes: DataFrame, links: DataFrame, cap: int, block: int = BLOCK) -> DataFrame:
    """(node, top): the cluster of each node. nodes: (node, size); links: (a, b, similarity)."""
    block = max(block, LEAST)
    order = [F.desc("similarity"), F.asc("a"), F.asc("b")]
    # In files by place, so that a block reads its own.
    placed = stored(numbered(links.select("a", "b", "similarity"), order, "place").select("place", "a", "b"))
    n = placed.count()
    labels = stored(nodes.select("node", F.col("node").alias("top"), F.col("size").cast("long").alias("total")))
    done, width = 0, block
    while done < n:
        # Joins by merge: in a loop, broadcasts of the labels would add up at the driver.
        end = lambda side, name: labels.select(F.col("node").alias(side), F.col("top").alias(name), F.col("total").alias(f"total_{name}")).hint("merge")  # noqa: E731, B023
        e = placed.filter((F.col("place") > done) & (F.col("place") <= done + width)).join(end("a", "x"), "a").join(end("b", "y"), "b")
        e = e.filter((F.col("x") != F.col("y")) & (F.col("total_x") + F.col("total_y") <= cap))
        pairs = e.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min("place").alias("place"), F.min(F.when(F.col("x") < F.col("y"), F.col("total_x")).otherwise(F.col("total_y"))).alias("total_x"), F.min(F.when(F.col("x") < F.col("y"), F.col("total_y")).otherwise(F.col("total_x"))).alias("total_y"))
        pairs = stored(pairs)
        open_ = pairs.count()
        if open_ > block:
            width //= 2
            continue
        if open_:
            moves = stored(_in_order(pairs, cap)).hint("merge")
            labels = stored(labels.withColumnRenamed("total", "_total").join(moves, "top", "left").select("node", F.coalesce("to", "top").alias("top"), F.coalesce("total", "_total").alias("total")))
        done += width
        width = width * 2 if open_ <= block // 4 else width
    return labels.select("node", "top")


def _in_order(pairs: DataFrame, cap: int) -> DataFrame:
    """merge_in_order() of pairs (x, y, place, total_x, total_y), which are no more than a block, in one task."""

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        ends = [pdf[[n, f"total_{n}"]].set_axis(["top", "total"], axis=1) for n in ("x", "y")]
        return merge_in_order(pd.concat(ends).drop_duplicates("top"), pdf, cap)

    return pairs.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(greedy, "top string, to string, total long")


def cluster_items(items: DataFrame, threshold: float = SIMILAR, cap: int | None = CAP) -> DataFrame:
    """(item, cluster) over rows (item, terms), cluster being its smallest item; an item without terms is alone.

    Without a cap clusters are the connected components. Items are in the order of their names.
    """
    sets = items.select("item", F.array_sort(F.array_distinct("terms")).alias("terms"))
    place = F.row_number().over(Window.partitionBy("terms").orderBy("item"))
    chunk = F.floor((place - 1) / cap) if cap else F.lit(0)
    numbered = sets.withColumn("chunk", F.when(F.size("terms") > 0, chunk))
    # A node is up to cap items with equal terms; only the last one of a set may have room.
    w = Window.partitionBy("terms", F.coalesce("chunk", F.xxhash64("item")))
    of = stored(numbered.withColumn("node", F.min("item").over(w)).withColumn("size", F.count("*").over(w)))
    room = of.filter("size(terms) > 0").select("node", "terms", "size").distinct()
    room = stored(room.filter(F.col("size") < cap) if cap else room)
    # Terms weigh by all items, though only nodes with room are compared.
    links = stored(similar_sessions(items, threshold, room.select(F.col("node").alias("item"), "terms")))
    if cap is None:
        merged = components(links).select("node", F.col("label").alias("top"))
    else:
        ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
        merged = merge_rounds(room.join(ends, "node", "left_semi").select("node", "size"), links, cap)
    named = of.join(merged, "node", "left").select("item", F.coalesce("top", "node").alias("top"))
    return named.withColumn("cluster", F.min("item").over(Window.partitionBy("top"))).select("item", "cluster")


def cluster_terms(items: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, name, terms, cluster_id): terms by members, weight and alphabet; the id is a hash of the members."""
    t = items.select("item", F.explode(F.array_distinct("terms")).alias("term")).join(clusters, "item").join(term_idf(items).select("term", "idf"), "term")
    by = t.groupBy("cluster", "term").agg(F.count("*").alias("members"), F.round(F.sum("idf"), 9).alias("weight"))
    top = by.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("members"), F.desc("weight"), "term"))).filter("r <= 8")
    terms = top.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]).alias("terms"))
    # A cluster has at most as many members as its cap.
    ids = clusters.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list("item")), "|").alias("members"))
    out = clusters.select("cluster").distinct().join(terms, "cluster", "left").join(ids, "cluster")
    none = F.array().cast("array<string>")
    return out.select("cluster", label_of(F.coalesce("terms", none)).alias("name"), F.coalesce("terms", none).alias("terms"), fnv1a_hex(F.col("members")).alias("cluster_id"))
