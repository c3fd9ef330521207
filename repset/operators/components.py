"""Connected components as a DataFrame loop (large-star / small-star contraction)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repset.session import drop, materialize


#: edges (16 bytes each) up to which one task contracts them all; beyond, rounds of joins do
ONE_TASK = 500_000


def _contracted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components of the edges of one task: each round hooks roots to the smaller root of an edge and
    shortens all paths, until nothing changes."""
    edges = pd.concat([p for p in parts] or [pd.DataFrame({"u": [], "v": []}, dtype=np.int64)])
    nodes, at = np.unique(edges[["u", "v"]].to_numpy(np.int64).T, return_inverse=True)
    a, b = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        new, low = root.copy(), np.minimum(x, y)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    yield pd.DataFrame({"node": nodes, "component": nodes[root]})


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every end of an edge; component = smallest node reachable.

    Up to ONE_TASK edges are one small task. Beyond, neighbourhoods are never gathered: each round is a grouped minimum (combined map-side) and an
    equi-join that AQE can split, so a hub with a third of all edges stays spread out. Each round
    ends in a table of the shared folder; rounds grow with the logarithm of the longest path, and
    more than ``max_rounds`` are an error. Edges with a null end and self-loops are left out; nodes
    without another edge don't appear."""
    spark = edges.sparkSession
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v").distinct()
    e, uri = materialize(e, "cc")
    if all(t == "bigint" for _, t in e.dtypes) and e.count() <= ONE_TASK:
        found, _ = materialize(e.repartition(1).mapInPandas(_contracted, "node long, component long"), "components")
        drop(spark, uri)
        return found
    mark = None
    for k in range(max_rounds + 1):
        if k == max_rounds:
            raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
        nxt, new = materialize(_small_star(_large_star(e)).distinct(), "cc")
        drop(spark, uri)
        e, uri = nxt, new
        row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == mark or not row[0]:
            break
        mark = tuple(row)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
