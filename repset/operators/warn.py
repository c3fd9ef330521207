"""Messages about clusterings that a slightly different threshold would change."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repset.operators import linkage


def links(pairs: DataFrame, method: str, most: int = 5000) -> DataFrame:
    """``block, height``: the heights at which each block (block, query, reference, dist) is joined.

    In blocks above ``most`` items those at distance 0 are one row of the matrix."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        names, d = linkage.square(pdf, most)
        w = linkage.weights(pdf, names)
        height = np.concatenate([np.zeros(int(w.sum()) - len(w)), linkage.tree(d, method, w)[:, 2]])
        return pd.DataFrame({"block": pdf["block"].iloc[0], "height": height})

    return linkage.prepared(pairs, most)[0].groupBy("block").applyInPandas(one, "block long, height double")


def edges(heights: DataFrame, cutoff: float, within: float = 0.25) -> DataFrame:
    """``block, height, message`` of joins within ``within`` percent of the cutoff, on either side."""
    x, at = (1 - F.col("height")) * 100, (1 - cutoff) * 100
    found = heights.where((F.abs(x - at) < within) & (x != at))
    return found.withColumn("message", F.format_string("block %s: %s (%.2f, threshold %.2f)", F.col("block").cast("string"), F.when(x < at, "almost not split").otherwise("almost split"), x, F.lit(at)))


def alike(pairs: DataFrame, chosen: DataFrame, similarity: float = 0.98, coverage: float | None = None) -> DataFrame:
    """Pairs (query, reference, ani, coverage) of two chosen items (item) that are above ``similarity``
    and, if given, ``coverage``; each pair once, the larger item first, with the higher similarity."""
    p = pairs.where((F.col("query") != F.col("reference")) & (F.col("ani") > similarity))
    if coverage is not None:
        p = p.where(F.col("coverage") > coverage)
    for side in ("query", "reference"):
        p = p.join(chosen.select(F.col("item").alias(side)).distinct(), side, "left_semi")
    return p.groupBy(F.greatest("query", "reference").alias("item1"), F.least("query", "reference").alias("item2")).agg(F.max("ani").alias("ani"))


def high_self(pairs: DataFrame, cutoff: float) -> DataFrame:
    """``block, dist, message`` of blocks in which an item differs from itself by more than the cutoff of clusters."""
    d = self_distance(pairs).where(F.col("dist") > cutoff)
    return d.withColumn("message", F.format_string("block %s: high self comparison (%.4f)", F.col("block").cast("string"), "dist"))


def self_distance(pairs: DataFrame, least: float = 1e-4) -> DataFrame:
    """``block, dist``: 1 minus the lowest similarity of an item with itself; ``least`` where that is 0."""
    own = pairs.where("query = reference").groupBy("block").agg((1 - F.min("ani")).alias("d"))
    return own.select("block", F.when(F.col("d") == 0, least).otherwise(F.col("d")).alias("dist"))
