"""Tables of pairs: gates, reciprocal means, mirroring, completion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repset.operators.sketch import BROADCAST_ITEMS, _few


def coverage_gate(pairs: DataFrame, least: float) -> DataFrame:
    """Similarity 0 where the coverage isn't above ``least``; rows stay. The similarity ``back`` of
    the other direction, whose coverage may differ, is left out."""
    return pairs.drop("back").withColumn("ani", F.when(F.col("coverage") <= least, 0.0).otherwise(F.col("ani")))


def reciprocal(pairs: DataFrame) -> DataFrame:
    """``query, reference, av_ani, dist``: mean of both directions, 1 for an item with itself; pairs
    without the other direction are left out. Pairs that hold the similarity ``back`` of the other
    direction (of ``sketch.containment``) need no join, and keep their ``block``."""
    keep = ["block"] if {"block", "back"} <= {*pairs.columns} else []
    if "back" not in pairs.columns:
        back = pairs.select(F.col("query").alias("reference"), F.col("reference").alias("query"), F.col("ani").alias("back"))
        pairs = pairs.join(back, ["query", "reference"])
    av = F.when(F.col("query") == F.col("reference"), 1.0).otherwise((F.col("ani") + F.col("back")) / 2)
    return pairs.select(*keep, "query", "reference", av.alias("av_ani"), (1 - av).alias("dist"))


def mirror(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Both directions of unordered pairs, and each item with itself."""
    both = pairs.select("query", "reference", "ani", "coverage").union(pairs.select("reference", "query", "ani", "coverage"))
    return both.union(items.select("item", "item", F.lit(1.0), F.lit(1.0)))


def densify(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """All ordered pairs of each block (item, block); absent ones have similarity and coverage 0."""
    every = blocks.select("block", F.col("item").alias("query")).join(blocks.select("block", F.col("item").alias("reference")), "block")
    full = every.join(pairs.select("query", "reference", "ani", "coverage"), ["query", "reference"], "left")
    return full.select("block", "query", "reference", F.coalesce("ani", F.lit(0.0)).alias("ani"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def restrict(pairs: DataFrame, items: DataFrame, one: str = "query", two: str = "reference") -> DataFrame:
    """Pairs both ends of which are among ``items`` (item)."""
    for side in (one, two):
        pairs = pairs.join(items.select(F.col("item").alias(side)).distinct(), side, "left_semi")
    return pairs


def aligned(totals: DataFrame, lengths: DataFrame, method: str = "larger") -> DataFrame:
    """``query, reference, alignment_length, similarity_errors, ani, query_length, reference_length,
    query_coverage, reference_coverage, coverage`` from totals (query, reference, alignment_length,
    similarity_errors) and lengths (item, length); similarity 0 without aligned length."""
    p = totals.join(lengths.select(F.col("item").alias("query"), F.col("length").alias("query_length")), "query")
    p = p.join(lengths.select(F.col("item").alias("reference"), F.col("length").alias("reference_length")), "reference")
    n = F.col("alignment_length")
    ani = F.when(n > 0, (n - F.col("similarity_errors")) / n).otherwise(0.0)
    both = coverage(n, F.col("query_length"), F.col("reference_length"), method)
    return p.select("query", "reference", "alignment_length", "similarity_errors", ani.alias("ani"), "query_length", "reference_length", (n / F.col("query_length")).alias("query_coverage"), (n / F.col("reference_length")).alias("reference_coverage"), both.alias("coverage"))


def with_self(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """``query, reference, ani, coverage`` and a row of ones for each item with itself."""
    own = items.select("item").distinct()
    return pairs.where("query <> reference").select("query", "reference", "ani", "coverage").union(own.select("item", "item", F.lit(1.0), F.lit(1.0)))


def correlated(sketched: DataFrame, compared: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """Pairs that have a similarity by sketches (item1, item2, dist) above 0 and another one (query,
    reference, ani): ``query, reference, similarity, ani``, and ``block`` and ``back`` if the other one has them; with
    ``clusters`` (item, cluster) those within one."""
    s = sketched.where("dist < 1").select(F.col("item1").alias("query"), F.col("item2").alias("reference"), (1 - F.col("dist")).alias("similarity"))
    keep = [c for c in ("block", "back") if c in compared.columns]
    out = s.join(compared.select("query", "reference", "ani", *keep), ["query", "reference"])
    if clusters is not None:
        for side in ("query", "reference"):
            out = out.join(clusters.select(F.col("item").alias(side), F.col("cluster").alias(f"c_{side}")), side)
        out = out.where("c_query = c_reference").drop("c_query", "c_reference")
    return out


def correlated_copies(found: DataFrame, items: DataFrame) -> DataFrame:
    """``similarity, ani, diff`` of all items (block, rep, item, size) from ``correlated`` pairs (block, query < reference, similarity,
    ani, back) of representatives: the similarity is from the smaller item, ``diff`` is that of their sizes, and copies are
    equal to one another. Items are sent to the pairs, and no pair is sent."""
    side = _few(items.select("block", "rep", "item", "size"), BROADCAST_ITEMS)
    each = found.join(side.toDF("block", "query", "item1", "n1"), ["block", "query"]).join(side.toDF("block", "reference", "item2", "n2"), ["block", "reference"])
    diff = F.abs(F.col("n1") - F.col("n2")).alias("diff")
    each = each.select("similarity", F.when(F.col("item1") < F.col("item2"), F.col("ani")).otherwise(F.col("back")).alias("ani"), diff)
    one, two = (items.select("block", "rep", F.col("item").alias(f"item{k}"), F.col("size").alias(f"n{k}")) for k in (1, 2))
    return each.union(one.join(two, ["block", "rep"]).where("item1 < item2").select(F.lit(1.0), F.lit(1.0), diff))


def coverage(shared, len1, len2, method: str = "larger"):
    """``larger``: of the longer share of either; ``total``: twice the shared over both lengths."""
    if method == "larger":
        return F.greatest(shared / len1, shared / len2)
    if method == "total":
        return 2 * shared / (len1 + len2)
    raise ValueError(method)
