"""Names of items from the hits of their genes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repset.operators.ranges import first_by


def top_hits(hits: DataFrame, gene: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """The best-scored hit of each gene whose name isn't in ``skip``; ties go to the smaller name."""
    return first_by(hits.where(~F.coalesce(F.col("name").isin(*skip), F.lit(False))) if skip else hits, [gene], [F.desc("score"), F.col("name")])


def by_share(hits: DataFrame, ranks: list[str], least: float, least_score: float = 250) -> DataFrame:
    """``item, rank, name, confidence, best``: of each rank (columns of ``hits``, highest first) the most
    frequent name, in percent of all the item's hits that have a name of the first rank. ``best`` marks the
    lowest rank of at least ``least`` percent. Hits count above ``least_score``; ties go to the smaller name."""
    h = hits.where(F.col("score") > least_score)
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("depth"), F.lit(r).alias("rank"), F.col(r).alias("name")) for k, r in enumerate(ranks)))).alias("c")
    n = h.select("item", cells).where("c.name IS NOT NULL").groupBy("item", "c.depth", "c.rank", "c.name").agg(F.count(F.lit(1)).alias("n"))
    total = n.where("depth = 0").groupBy("item").agg(F.sum("n").alias("total"))
    top = first_by(n, ["item", "depth"], [F.desc("n"), F.col("name")]).join(total, "item")
    top = top.withColumn("confidence", 100.0 * F.col("n") / F.col("total"))
    best = top.where(F.col("confidence") >= least).groupBy("item").agg(F.max("depth").alias("b"))
    return top.join(best, "item", "left").select("item", "rank", "name", "confidence", F.coalesce(F.col("depth") == F.col("b"), F.lit(False)).alias("best"))


def by_mode(hits: DataFrame, ranks: list[str]) -> DataFrame:
    """``item, rank, name, confidence, best``: of each rank (columns of ``hits``, one row a gene) the most
    frequent name, in percent of all the item's rows; ``best`` marks the highest confidence (ties: the
    rank listed first, the smaller name)."""
    total = hits.groupBy("item").agg(F.count(F.lit(1)).alias("total"))
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("depth"), F.lit(r).alias("rank"), F.col(r).alias("name")) for k, r in enumerate(ranks)))).alias("c")
    n = hits.select("item", cells).where("c.name IS NOT NULL").groupBy("item", "c.depth", "c.rank", "c.name").agg(F.count(F.lit(1)).alias("n"))
    top = first_by(n, ["item", "depth"], [F.desc("n"), F.col("name")]).join(total, "item").withColumn("confidence", 100.0 * F.col("n") / F.col("total"))
    best = top.groupBy("item").agg(F.max_by("depth", F.struct("confidence", -F.col("depth"))).alias("b"))
    return top.join(best, "item").select("item", "rank", "name", "confidence", (F.col("depth") == F.col("b")).alias("best"))


def lineage(items: DataFrame, item: str, ranks: list[str], unknown: str = "unk") -> DataFrame:
    """``item, lineage``: the names of ``ranks`` joined by bars, after the item itself."""
    parts = [F.col(item).cast("string"), *(F.coalesce(F.col(r).cast("string"), F.lit(unknown)) for r in ranks)]
    return items.select(item, F.concat_ws("|", *parts).alias("lineage"))


def attach(items: DataFrame, taxa: DataFrame, item: str) -> DataFrame:
    """Items with the ``name`` of their best row as ``taxonomy``; each must have exactly one."""
    best = taxa.where("best").groupBy("item").agg(F.min("name").alias("taxonomy"), F.count(F.lit(1)).alias("k"))
    out = items.join(best.withColumnRenamed("item", item), item, "left")
    wrong = out.where(F.coalesce("k", F.lit(0)) != 1).select(item).limit(10).collect()
    if wrong:
        raise ValueError(f"not one best name: {[r[0] for r in wrong]}")
    return out.drop("k")
