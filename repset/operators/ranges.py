"""Positions inside ranges, aggregated over fixed splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def splits(positions: DataFrame, ranges: DataFrame, width: int) -> DataFrame:
    """``key, start, end, split, split_start, split_end, n``: positions with start <= x < end of the same
    key, counted by split trunc((x - start) / width), which reaches from split_start to split_end, at
    most the range's own end. Both sides meet in cells of one width, so the join is by equality;
    splits without positions aren't made."""
    cells = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    at = positions.withColumn("cell", F.floor(F.col("x") / width))
    hit = at.join(cells, ["key", "cell"]).where("x >= start AND x < end")
    n = hit.groupBy("key", "start", "end", F.floor((F.col("x") - F.col("start")) / width).cast("long").alias("split")).agg(F.count(F.lit(1)).alias("n"))
    begin = F.col("start") + F.col("split") * width
    return n.select("key", "start", "end", "split", begin.alias("split_start"), F.least(begin + width, F.col("end")).alias("split_end"), "n")


def require_one_range(positions: DataFrame, ranges: DataFrame, width: int) -> DataFrame:
    """``positions`` (key, x), if each lies in exactly one of ``ranges`` (key, start, end)."""
    cells = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    at = positions.select("key", "x").distinct().withColumn("cell", F.floor(F.col("x") / width))
    hit = at.join(cells.select("key", "cell", "start", "end"), ["key", "cell"], "left")
    n = hit.groupBy("key", "x").agg(F.count_if(F.expr("x >= start AND x < end")).alias("n"))
    wrong = n.where("n <> 1").limit(10).collect()
    if wrong:
        raise ValueError(f"positions not in exactly one range: {[(r['key'], r['x'], r['n']) for r in wrong]}")
    return positions
