"""Segment lengths, N50 and item information."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(items: DataFrame, item: str, text: str) -> DataFrame:
    """``item, idx, len``: each line of a text with its trimmed length, from 0."""
    split = items.select(item, F.posexplode(F.split(text, "\n")).alias("idx", "line"))
    return split.select(item, "idx", F.length(F.trim("line")).cast("long").alias("len"))


def n50(segments: DataFrame, item: str, length: str) -> DataFrame:
    """``item, total, n50``: lengths descending, the first at which the running sum is strictly over
    half of the total. Segments of length 0 are skipped; items without others have no row.
    Equal lengths are summed first, so the window holds one row a distinct length of an item."""
    by = segments.where(F.col(length) > 0).groupBy(item, F.col(length).alias("len")).agg((F.count(F.lit(1)) * F.first(length)).alias("mass"))
    run = Window.partitionBy(item).orderBy(F.desc("len"))
    tally = by.withColumns({"run": F.sum("mass").over(run), "total": F.sum("mass").over(Window.partitionBy(item))})
    return tally.groupBy(item).agg(F.first("total").alias("total"), F.max(F.when(2 * F.col("run") > F.col("total"), F.col("len"))).alias("n50"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
