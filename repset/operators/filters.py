"""Filters and validation of items and their quality tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_length(items: DataFrame, length: str, least: int) -> DataFrame:
    """Keep items of at least ``least``; 0 and 1 switch the filter off."""
    return items.where(F.col(length) >= least) if least > 1 else items


def by_quality(items: DataFrame, quality: DataFrame, item: str, completeness: float = 75, contamination: float = 25) -> DataFrame:
    """Keep items whose quality row is complete and clean enough; a threshold of 0 switches its
    predicate off. NaN counts as missing, and a missing value doesn't pass."""
    q = quality
    for name, least in (("completeness", True), ("contamination", False)):
        limit = completeness if least else contamination
        value = F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
        if limit:
            q = q.where(value >= limit if least else value <= limit)
    return items.join(q.select(item), item, "left_semi")


def repeated(items: DataFrame, name: str) -> DataFrame:
    """``name, n`` of names that occur more than once."""
    return items.groupBy(name).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(items: DataFrame, name: str) -> DataFrame:
    found = repeated(items, name).limit(10).collect()
    if found:
        raise ValueError(f"names occur more than once: {[r[0] for r in found]}")
    return items


def require_quality(items: DataFrame, quality: DataFrame, item: str) -> DataFrame:
    """Quality rows with numbers, if the required columns exist and no item is missing."""
    for c in (item, "completeness", "contamination"):
        if c not in quality.columns:
            raise KeyError(c)
    lost = items.join(quality, item, "left_anti").select(item).limit(10).collect()
    if lost:
        raise IndexError(f"items without quality: {[r[0] for r in lost]}")
    return quality.withColumns({c: F.col(c).cast("double") for c in ("completeness", "contamination")})


def base_names(quality: DataFrame, item: str) -> DataFrame:
    """Items of a quality table as base names."""
    return quality.withColumn(item, F.element_at(F.split(F.col(item).cast("string"), "/"), -1))


def suspicious(quality: DataFrame) -> DataFrame:
    """``column, message`` of quality columns all of whose values are at most 1 and some above 0, as if they were fractions."""
    out = []
    for c in ("completeness", "contamination"):
        most = quality.agg(F.max(F.col(c).cast("double")).alias("m")).where("m > 0 AND m <= 1")
        out.append(most.select(F.lit(c).alias("column"), F.format_string(f"{c} is %.3f at most; percent are expected", "m").alias("message")))
    return out[0].union(out[1])


def tool_quality(table: DataFrame) -> DataFrame:
    """``item, completeness, contamination, strain_heterogeneity`` of a quality tool's own table."""
    names = {"Bin Id": "item", "Completeness": "completeness", "Contamination": "contamination", "Strain heterogeneity": "strain_heterogeneity"}
    return table.select(*(F.col(f"`{a}`").cast("string" if b == "item" else "double").alias(b) for a, b in names.items()))


def with_sizes(quality: DataFrame, info: DataFrame, item: str, fill: bool = False) -> DataFrame:
    """``quality`` with ``length`` and ``n50`` from ``info`` (item, length, n50): replaced, or with ``fill`` only
    the columns that it lacks."""
    wanted = [c for c in ("length", "n50") if not fill or c not in quality.columns]
    if not wanted:
        return quality
    return quality.drop(*wanted).join(info.select(item, *wanted), item, "left")


def in_groups(items: DataFrame, item: str, size: int = 2000) -> DataFrame:
    """``items`` with a ``group`` of about ``size`` rows each, by hash, for tools that take so many at a time."""
    n = max(1, -(-items.count() // size))
    return items.withColumn("group", F.pmod(F.xxhash64(item), F.lit(n)).cast("int"))


def resolve(items: DataFrame, item: str, sources: list[tuple[str, DataFrame]], default: DataFrame) -> DataFrame:
    """Quality of each item from the first source that has it, else the default; with the source's name."""
    out = None
    left = items.select(item)
    for name, q in [*sources, ("default", default)]:
        rows = left.join(q, item).select(item, "completeness", "contamination", F.lit(name).alias("origin"))
        out = rows if out is None else out.unionByName(rows)
        left = left.join(q.select(item), item, "left_anti")
    return out
