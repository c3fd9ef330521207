"""Changes to finished clusterings: removal, comparison of winners, merged names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remove_cluster(clusters: DataFrame, name: str) -> DataFrame:
    """Drop a primary cluster (``3``) or a secondary one (``3_1``)."""
    gone = F.col("secondary_cluster") == name if "_" in name else F.col("primary_cluster") == int(name)
    return clusters.where(~gone)


def replace_block(clusters: DataFrame, block: int, again: DataFrame) -> DataFrame:
    """Clusters (item, primary_cluster, secondary_cluster, ...) with those of one primary cluster replaced by ``again``
    (item, cluster): names ``<block>_<cluster>``. Items of the block that ``again`` lacks are an error."""
    old, new = clusters.where(F.col("primary_cluster") == block), again.select("item", F.col("cluster").cast("string").alias("__new"))
    lost = old.join(new, "item", "left_anti").select("item").limit(10).collect()
    if lost:
        raise ValueError(f"items without a new cluster: {[r[0] for r in lost]}")
    changed = old.join(new, "item").withColumn("secondary_cluster", F.concat_ws("_", F.lit(str(block)), "__new")).select(*clusters.columns)
    return clusters.where(F.col("primary_cluster") != block).unionByName(changed)


def in_order(clusters: DataFrame, column: str = "secondary_cluster") -> DataFrame:
    """Sorted by primary and secondary number of the cluster's name."""
    return clusters.orderBy(F.split(column, "_").getItem(0).cast("double") + F.split(column, "_").getItem(1).cast("double") / 100, column)


def winner_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``cluster, old_item, new_item, change`` with change one of new, gone, changed, same."""
    j = old.toDF("cluster", "old_item").join(new.toDF("cluster", "new_item"), "cluster", "full")
    change = F.when(F.col("old_item").isNull(), "new").when(F.col("new_item").isNull(), "gone").when(F.col("old_item") != F.col("new_item"), "changed").otherwise("same")
    return j.withColumn("change", change)


def merged_names(mapping: DataFrame) -> DataFrame:
    """``old, new``: clusters (old ``p_s``, group) that share a group get their primaries and
    secondaries, each sorted and joined by dots; the others keep their name. Equal merged names of
    different groups get the group as a suffix."""
    p, s = F.split("old", "_").getItem(0), F.split("old", "_").getItem(1)
    name = F.concat(F.array_join(F.array_sort(F.collect_set(p)), "."), F.lit("_"), F.array_join(F.array_sort(F.collect_set(s)), "."))
    g = mapping.groupBy("group").agg(F.countDistinct("old").alias("n"), name.alias("name"))
    twice = g.where("n > 1").groupBy("name").agg(F.count(F.lit(1)).alias("k"))
    g = g.join(twice, "name", "left").withColumn("name", F.when(F.coalesce("k", F.lit(1)) > 1, F.concat("name", F.lit("#"), F.col("group").cast("string"))).otherwise(F.col("name")))
    return mapping.join(g, "group").select("old", F.when(F.col("n") > 1, F.col("name")).otherwise(F.col("old")).alias("new"))
