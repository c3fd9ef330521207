"""Mixing sources to target weights: hash-random keys, distributed prefix sums, exact budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repset.session import materialize

WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """``(source, source_size)`` -> with weight and target.

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share the sum of all sizes;
    a target stops at ``most`` times its source's size and the excess is shared anew by weight.
    Filling in the order of size/weight, the capped sources are a prefix, so running sums give
    the level at which no target is above its cap. One row a source goes through these windows."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
    s = s.withColumns({"cap": F.lit(most) * F.col("source_size"), "ratio": F.lit(float(most)) * F.col("source_size") / F.col("weight"), "total": F.sum("source_size").over(every), "wtotal": F.sum("weight").over(every)})
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"rest": F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)), "wrest": F.col("wtotal") - F.coalesce(F.sum("weight").over(before), F.lit(0))})
    # the first source in this order that its share doesn't overfill, and all after it, share what the capped ones leave
    s = s.withColumn("fits", F.col("rest") * F.col("weight") <= F.col("cap") * F.col("wrest"))
    s = s.withColumn("open", F.max("fits").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumns({"rest0": F.max(F.when(F.col("fits"), F.col("rest"))).over(every), "wrest0": F.max(F.when(F.col("fits"), F.col("wrest"))).over(every)})
    target = F.when(F.col("open"), F.col("rest0").cast("double") * F.col("weight") / F.col("wrest0")).otherwise(F.col("cap").cast("double"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def mix_sources(docs: DataFrame, seed: str = "mix", most: int = 3, bucket_rows: int = 5_000) -> DataFrame:
    """``doc_id, text_hash, source, size, source_size, target, taken, key`` for every row of ``docs`` (doc_id, text, source).

    A document's key is the md5 of seed and id: uniform, the same in every run, and spread over
    buckets of equal width, so sorting one source by it needs no sampling and no task gets a whole
    source, however large. Prefix sums come from bucket totals (one row a source and bucket) plus
    a running sum inside each bucket; the text itself is never shuffled. A source takes its budget
    (the target, rounded) as whole passes over its documents in key order and then the next words
    up to the budget, so the last document taken may be cut. Texts are read once: the narrow table
    of sizes and keys is kept in the shared folder.

    Null text or one of white space has size 0 and takes 0. Null source is a source of its own.
    A null id hashes as its text; equal ids are ordered by size and take as separate rows.
    An empty table gives an empty result."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary")), F.lit(""))
    key = F.md5(F.concat(F.lit(f"{seed}:"), own).cast("binary"))
    d, _ = materialize(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "source", word_count(F.col("text")).alias("size"), key.alias("key")), "mix")
    targets = source_targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), most)
    # buckets by the key's first 32 bits; about bucket_rows of all rows in each
    head = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    rows = d.groupBy().agg(F.count(F.lit(1)).alias("n_rows"))
    d = d.crossJoin(F.broadcast(rows))  # one row, so this adds a column
    d = d.withColumn("bucket", F.floor(head * F.ceil(F.col("n_rows") / bucket_rows) / F.lit(2**32))).drop("n_rows")
    order = [F.col("key"), F.col("doc_id"), F.col("size")]
    inside = Window.partitionBy("source", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("ahead")).join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "weight")
    starts = starts.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "ahead", "source_size", "target")
    d = d.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    budget = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(0)
    d = d.withColumns({"start": F.col("ahead") + F.col("within"), "passes": passes, "left": budget - passes * F.col("source_size")})
    taken = F.col("size") * F.col("passes") + F.greatest(F.lit(0), F.least("size", F.col("left") - F.col("start")))
    return d.select("doc_id", "text_hash", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "key")


ORACLE = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
                  md5('mix:' || coalesce(doc_id::VARCHAR, md5(text), '')) AS key FROM documents),
 s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
 s1 AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM s0),
 s2 AS (SELECT *, 3 * source_size AS cap, 3.0::DOUBLE * source_size / weight AS ratio, sum(source_size) OVER () AS total, sum(weight) OVER () AS wtotal FROM s1),
 s3 AS (SELECT *, total - coalesce(sum(cap) OVER w, 0) AS rest, wtotal - coalesce(sum(weight) OVER w, 0) AS wrest FROM s2
        WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 s4 AS (SELECT *, rest * weight <= cap * wrest AS fits FROM s3),
 s5 AS (SELECT *, max(fits::INT) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS opened,
               max(CASE WHEN fits THEN rest END) OVER () AS rest0, max(CASE WHEN fits THEN wrest END) OVER () AS wrest0 FROM s4),
 t AS (SELECT source, source_size, CASE WHEN opened = 1 THEN rest0::DOUBLE * weight / wrest0 ELSE cap::DOUBLE END AS target FROM s5),
 p AS (SELECT d.*, t.source_size, t.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
       FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
 b AS (SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS passes FROM p)
SELECT doc_id, size, source_size, target,
       (size * passes + greatest(0, least(size, round(target)::BIGINT - passes * source_size - start)))::BIGINT AS taken
FROM b
"""
