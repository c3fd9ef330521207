"""Dereplication of scaffolds over files in order of priority."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repset.operators.ranges import first_by
from repset.session import drop, materialize


def snp_rows(snps: DataFrame) -> DataFrame:
    """SNPs (rl, r_scaff, ql, q_scaff) once for each position of the query, then of the reference; the lowest partner stays."""
    one = first_by(snps, ["q_scaff", "ql"], [F.col("r_scaff"), F.col("rl")])
    return first_by(one, ["r_scaff", "rl"], [F.col("q_scaff"), F.col("ql")])


def split_ani(splits: DataFrame) -> DataFrame:
    """``length`` and ``ani`` of splits (split_start, split_end, n), each by its own length."""
    length = F.col("split_end") - F.col("split_start")
    return splits.withColumns({"length": length, "ani": F.when(length > 0, (length - F.col("n")) / length)})


def coverage_ani(alignments: DataFrame, lengths: DataFrame) -> DataFrame:
    """``r_scaff, q_scaff, r_aln_length, alignments, coverage, ani`` of alignments (r_scaff, q_scaff, length, errors): the aligned
    share of the first scaffold (lengths: scaffold, length), and the share of it that is the same."""
    g = alignments.groupBy("r_scaff", "q_scaff").agg(F.sum("length").alias("n"), F.sum("errors").alias("errors"), F.count(F.lit(1)).alias("alignments"))
    g = g.join(lengths.select(F.col("scaffold").alias("r_scaff"), F.col("length").alias("whole")), "r_scaff")
    return g.select("r_scaff", "q_scaff", F.col("n").cast("long").alias("r_aln_length"), "alignments", (F.col("n") / F.col("whole")).alias("coverage"), ((F.col("n") - F.col("errors")) / F.col("n")).alias("ani"))


def dereplicate(scaffolds: DataFrame, pairs: DataFrame, least_coverage: float = 0.5, least_ani: float = 0.95, ignore_same: bool = False) -> DataFrame:
    """``scaffolds`` (scaffold, file, priority) with ``removed``: a scaffold goes if it is alike enough
    to one that stays from a file of smaller priority (pairs: new, old, coverage, ani; both limits
    inclusive). Scaffolds of the first file stay. ``scaffold`` names must be unique over all files;
    ``ignore_same`` leaves out pairs whose names after the file's prefix (``file:name``) are equal.

    What files decide in turn is decided here in rounds, each for all scaffolds whose earlier partners
    are decided; the rounds are at most the number of files, and each is two equi-joins."""
    spark = scaffolds.sparkSession
    p = pairs.where((F.col("coverage") >= least_coverage) & (F.col("ani") >= least_ani))
    if ignore_same:
        p = p.where(F.substring_index("new", ":", -1) != F.substring_index("old", ":", -1))
    rank = scaffolds.select("scaffold", "priority")
    e = p.join(rank.toDF("new", "p1"), "new").join(rank.toDF("old", "p2"), "old").where("p1 > p2").select("new", "old").distinct()
    e, at = materialize(e, "links")
    gone, spent = spark.createDataFrame([], scaffolds.select("scaffold").schema), []
    while not e.isEmpty():
        stay = e.select(F.col("old").alias("s")).distinct().join(e.select(F.col("new").alias("s")), "s", "left_anti")
        out, where = materialize(e.join(stay, F.col("old") == F.col("s")).select(F.col("new").alias("scaffold")).distinct(), "removed")
        gone, spent = gone.union(out), [*spent, where]
        left = e.join(out.toDF("new"), "new", "left_anti").join(out.toDF("old"), "old", "left_anti")
        # partners that stay have decided all they can
        left, nxt = materialize(left, "links")
        drop(spark, at)
        e, at = left, nxt
    drop(spark, at)
    done, _ = materialize(scaffolds.join(gone.withColumn("removed", F.lit(True)), "scaffold", "left").withColumn("removed", F.coalesce("removed", F.lit(False))), "scaffolds")
    drop(spark, *spent)
    return done


def report(done: DataFrame) -> DataFrame:
    """``file, removed, total``."""
    return done.groupBy("file").agg(F.sum(F.col("removed").cast("long")).alias("removed"), F.count(F.lit(1)).alias("total"))
