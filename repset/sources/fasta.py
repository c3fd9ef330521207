"""FASTA: one row a record, also from .gz; scaffold-to-bin tables; files by bin."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repset.operators.segments import basename, n50
from repset.session import drop, scratch


def records(spark: SparkSession, paths) -> DataFrame:
    """``genome, id, header, sequence, has_lines``. The scan splits files at record starts, so a large
    file is read by many tasks. Text before the first ``>`` and empty files give no record."""
    r = spark.read.option("lineSep", "\n>").text(paths).select(F.col("_metadata.file_name").alias("genome"), "value")
    r = r.where(F.trim("value") != "").withColumn("value", F.regexp_replace("value", "^>", ""))
    header = F.trim(F.regexp_replace(F.substring_index("value", "\n", 1), "\r", ""))
    body = F.when(F.instr("value", "\n") > 0, F.regexp_replace(F.expr("substr(value, instr(value, '\\n') + 1)"), "\\s+", "")).otherwise("")
    return r.select("genome", F.split(header, " ").getItem(0).alias("id"), header.alias("header"), body.alias("sequence"), (F.instr("value", "\n") > 0).alias("has_lines"))


def lengths(spark: SparkSession, paths) -> DataFrame:
    """``genome, id, length`` of records."""
    return records(spark, paths).select("genome", "id", F.length("sequence").cast("long").alias("length"))


def genome_info(spark: SparkSession, paths) -> DataFrame:
    """``genome, total, n50``."""
    return n50(lengths(spark, paths), "genome", "length")


def scaffold_bins(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``scaffold, bin``: of a scaffold in several files, the file listed last."""
    at = spark.createDataFrame([(p.rsplit("/", 1)[-1], k) for k, p in enumerate(paths)], "genome string, place int")
    r = records(spark, paths).select("genome", "id").join(F.broadcast(at) if len(paths) <= 100_000 else at, "genome")
    return last_bins(r.select(F.col("id").alias("scaffold"), F.col("genome").alias("bin"), "place"))


def last_bins(found: DataFrame) -> DataFrame:
    """``scaffold, bin``: of the rows (scaffold, bin, place) of each scaffold the one of the last place."""
    return found.groupBy("scaffold").agg(F.max_by("bin", "place").alias("bin"))


def read_bins(spark: SparkSession, path: str) -> DataFrame:
    """A scaffold-to-bin table without comments and titles."""
    t = spark.read.option("sep", "\t").schema("scaffold string, bin string").csv(path)
    return t.where(~F.col("scaffold").startswith("#") & (F.col("scaffold") != "scaffold_name"))


def write_bins(found: DataFrame, bins: DataFrame, out: str) -> None:
    """Each record below ``out/bin=<name>/``, as FASTA text."""
    rows = found.join(bins, found["id"] == bins["scaffold"])
    rows.select("bin", F.concat(F.lit(">"), "header", F.lit("\n"), "sequence").alias("value")).write.partitionBy("bin").text(out)


def write_bin_files(found: DataFrame, bins: DataFrame, out: str) -> int:
    """Each bin's records in one file ``out/<bin>.fa``, in the order of their ids, through the bins' folders; returns the number of files."""
    spark = found.sparkSession
    rows = found.join(bins, found["id"] == bins["scaffold"]).select("bin", "id", F.concat(F.lit(">"), "header", F.lit("\n"), "sequence").alias("value"))
    tmp = scratch(spark, "bins")
    rows.repartition("bin").sortWithinPartitions("bin", "id").select("bin", "value").write.partitionBy("bin").text(tmp)
    jvm, conf, n = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    path = jvm.org.apache.hadoop.fs.Path
    fs, to = path(tmp).getFileSystem(conf), path(out)
    to.getFileSystem(conf).mkdirs(to)
    for folder in fs.listStatus(path(tmp)):  # one entry a bin, moved by name
        if folder.isDirectory() and folder.getPath().getName().startswith("bin="):
            part = next(f for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-"))
            fs.rename(part.getPath(), path(f"{out}/{folder.getPath().getName()[4:]}.fa"))
            n += 1
    drop(spark, tmp)
    return n


def chunks(found: DataFrame, most: int) -> DataFrame:
    """``genome, id, chunk``: records in order of id, dealt greedily into chunks of at most ``most`` bases; a
    longer record is a chunk by itself. A genome's lengths, not its sequences, come together."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, chunk, held, out = pdf.sort_values("id"), 0, 0, []
        for n in pdf["length"].tolist():
            if held and held + n > most:
                chunk, held = chunk + 1, 0
            held += n
            out.append(chunk)
        return pd.DataFrame({"genome": pdf["genome"], "id": pdf["id"], "chunk": out})

    return found.select("genome", "id", F.length("sequence").cast("long").alias("length")).groupBy("genome").applyInPandas(one, "genome string, id string, chunk long")


def gene_genomes(spark: SparkSession, paths) -> DataFrame:
    """``gene, genome`` of the records of gene files."""
    return records(spark, paths).select(F.col("id").alias("gene"), "genome").distinct()


def without(found: DataFrame, ids: DataFrame, out: str) -> None:
    """All records but those with an ``id`` of ``ids``."""
    kept = found.join(ids.select("id"), "id", "left_anti")
    kept.select(F.concat(F.lit(">"), "header", F.lit("\n"), "sequence").alias("value")).write.text(out)


def list_items(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``genome, location``; names must be distinct. One path that isn't FASTA is a file of paths."""
    if len(paths) == 1:
        first = spark.read.text(paths[0]).first()
        if first and not first[0].startswith(">"):
            t = spark.read.text(paths[0]).where(F.trim("value") != "").select(F.trim("value").alias("location"))
            return t.select(basename(F.col("location")).alias("genome"), "location")
    return spark.createDataFrame([(p.rsplit("/", 1)[-1], p) for p in paths], "genome string, location string")
