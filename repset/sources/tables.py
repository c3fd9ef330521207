"""Readers for the tables that alignment, quality and taxonomy tools write. All are plain scans: text
or CSV sources with column expressions, so projections and filters reach them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repset.operators.segments import basename


def _fields(spark: SparkSession, paths, sep: str = "\\s+") -> DataFrame:
    lines = spark.read.text(paths).select(F.col("_metadata.file_name").alias("file"), F.trim("value").alias("line")).where("line <> ''")
    return lines.withColumn("f", F.split("line", sep))


def _number(i: int) -> Column:
    return F.element_at("f", i).cast("double")


def sketch_table(spark: SparkSession, paths) -> DataFrame:
    """``genome1, genome2, dist, similarity`` from headerless tab-separated distance tables."""
    f = _fields(spark, paths, "\t")
    return f.select(basename(F.element_at("f", 1)).alias("genome1"), basename(F.element_at("f", 2)).alias("genome2"), _number(3).alias("dist"), (1 - _number(3)).alias("similarity"))


def delta_alignments(spark: SparkSession, paths) -> DataFrame:
    """``file, r_scaff, q_scaff, r_len, q_len, r_start, r_end, q_start, q_end, errors``: one row an alignment.

    Records are split at ``>``, so each carries its header and no order between rows is needed."""
    rec = spark.read.option("lineSep", "\n>").text(paths).select(F.col("_metadata.file_name").alias("file"), F.split("value", "\n").alias("l"))
    head = F.split(F.element_at("l", 1), " ")
    rows = rec.where(F.size(head) == 4).select("file", head.alias("h"), F.explode(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0)))).alias("a"))
    rows = rows.withColumn("a", F.split(F.trim("a"), " ")).where(F.size("a") == 7)
    longs = {n: ("h", i) for i, n in ((3, "r_len"), (4, "q_len"))} | {n: ("a", i + 1) for i, n in enumerate(("r_start", "r_end", "q_start", "q_end", "errors"))}
    return rows.select("file", F.element_at("h", 1).alias("r_scaff"), F.element_at("h", 2).alias("q_scaff"), *(F.element_at(c, i).cast("long").alias(n) for n, (c, i) in longs.items()))


def delta_totals(spark: SparkSession, paths) -> DataFrame:
    """``file, alignment_length, similarity_errors, ani``: the lengths on the first sequence and the
    errors, summed over a file; ani 0 without alignments isn't made, as such files have no row."""
    t = delta_alignments(spark, paths).groupBy("file").agg(F.sum(F.abs(F.col("r_end") - F.col("r_start"))).alias("alignment_length"), F.sum("errors").alias("similarity_errors"))
    return t.withColumn("ani", F.when(F.col("alignment_length") > 0, (F.col("alignment_length") - F.col("similarity_errors")) / F.col("alignment_length")).otherwise(0.0))


def delta_pairs(spark: SparkSession, paths, lengths: DataFrame, method: str = "larger") -> DataFrame:
    """``pairs.aligned`` of delta files named ``<query>_vs_<reference>.delta[.filtered]``; files without
    alignments have similarity 0."""
    from repset.operators import pairs

    files = spark.read.format("binaryFile").load(paths).select(basename(F.col("path")).alias("file")).distinct()
    t = files.join(delta_totals(spark, paths).drop("ani"), "file", "left").fillna(0, ["alignment_length", "similarity_errors"])
    name = F.split(F.regexp_replace("file", "\\.delta(\\.filtered)?$", ""), "_vs_")
    t = t.select(name.getItem(0).alias("query"), name.getItem(1).alias("reference"), "alignment_length", "similarity_errors")
    return pairs.aligned(t, lengths, method)


def fragment_ani(spark: SparkSession, paths) -> DataFrame:
    """``query, reference, ani, coverage`` from rows (path, path, percent, matched, all fragments)."""
    f = _fields(spark, paths)
    return f.select(basename(F.element_at("f", 1)).alias("query"), basename(F.element_at("f", 2)).alias("reference"), (_number(3) / 100).alias("ani"), (_number(4) / _number(5)).alias("coverage"))


def triangle(spark: SparkSession, path: str) -> DataFrame:
    """``query, reference, value`` in both directions from a lower triangle, with the diagonal if it has one: a line
    with the count, then lines of a path and its values against all earlier paths. Each file is read
    whole, as a row's place in it names its partners; the file is quadratic in its items already."""
    whole = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "").alias("l"))
    body = whole.select(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))).alias("l"))
    body = body.select(F.transform("l", lambda x: basename(F.split(x, "\t").getItem(0))).alias("names"), F.posexplode("l").alias("i", "line"))
    cell = body.select("names", "i", F.posexplode(F.split("line", "\t")).alias("j", "v")).where("j > 0 AND j <= i + 1")
    low = cell.select(F.col("names")[F.col("i")].alias("query"), F.col("names")[F.col("j") - 1].alias("reference"), F.col("v").cast("double").alias("value"))
    return low.union(low.where("query <> reference").select("reference", "query", "value"))


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """``query, reference, value`` of every cell of a full matrix: as ``triangle``, with all columns."""
    whole = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "").alias("l"))
    body = whole.select(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))).alias("l"))
    body = body.select(F.transform("l", lambda x: basename(F.split(x, "\t").getItem(0))).alias("names"), F.posexplode("l").alias("i", "line"))
    cell = body.select("names", "i", F.posexplode(F.split("line", "\t")).alias("j", "v")).where("j > 0")
    return cell.select(F.col("names")[F.col("i")].alias("query"), F.col("names")[F.col("j") - 1].alias("reference"), F.col("v").cast("double").alias("value"))


def triangle_pairs(spark: SparkSession, ani: str, fraction: str) -> DataFrame:
    """``query, reference, ani, coverage``: a triangle of percentages with its matrix of aligned percentages."""
    a, f = triangle(spark, ani), matrix(spark, fraction)
    return a.join(f.withColumnRenamed("value", "af"), ["query", "reference"]).select("query", "reference", (F.col("value") / 100).alias("ani"), (F.col("af") / 100).alias("coverage"))


def gene_ani(spark: SparkSession, paths) -> DataFrame:
    """``query, reference, ani, coverage`` in both directions from tables with the columns GENOME1,
    GENOME2, AF(1->2), AF(2->1), ANI(1->2), ANI(2->1); coverage is the larger fraction. Names lose
    their 4-character suffix."""
    t = spark.read.option("header", True).option("sep", "\t").csv(paths)
    one, two = (F.expr(f"substr({c}, 1, length({c}) - 4)") for c in ("GENOME1", "GENOME2"))
    af = F.greatest(F.col("`AF(1->2)`").cast("double"), F.col("`AF(2->1)`").cast("double"))
    go = t.select(two.alias("query"), one.alias("reference"), (F.col("`ANI(1->2)`").cast("double") / 100).alias("ani"), af.alias("coverage"))
    return go.union(t.select(one, two, F.col("`ANI(2->1)`").cast("double") / 100, af))


def gene_hit_table(spark: SparkSession, paths, file: bool = False) -> DataFrame:
    """``query_gene, reference_gene, al_len, qry_len, sbj_len, percent`` of gene hit files of one header
    dialect, with ``file`` also the file's name: ``qry_id`` may be ``#qry_id`` or ``#Q_id``, ``sbj_id`` ``S_id``, and ``sbj_len`` ``trg_len``."""
    t = spark.read.option("header", True).option("sep", "\t").csv(paths)

    def either(*names: str) -> Column:
        found = [n for n in names if n in t.columns]
        if not found:
            raise KeyError(names[0])
        return F.col(f"`{found[0]}`")

    if file:
        t = t.withColumn("file", F.col("_metadata.file_name"))
    numbers = {"al_len": ("al_len",), "qry_len": ("qry_len",), "sbj_len": ("sbj_len", "trg_len")}
    return t.select(either("qry_id", "#qry_id", "#Q_id").alias("query_gene"), either("sbj_id", "S_id").alias("reference_gene"), *(either(*n).cast("long").alias(c) for c, n in numbers.items()), either("p_inden").cast("double").alias("percent"), *([F.col("file")] if file else []))


def gene_hits(hits: DataFrame, least_fraction: float = 0.7, least_percent: float = 70) -> DataFrame:
    """``query, reference, ani, af`` from gene hits (query, reference, al_len, qry_len, sbj_len, percent):
    hits that cover enough of the shorter gene at enough identity, averaged by aligned length."""
    kept = hits.where((F.col("al_len") / F.least("qry_len", "sbj_len") >= least_fraction) & (F.col("percent") >= least_percent))
    return kept.groupBy("query", "reference").agg((F.sum(F.col("percent") * F.col("al_len")) / F.sum("al_len")).alias("ani"), (F.sum("al_len") / F.sum("qry_len")).alias("af"))


def gene_hit_pairs(spark: SparkSession, paths) -> DataFrame:
    """``query, reference, ani, af`` by ``gene_hits`` of files named ``<query>_vs_<reference>.<anything>``; files
    without enough hits give zeros."""
    files = spark.read.format("binaryFile").load(paths).select(basename(F.col("path")).alias("file")).distinct()
    name = F.split(F.regexp_replace("file", "\\.[^.]*$", ""), "_vs_")
    hits = gene_hit_table(spark, paths, file=True)
    found = gene_hits(hits.select(name.getItem(0).alias("query"), name.getItem(1).alias("reference"), "al_len", "qry_len", "sbj_len", "percent"))
    every = files.select(name.getItem(0).alias("query"), name.getItem(1).alias("reference"))
    return every.join(found, ["query", "reference"], "left").fillna(0.0, ["ani", "af"]).select("query", "reference", (F.col("ani") / 100).alias("ani"), "af")


def snps(spark: SparkSession, paths) -> DataFrame:
    """``file, rl, r_base, q_base, ql, r_scaff, q_scaff``: 12 fields a row; title lines have fewer."""
    f = _fields(spark, paths, "\t").where((F.size("f") == 12) & F.element_at("f", 1).rlike("^[0-9]+$"))
    return f.select("file", F.element_at("f", 1).cast("long").alias("rl"), F.element_at("f", 2).alias("r_base"), F.element_at("f", 3).alias("q_base"), F.element_at("f", 4).cast("long").alias("ql"), F.element_at("f", 11).alias("r_scaff"), F.element_at("f", 12).alias("q_scaff"))


def taxon_report(spark: SparkSession, paths) -> DataFrame:
    """``name, tax_id, rank, reads`` of classification reports."""
    t = spark.read.option("header", True).option("sep", "\t").csv(paths)
    return t.select("name", F.col("taxID").cast("long").alias("tax_id"), F.col("taxRank").alias("rank"), F.col("numReads").cast("long").alias("reads"))


def taxon_hits(spark: SparkSession, paths, report: DataFrame) -> DataFrame:
    """``gene, scaffold, tax_id, score, name, rank``: hits with the report's names; a scaffold is the gene without its last part."""
    t = spark.read.option("header", True).option("sep", "\t").csv(paths)
    t = t.select(F.col("readID").alias("gene"), F.regexp_replace("readID", "_[^_]*$", "").alias("scaffold"), F.col("taxID").cast("long").alias("tax_id"), F.col("score").cast("double").alias("score"))
    return t.join(report.select("tax_id", "name", "rank").dropDuplicates(["tax_id"]), "tax_id", "left").select("gene", "scaffold", "tax_id", "score", "name", "rank")


def quality_table(spark: SparkSession, path: str) -> DataFrame:
    """A quality table, comma- or tab-separated by its header; items become base names."""
    head = spark.read.text(path).first()
    sep = "\t" if head and "\t" in head[0] and "," not in head[0] else ","
    t = spark.read.option("header", True).option("sep", sep).csv(path)
    for c in ("genome", "completeness", "contamination"):
        if c not in t.columns:
            raise KeyError(c)
    return t.withColumns({"genome": basename(F.col("genome"))} | {c: F.col(c).cast("double") for c in ("completeness", "contamination", "strain_heterogeneity") if c in t.columns})


def extra_weights(spark: SparkSession, path: str, items: DataFrame, item: str) -> DataFrame:
    """``item, extra`` of known items from a headerless tab-separated table."""
    t = spark.read.option("sep", "\t").schema(f"`{item}` string, extra double").csv(path)
    return t.where("extra IS NOT NULL").join(items.select(item).distinct(), item, "left_semi")
