"""Command line: ``python -m repset compare|dereplicate WORKSPACE -g TABLE_OR_FASTA... [settings]`` and
``python -m repset check_dependencies``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from repset.collection import is_fasta, of_fasta, of_texts
from repset.operators import linkage
from repset.operators.score import Weights
from repset.sources import programs, tables
from repset.sources.workspace import Workspace
from repset.workflow import ALGORITHMS, Params, compare, dereplicate, load


def parser() -> argparse.ArgumentParser:
    top, d = argparse.ArgumentParser(prog="repset"), Params()
    top.add_argument("command", choices=["compare", "dereplicate", "check_dependencies"])
    top.add_argument("workspace", nargs="?")
    top.add_argument("-g", "--items", nargs="+", help="a Parquet table of items, FASTA files, or a file of their paths")
    top.add_argument("--item", default="doc_id")
    top.add_argument("--text", default="text")
    top.add_argument("--quality", "--genomeInfo", help="Parquet table (item, completeness, contamination) or CSV by genome")
    top.add_argument("-extraW", "--extra", help="table of items and extra weights, tab-separated")
    top.add_argument("-k", dest="k", type=int, help="words or bases in a hash")
    top.add_argument("--S_algorithm", dest="algorithm", choices=["native", *ALGORITHMS], default=d.algorithm)
    top.add_argument("--outputs", nargs="+", help="outputs of the comparison program")
    top.add_argument("-cm", "--coverage_method", choices=["larger", "total"], default=d.coverage_method)
    top.add_argument("--clusterAlg", dest="method", choices=linkage.METHODS, default=d.method)
    for short, name, value in (("-l", "length", d.length), ("-comp", "completeness", d.completeness), ("-con", "contamination", d.contamination), ("-ms", "sketch", d.sketch), ("--primary_chunksize", "chunk", d.chunk), ("-pa", "primary", d.primary), ("-sa", "secondary", d.secondary), ("-nc", "coverage", d.coverage), ("--warn_dist", "warn_dist", d.warn_dist), ("--warn_sim", "warn_sim", d.warn_sim), ("--warn_aln", "warn_aln", d.warn_aln)):
        top.add_argument(short, dest=name, type=type(value), default=value)
    for flag, name in (("--ignoreQuality", "ignore_quality"), ("--low_ram_primary_clustering", "low_ram"), ("--multiround_primary_clustering", "multiround"), ("--greedy_secondary_clustering", "greedy"), ("--run_tertiary_clustering", "tertiary"), ("--SkipPrimary", "skip_primary"), ("--SkipSecondary", "skip_secondary"), ("--gen_warnings", "warn")):
        top.add_argument(flag, dest=name, action="store_true")
    for flag, name in (("-comW", "completeness"), ("-conW", "contamination"), ("-strW", "strain"), ("-N50W", "n50"), ("-sizeW", "size"), ("-centW", "centrality")):
        top.add_argument(flag, dest=f"weight_{name}", type=float, default=getattr(d.weights, name))
    return top


def main(argv: list[str] | None = None) -> None:
    a = vars(parser().parse_args(argv))
    weights = Weights(**{k[7:]: v for k, v in a.items() if k.startswith("weight_")})
    spark = SparkSession.builder.getOrCreate()
    if a["command"] == "check_dependencies":
        for r in programs.report(spark).collect():
            print(f"{r['program']}: {'works' if r['works'] else 'not found' if r['location'] is None else 'fails'} {r['location'] or ''}")
        return
    if not a["workspace"] or not a["items"]:
        raise SystemExit("a workspace and items (-g) are needed")
    if a["command"] == "compare" and a["tertiary"]:
        raise ValueError("tertiary clustering needs winners, so it comes with dereplicate only")
    p = Params(weights=weights, **{k: v for k, v in a.items() if k in Params.__dataclass_fields__})
    genomes = is_fasta(spark, a["items"][0])
    c = of_fasta(spark, a["items"]) if genomes else of_texts(load(spark, a["items"][0], a["item"], a["text"]))
    work = Workspace(spark, a["workspace"])
    if a["command"] == "compare":
        compare(work, c, p, a["outputs"])
        return
    ids, quality, extra = c.items.select("item", F.col("name").alias("genome")), None, None
    if a["quality"] and genomes:
        quality = tables.quality_table(spark, a["quality"]).join(ids, "genome")
    elif a["quality"]:
        quality = spark.read.parquet(a["quality"]).withColumn("item", F.col("item").cast("long"))
    if a["extra"]:
        extra = tables.extra_weights(spark, a["extra"], ids, "genome").join(ids, "genome")
    dereplicate(work, c, quality, p, extra, a["outputs"])
    work.export("winners")


if __name__ == "__main__":
    main()
