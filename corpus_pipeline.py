"""From documents to token files: the stages, and ``run`` that applies them one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repset.llm import decontaminate, jaccard, mixing, quality, tokenfile
from repset.session import drop, materialize

#: near copies in the pipeline: five words, similarity of 0.8 or more
NEAR = jaccard.Rule(words=5, percent=80)
#: rows of decisions up to which they are broadcast to the scan of documents; beyond, joined by shuffle
BROADCAST_ROWS = 500_000


def _decided(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Join ``docs`` with a table of decisions (doc_id, text_hash, ...) on both, null-safe."""
    rows = rows.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    rows, _ = materialize(rows, "decisions")
    if rows.count() <= BROADCAST_ROWS:
        rows = F.broadcast(rows)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & F.xxhash64("text").eqNullSafe(F.col("__hash"))
    return docs.join(rows, same, how)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject as low or toxic."""
    out = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _decided(docs, out.where("NOT keep").select("doc_id", "text_hash").distinct(), "left_anti").select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (NEAR) the document with the smallest id, and of several texts with that
    id the one with the smallest hash. Documents without words or id stay; of repeated rows (same id
    and text) one stays."""
    out, _ = materialize(jaccard.grouped(docs, NEAR), "groups")
    first = out.where("component_id = doc_id AND n_shingles > 0")
    mixed = first.groupBy("group").agg(F.min("text_hash").alias("low"), F.max("text_hash").alias("high")).where("low < high")
    gone = out.where("component_id <> doc_id").select("doc_id", "text_hash").union(first.join(mixed, "group").where("text_hash <> low").select("doc_id", "text_hash"))
    kept = _decided(docs, gone.distinct(), "left_anti").select(*docs.columns)
    twice = first.groupBy("doc_id", "text_hash").count().where("count > 1").drop("count")
    if twice.isEmpty():
        return kept
    marked = _decided(kept, twice, "left")
    one = marked.where("__id IS NOT NULL").dropDuplicates(["__id", "__hash"])
    return marked.where("__id IS NULL").unionByName(one).select(*docs.columns)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    out = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _decided(docs, out.where("contaminated").select("doc_id", "text_hash").distinct(), "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Texts stay whole: the last document that a source
    takes, in part, comes once more if at least half of its words are within the budget."""
    plan = mixing.mix_sources(docs).withColumn("size1", F.greatest("size", F.lit(1)))
    copies = F.expr("taken div size1 + if(2 * (taken % size1) >= size1, 1, 0)")
    plan = plan.groupBy("doc_id", "text_hash").agg(F.sum(copies).alias("__copies"), F.count(F.lit(1)).alias("__rows"))
    marked = _decided(docs, plan.where("__copies > 0"), "inner")
    if not plan.where("__rows > 1").isEmpty():
        marked = marked.where("__rows = 1").unionByName(marked.where("__rows > 1").dropDuplicates(["__id", "__hash"]))
    return marked.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending doc_id order, read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    return tokenfile.token_files(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", keep_uncontaminated),
    ("mixing sources", mix),
    ("token ids", write_tokens),
]

#: the classifier and the tokenizer aren't expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each result is written to the shared folder and read again, and goes
    when the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES:
        docs, at = materialize(stage(spark, docs, sf_dir), "stage")
        drop(spark, *before)
        before = [at]
    return docs
