"""Collections of items to compare: texts of a table, or genomes of FASTA files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repset.operators import filters, segments, sketch
from repset.sources import fasta

#: of genomes, the hash of one k-mer in so many counts for containment
SCALED = 200


@dataclass(frozen=True)
class Collection:
    """``items`` (item long, name string, length long, n50 long) and their ``parts`` (item, text): one row a document,
    or one a record of a genome. ``unit`` is what is hashed: ``words`` or ``kmers``."""

    items: DataFrame
    parts: DataFrame
    unit: str

    @property
    def k(self) -> int:
        return 21 if self.unit == "kmers" else 5

    def only(self, items: DataFrame) -> Collection:
        """Those of ``items`` (item)."""
        return Collection(self.items.join(items.select("item"), "item", "left_semi"), self.parts.join(items.select("item"), "item", "left_semi"), self.unit)

    def sketches(self, k: int, s: int) -> DataFrame:
        """``item, hs``: the ``s`` smallest hashes. A text's sketch is made in its row; of genomes, each
        stretch of a record sends its own."""
        if self.unit == "words":
            return sketch.cut(sketch.hashes(self.parts, "item", "text", k), "item", s)
        return sketch.merged(sketch.kmers(self.parts, "item", "text", k), "item", s)

    def hashes(self, k: int) -> DataFrame:
        """``item, hs`` for containment: all hashes of a text; of a genome those in the lowest of SCALED parts."""
        if self.unit == "words":
            return sketch.hashes(self.parts, "item", "text", k)
        low = f"{(1 << 60) // SCALED:015x}"
        some = sketch.kmers(self.parts, "item", "text", k).select("item", F.filter("hs", lambda h: h < low).alias("hs"))
        rows = some.select("item", F.explode("hs").alias("h")).distinct()
        return rows.groupBy("item").agg(F.sort_array(F.collect_list("h")).alias("hs"))

    def fingerprint(self) -> str:
        """Changes with any item, name or text, and not with their order."""
        n, x, y = self.parts.agg(F.count(F.lit(1)), F.sum(F.xxhash64("item", "text").cast("decimal(38,0)")), F.sum(F.xxhash64("text", "item").cast("decimal(38,0)"))).first()
        m, z = self.items.agg(F.count(F.lit(1)), F.sum(F.xxhash64("item", "name").cast("decimal(38,0)"))).first()
        return f"{self.unit}:{n}:{x}:{y}:{m}:{z}"


def of_texts(table: DataFrame, item: str = "item", text: str = "text") -> Collection:
    """Items of a table; their segments are lines. Ids must be distinct; null and empty texts have no segments and are left out."""
    t = filters.require_unique(table.select(F.col(item).cast("long").alias("item"), F.col(text).alias("text")), "item")
    info = segments.n50(segments.lines(t, "item", "text"), "item", "len")
    return Collection(info.select("item", F.col("item").cast("string").alias("name"), F.col("total").alias("length"), "n50"), t, "words")


def of_fasta(spark: SparkSession, paths: list[str]) -> Collection:
    """Genomes of FASTA files, or of one file that lists their paths; an item is the hash of a genome's name."""
    listed = fasta.list_items(spark, paths)
    filters.require_unique(listed, "genome")
    places = [r["location"] for r in listed.select("location").collect()]  # paths: one short row a file
    item = F.xxhash64("genome").bitwiseAND(F.lit((1 << 63) - 1)).alias("item")
    r = fasta.records(spark, places)
    info = segments.n50(r.select("genome", F.length("sequence").cast("long").alias("len")), "genome", "len")
    items = filters.require_unique(info.select(item, F.col("genome").alias("name"), F.col("total").alias("length"), "n50"), "item")
    return Collection(items, r.select(item, F.col("sequence").alias("text")), "kmers")


def is_fasta(spark: SparkSession, path: str) -> bool:
    """Whether a path is a FASTA file or a list of paths, and no table."""
    if path.rstrip("/").endswith(".parquet") or "." not in path.rsplit("/", 1)[-1]:
        return False
    first = spark.read.text(path).first()
    return bool(first) and (first[0].startswith(">") or "/" in first[0])
