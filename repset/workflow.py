"""The two whole flows: compare items, and choose the best of each group."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repset.collection import Collection, of_texts
from repset.operators import adjust, filters, greedy, linkage, pairs, score, sketch, warn
from repset.operators.components import connected_components
from repset.session import materialize
from repset.sources import tables
from repset.sources.workspace import Workspace


@dataclass(frozen=True)
class Params:
    """Settings and their defaults. ``k`` (None: 5 words, 21 bases), ``sketch``, ``primary`` and ``method`` are those
    of the first comparison; ``algorithm``, ``secondary``, ``coverage`` and ``method`` those of the second."""

    length: int = 50_000
    completeness: float = 75
    contamination: float = 25
    ignore_quality: bool = False
    k: int | None = None
    sketch: int = 1000
    primary: float = 0.9
    secondary: float = 0.95
    coverage: float = 0.1
    coverage_method: str = "larger"
    algorithm: str = "native"
    method: str = "average"
    low_ram: bool = False
    multiround: bool = False
    chunk: int = 5000
    greedy: bool = False
    tertiary: bool = False
    skip_primary: bool = False
    skip_secondary: bool = False
    weights: score.Weights = field(default_factory=score.Weights)
    warn: bool = False
    warn_dist: float = 0.25
    warn_sim: float = 0.98
    warn_aln: float = 0.25

    def __post_init__(self):
        if self.method not in linkage.METHODS:
            raise ValueError(self.method)
        if self.algorithm != "native" and self.algorithm not in ALGORITHMS:
            raise ValueError(self.algorithm)
        if self.skip_primary and self.skip_secondary:
            raise ValueError("one of the comparisons must run")
        if self.coverage_method not in ("larger", "total"):
            raise ValueError(self.coverage_method)


def _fragments(spark, paths, c, p):
    return tables.fragment_ani(spark, paths)


def _deltas(spark, paths, c, p):
    return tables.delta_pairs(spark, paths, c.items.select(F.col("name").alias("item"), "length"), p.coverage_method)


def _triangles(spark, paths, c, p):
    return tables.triangle_pairs(spark, *paths)


def _genes(spark, paths, c, p):
    return pairs.with_self(tables.gene_ani(spark, paths), c.items.select(F.col("name").alias("item")))


def _gene_hits(spark, paths, c, p):
    h = tables.gene_hit_pairs(spark, paths)
    return pairs.with_self(h.select("query", "reference", "ani", F.col("af").alias("coverage")), c.items.select(F.col("name").alias("item")))


#: what reads the outputs of each comparison program as ``query, reference, ani, coverage`` by names
ALGORITHMS: dict[str, Callable] = {"fastANI": _fragments, "skani": _triangles, "ANIn": _deltas, "ANImf": _deltas, "gANI": _genes, "goANI": _gene_hits}


def _kept(work: Workspace, name: str, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of an earlier run on the same items with the same settings, or a new one."""
    mark = hashlib.sha256(json.dumps(key, sort_keys=True, default=str).encode()).hexdigest()
    if work.has(name) and work.mark(name) == mark:
        return work.get(name)
    return work.store(name, make(), mark=mark)


def _grouped(c: Collection, sketches: DataFrame, p: Params, k: int, among: DataFrame | None = None) -> DataFrame:
    """``item, block`` of the first comparison by the linkage that is asked for. With ``among`` (item, chunk) only
    items of one chunk are compared.

    Single, complete, average and weighted linkage stay inside the connected components at the cutoff, so only
    these get all their pairs; the other linkages take all items as one block, which linkage bounds."""
    cutoff, items = 1 - p.primary, c.items.select("item")
    whole = p.method not in linkage.SPLITS and not p.low_ram
    if whole:
        blocks = items.withColumn("block", F.lit(0).cast("long")) if among is None else among.withColumnRenamed("chunk", "block")
    else:
        near = sketch.near_pairs(sketches, "item", p.sketch, k, cutoff)
        if among is not None:
            side = lambda n: among.toDF(f"item{n}", f"chunk{n}")
            near = near.join(side(1), "item1").join(side(2), "item2").where("chunk1 = chunk2")
        found = connected_components(near, "item1", "item2")
        blocks = items.join(found, F.col("item") == F.col("node"), "left").select("item", F.coalesce("component", "item").alias("block"))
        if p.low_ram or p.method == "single":
            return blocks
    blocks, _ = materialize(blocks, "components")
    many = blocks.join(blocks.groupBy("block").count().where("count > 1").select("block"), "block").select("item", "block")
    d = sketch.compared_within(sketches, "item", many, p.sketch, k).join(many.withColumnRenamed("item", "item1"), "item1")
    both = d.select("block", F.col("item1").alias("query"), F.col("item2").alias("reference"), "dist").union(d.select("block", "item2", "item1", "dist"))
    full = both.union(many.select("block", "item", "item", F.lit(0.0)))
    got = linkage.cluster_blocks(full, p.method, cutoff)
    low = got.groupBy("block", "cluster").agg(F.min("item").alias("low"))
    got = got.join(low, ["block", "cluster"]).select("item", F.col("low").alias("found"))
    return blocks.join(got, "item", "left").select("item", F.coalesce("found", "item").alias("block"))


def _primary(c: Collection, sketches: DataFrame, p: Params, k: int) -> DataFrame:
    if not p.multiround:
        return _grouped(c, sketches, p, k)
    chunk = filters.in_groups(c.items.select("item"), "item", p.chunk).select("item", F.col("group").cast("long").alias("chunk"))
    one, _ = materialize(_grouped(c, sketches, p, k, chunk), "round")
    # the longest of each group of a chunk stands for it in the second round
    reps = one.join(c.items.select("item", "length"), "item").groupBy("block").agg(F.max_by("item", F.struct("length", -F.col("item"))).alias("rep"))
    reps, _ = materialize(reps, "reps")
    some = reps.select(F.col("rep").alias("item"))
    two = _grouped(c.only(some), sketches.join(some, "item", "left_semi"), replace(p, multiround=False), k)
    groups = reps.join(two.toDF("rep", "found"), "rep").select("block", "found")
    low = one.join(groups, "block").groupBy("found").agg(F.min("item").alias("low"))
    return one.join(groups, "block").join(low, "found").select("item", F.col("low").alias("block"))


def _compared(work: Workspace, c: Collection, groups: DataFrame, p: Params, k: int, paths: list[str] | None) -> DataFrame:
    """``block, query, reference, ani, coverage`` inside blocks."""
    if p.algorithm == "native":
        return sketch.containment(c.only(groups).hashes(k), "item", groups, k).select("block", "query", "reference", "ani", "coverage")
    if not paths:
        raise ValueError(f"{p.algorithm} needs the paths of its outputs")
    found = ALGORITHMS[p.algorithm](work.spark, paths, c, p).select("query", "reference", "ani", "coverage")
    ids = c.items.select("item", "name")
    for side in ("query", "reference"):
        found = found.join(ids.withColumnRenamed("item", f"__{side}").withColumnRenamed("name", side), side).drop(side).withColumnRenamed(f"__{side}", side)
    found = pairs.restrict(found, groups)
    return pairs.densify(found, groups)


def compare(work: Workspace, items: DataFrame | Collection, p: Params | None = None, outputs: list[str] | None = None) -> DataFrame:
    """Cluster ``items`` (item long, text; or a collection): tables ``items``, ``sketch_pairs``, ``pairs`` and ``clusters`` (item,
    primary_cluster, secondary_cluster, threshold, comparison_algorithm, cluster_method).

    A primary cluster is named by its smallest item. Items without hashes and items alone get the
    secondary cluster ``<primary>_0`` (``_1`` if greedy); others are numbered from 1 within their primary
    cluster. ``outputs``: paths of what the comparison program wrote, unless it is ``native``. Tables
    of an earlier run are used again only if items and settings are the same."""
    p = p or Params()
    c = items if isinstance(items, Collection) else of_texts(items)
    k, key = p.k or c.k, (c.fingerprint(), p.k or c.k, p.sketch)
    work.store("items", c.items)
    sketches = _kept(work, "sketches", key, lambda: c.sketches(k, p.sketch))
    if p.skip_primary:
        first = c.items.select("item", F.lit(0).cast("long").alias("block"))
    else:
        _kept(work, "sketch_pairs", (*key, p.primary), lambda: sketch.near_pairs(sketches, "item", p.sketch, k, 1 - p.primary))
        first = _primary(c, sketches, p, k)
    first, _ = materialize(first, "primary")
    name = F.concat(F.col("block").cast("string"), F.lit("_"), F.coalesce("cluster", F.lit(0)).cast("string"))
    if p.skip_secondary:
        second = first.select("item", F.lit(0).alias("cluster"))
    else:
        groups = first.join(first.groupBy("block").count().where("count > 1").select("block"), "block").select("item", "block")
        keyed = (*key, p.primary, p.method, p.low_ram, p.multiround, p.chunk, p.skip_primary, p.algorithm, p.coverage_method, outputs)
        both = _kept(work, "pairs", keyed, lambda: _compared(work, c, groups, p, k, outputs))
        if p.greedy:
            near = both.where((F.col("ani") >= p.secondary) & (F.col("coverage") >= p.coverage) & (F.col("query") != F.col("reference")))
            got = greedy.greedy(first.join(c.items.select("item", "length"), "item"), near)
            out = greedy.names(got).withColumns({"threshold": F.lit(1 - p.secondary), "comparison_algorithm": F.lit(p.algorithm)})
            work.store_arguments(asdict(p))
            return work.store("clusters", out.select("item", "primary_cluster", "secondary_cluster", "threshold", "comparison_algorithm", "cluster_method", "greedy_representative"))
        second = linkage.cluster_blocks(_means(both, groups, p), p.method, 1 - p.secondary).select("item", "cluster")
    out = first.join(second, "item", "left").select("item", F.col("block").alias("primary_cluster"), name.alias("secondary_cluster"), F.lit(1 - p.secondary).alias("threshold"), F.lit(p.algorithm).alias("comparison_algorithm"), F.lit(p.method).alias("cluster_method"))
    work.store_arguments(asdict(p))
    return work.store("clusters", out)


def _means(both: DataFrame, groups: DataFrame, p: Params) -> DataFrame:
    means = pairs.reciprocal(pairs.coverage_gate(both, p.coverage)).join(groups.withColumnRenamed("item", "query"), "query")
    return means.select("block", "query", "reference", "dist")


def _scored(work: Workspace, c: Collection, clusters: DataFrame, quality: DataFrame | None, p: Params, extra: DataFrame | None) -> DataFrame:
    """``scores``: the clusters' items with their sizes, quality, centrality and score."""
    table = clusters.select("item", "secondary_cluster").join(c.items.select("item", "length", "n50"), "item")
    weights = replace(p.weights, centrality=0.0) if p.skip_secondary else p.weights
    if weights.centrality:
        named = clusters.select("item", F.col("secondary_cluster").alias("cluster"))
        # greedy clusterings and merged ones lack pairs of members, so similarities of sketches stand in for them
        central = score.scratch_centrality(work.get("sketches"), "item", named, p.sketch, p.k or c.k) if p.greedy or p.tertiary else score.centrality(work.get("pairs"), named)
        table = table.join(central.select("item", "centrality"), "item")
    if extra is not None:
        table = table.join(extra.select("item", "extra"), "item", "left")
    if not p.ignore_quality and quality is not None:
        cols = [x for x in ("completeness", "contamination", "strain_heterogeneity") if x in quality.columns]
        table = table.join(quality.select("item", *cols), "item")
    return work.store("scores", score.scored(table, weights, p.secondary, p.ignore_quality))


def dereplicate(work: Workspace, items: DataFrame | Collection, quality: DataFrame | None = None, p: Params | None = None, extra: DataFrame | None = None, outputs: list[str] | None = None) -> DataFrame:
    """Filter items by length and ``quality`` (item, completeness, contamination), cluster them, and
    return ``winners`` (secondary_cluster, item, score): the best of each cluster. Also stores
    ``info``, ``scores``, ``report`` and, if asked for, warnings. With ``tertiary`` the winners are compared once
    more, clusters whose winners fall together are merged, and all is scored again."""
    p = p or Params()
    if quality is None and not p.ignore_quality:
        raise ValueError("a quality table is needed unless ignore_quality is set")
    c = items if isinstance(items, Collection) else of_texts(items)
    info = work.store("info", filters.by_length(c.items, "length", p.length))
    c = c.only(info)
    if not p.ignore_quality:
        c = c.only(filters.by_quality(c.items, filters.require_quality(c.items, quality, "item"), "item", p.completeness, p.contamination))
    clusters = compare(work, c, p, outputs)
    scores = _scored(work, c, clusters, quality, replace(p, tertiary=False), extra)
    best, _ = materialize(score.winners(scores, ["secondary_cluster"], "item"), "winners")
    if p.tertiary:
        clusters = _merged(work, c, clusters, best, p, outputs)
        scores = _scored(work, c, clusters, quality, p, extra)
        best = score.winners(scores, ["secondary_cluster"], "item")
    best = work.store("winners", best)
    if not p.skip_secondary:
        named = clusters.select("item", F.col("secondary_cluster").alias("cluster"))
        work.store("report", score.report(best.withColumnRenamed("secondary_cluster", "cluster"), named, work.get("pairs"), quality))
    if p.warn and not p.skip_secondary:
        _warn(work, clusters, best, p)
    return best


def _merged(work: Workspace, c: Collection, clusters: DataFrame, best: DataFrame, p: Params, outputs: list[str] | None) -> DataFrame:
    """Clusters after their winners were compared at a primary similarity lower by 0.05, without rounds and not greedily."""
    again = replace(p, primary=p.primary - 0.05, greedy=False, multiround=False, tertiary=False)
    inner = Workspace(work.spark, f"{work.uri}/tertiary")
    new = compare(inner, c.only(best), again, outputs).select("item", F.col("secondary_cluster").alias("new"))
    groups = best.join(new, "item").select(F.col("secondary_cluster").alias("old"), F.xxhash64("new").alias("group"))
    names, _ = materialize(adjust.merged_names(groups), "names")
    out = clusters.join(names.withColumnRenamed("new", "__new"), F.col("secondary_cluster") == F.col("old")).withColumn("secondary_cluster", F.col("__new")).select(*clusters.columns)
    out, _ = materialize(out, "merged")
    return work.store("clusters", out)


def adjust_cluster(work: Workspace, block: int, method: str, threshold: float, coverage: float | None = None) -> DataFrame:
    """Cluster one primary cluster anew from the stored pairs, replace it, and choose winners from the stored
    scores; returns ``winners``."""
    was = work.arguments()
    both = work.get("pairs").where(F.col("block") == block)
    clusters, _ = materialize(work.get("clusters"), "clusters")
    groups = clusters.where(F.col("primary_cluster") == block).select("item", F.col("primary_cluster").alias("block"))
    p = Params(method=method, secondary=threshold, coverage=was["coverage"] if coverage is None else coverage)
    again = linkage.cluster_blocks(_means(both, groups, p), method, 1 - threshold)
    changed = work.store("clusters", adjust.replace_block(clusters, block, again))
    scores, _ = materialize(work.get("scores").drop("secondary_cluster"), "scores")
    scores = work.store("scores", scores.join(changed.select("item", "secondary_cluster"), "item"))
    return work.store("winners", score.winners(scores, ["secondary_cluster"], "item"))


def compare_winners(work: Workspace, c: Collection, p: Params | None = None) -> DataFrame:
    """``item1, item2, dist`` of sketches between the winners of a workspace, all that share a hash."""
    p = p or Params()
    return sketch.sketch_pairs(c.only(work.get("winners")).sketches(p.k or c.k, p.sketch), "item", p.sketch, p.k or c.k).select("item1", "item2", "dist")


def _warn(work: Workspace, clusters: DataFrame, best: DataFrame, p: Params) -> None:
    block = clusters.select(F.col("item").alias("query"), F.col("primary_cluster").alias("block"))
    both = work.get("pairs")
    means = pairs.reciprocal(pairs.coverage_gate(both, p.coverage)).join(block, "query").select("block", "query", "reference", "dist")
    found = warn.high_self(both, 1 - p.secondary).select("message")
    if not p.greedy:
        found = found.union(warn.edges(warn.links(means, p.method), 1 - p.secondary, p.warn_dist).select("message"))
    like = warn.alike(both, best, p.warn_sim, p.warn_aln)
    work.store_warnings(found.union(like.select(F.format_string("winners %s and %s are alike (%.4f)", F.col("item1").cast("string"), F.col("item2").cast("string"), F.col("ani")))))


def load(spark: SparkSession, path: str, item: str, text: str) -> DataFrame:
    """Items of a Parquet table."""
    return spark.read.parquet(path).select(F.col(item).cast("long").alias("item"), F.col(text).alias("text"))
