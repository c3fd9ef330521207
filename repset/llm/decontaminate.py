"""Benchmark decontamination: a prefix-filtered join of benchmark windows with documents, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repset.session import materialize

WINDOW = 13
#: runs of ASCII letters and digits and anything beyond ASCII; as what a word holds, since Java is ten
#: times slower with a class of what it doesn't hold
WORD = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]+"
#: bytes of benchmark words, and of the stretches in its window table, up to which each is broadcast;
#: beyond, words are shuffled
BROADCAST_BYTES = 8 << 20


def low(word: Column) -> Column:
    """A-Z lowered, and nothing else."""
    other = F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(other)


def words(text: Column) -> Column:
    """The words of a text, as they are written."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def low_words(text: Column) -> Column:
    return F.transform(words(text), low)


def anchors(items: DataFrame, rarity: DataFrame, window: int) -> DataFrame:
    """One row for each prefix word of the benchmark: ``anchor, item_id, seg, at, width``.

    A window occurs only where its rarest word does, so that word is its necessary prefix. Windows
    of an item whose rarest word is the same position are one stretch ``seg`` of the item, with
    the anchor at index ``at`` (from 0)."""
    w = items.select("item_id", low_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.withColumns({"iid": F.xxhash64("item_id", F.array_join("w", " ")), "width": F.least(F.size("w"), F.lit(window))})
    pos = w.select("item_id", "iid", "width", F.posexplode("w").alias("p", "word")).join(rarity, "word")
    # every window start s = p-width+1 .. p that lies in the item, then the rarest word of each window
    inside = Window.partitionBy("iid", "item_id").orderBy("p").rowsBetween(0, window - 1)
    best = F.min(F.struct("df", "word", "p")).over(inside)
    n = F.max("p").over(Window.partitionBy("iid", "item_id")) + 1
    starts = pos.select("item_id", "iid", "width", "p", best.alias("best"), n.alias("n")).where(F.col("p") + F.col("width") <= F.col("n"))
    runs = starts.groupBy("item_id", "iid", "width", F.col("best.p").alias("a"), F.col("best.word").alias("anchor")).agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    whole = w.select(F.col("item_id").alias("id"), F.col("iid").alias("own"), "w")
    runs = runs.join(whole, (F.col("iid") == F.col("own")) & F.col("item_id").eqNullSafe(F.col("id")))  # ids may be null
    seg = F.slice("w", F.col("lo") + 1, F.col("hi") - F.col("lo") + F.col("width"))
    return runs.select("anchor", "item_id", seg.alias("seg"), (F.col("a") - F.col("lo")).alias("at"), "width").distinct()


def _run(side: int) -> Column:
    """How many words before (-1) or after (1) the anchor agree, within the stretch; the anchor is at index c of ``near``."""
    room = F.col("at") if side < 0 else F.size("seg") - 1 - F.col("at")
    same = F.transform(F.sequence(F.lit(1), room), lambda k: F.get("near", F.col("c") + side * k).eqNullSafe(F.get("seg", F.col("at") + side * k)))
    first = F.array_position(same, False)
    return F.when(room == 0, 0).when(first == 0, room).otherwise(first.cast("int") - 1)


def overlaps(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, text_hash, item_id, lo, hi``: stretches of words of a document that are covered by
    occurrences of windows of an item. Documents are scanned twice: once for the document counts
    that order words by rarity, once for the join.

    Each word of a document is a row only inside one compiled loop, which looks it up among the
    anchors and compares the word before or after; what passes takes along the words around it and
    is verified. That is, if the benchmark's tables are under BROADCAST_BYTES, so that they can be
    broadcast; otherwise words are shuffled. The window table is kept in the shared folder, so that
    words aren't counted a second time."""
    vocab = items.select(F.explode(low_words(F.col("text"))).alias("word")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    hint = F.broadcast if size <= BROADCAST_BYTES else (lambda df: df)
    seen = docs.select(F.explode_outer(words(F.col("text"))).alias("raw")).select(low(F.col("raw")).alias("word"))
    seen = seen.join(hint(vocab), "word").groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    rarity = vocab.join(seen, "word", "left").select("word", F.coalesce("df", F.lit(0)).alias("df"))
    table = anchors(items, rarity, window)
    table = table.withColumns({"before": F.get("seg", F.col("at") - 1), "after": F.get("seg", F.col("at") + 1)})
    table, _ = materialize(table, "anchors")
    small = (table.agg(F.sum(F.octet_length(F.array_join("seg", " ")))).first()[0] or 0) <= BROADCAST_BYTES
    # the outer forms of explode: Spark guards the others by a filter that splits the text a second time
    d = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    beside = (F.col("width") == 1) | (low(F.get("w", F.col("q") - 1)) == F.col("before")) | (low(F.get("w", F.col("q") + 1)) == F.col("after"))
    if small:
        spread = d.select("doc_id", "text_hash", "w", F.posexplode_outer("w").alias("q", "raw"))
        hit = spread.join(F.broadcast(table), (low(F.col("raw")) == F.col("anchor")) & beside)
    else:
        spread = d.select("doc_id", "text_hash", F.posexplode_outer("w").alias("q", "raw")).select("doc_id", "text_hash", "q", low(F.col("raw")).alias("word"))
        found = spread.join(table, F.col("word") == F.col("anchor")).drop("word").withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
        hit = d.dropDuplicates(["doc_id", "text_hash"]).join(found, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("text_hash").eqNullSafe(F.col("h"))).where(beside)
    ahead = F.least(F.col("q"), F.lit(window - 1))
    around = low(F.array_join(F.slice("w", F.col("q") - ahead + 1, ahead + window), " "))
    # what isn't deterministic is a fence: the steps after it, which can't be compiled, aren't drawn into
    # the loop over all words, whose rows would then each take along the whole document
    near = F.when(F.spark_partition_id() >= 0, F.split(around, " "))
    hit = hit.select("doc_id", "text_hash", "item_id", "q", "seg", "at", "width", near.alias("near"), ahead.alias("c"))
    return hit.where(_run(-1) + _run(1) + 1 >= F.col("width")).select("doc_id", "text_hash", "item_id", (F.col("q") - _run(-1)).alias("lo"), (F.col("q") + _run(1)).alias("hi"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated`` for every row of ``docs``.

    An item's windows are ``window`` words in a row; an item of fewer words is one window of all of
    them and an item without words has none. A word of a document inside any occurrence of a window
    is hit. A document is contaminated if at least 1 in 20 of its words is hit, and one at least.
    Null and empty texts have no words and are clean; repeated rows each get a row; equal windows of
    several items count for each; an empty benchmark hits nothing; items_sha256 of none is that of
    the empty string; items without id count but are left out of items_sha256."""
    o = overlaps(docs, items, window).distinct()
    ordered = Window.partitionBy("doc_id", "text_hash").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    o = o.withColumn("done", F.coalesce(F.max("hi").over(ordered), F.lit(-1)))
    o = o.withColumn("fresh", F.greatest(F.lit(0), F.col("hi") - F.greatest(F.col("done"), F.col("lo") - 1)))
    ids = F.collect_set(F.col("item_id").cast("string"))
    per = o.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.sum("fresh").alias("hit"), F.size(F.collect_set(F.struct("item_id"))).cast("long").alias("k"), F.sha2(F.array_join(F.sort_array(ids), ",").cast("binary"), 256).alias("sha"))
    d = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    out = d.join(per, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("text_hash").eqNullSafe(F.col("h")), "left")
    hit = F.coalesce("hit", F.lit(0)).cast("long")
    return out.select("doc_id", "text_hash", "n_words", hit.alias("n_hit"), F.coalesce("k", F.lit(0)).cast("long").alias("n_items"), F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
 i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
 iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[s : s + least(len(w), 13) - 1], ' ') AS g
        FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS s FROM i WHERE len(w) > 0)),
 ks AS (SELECT DISTINCT k FROM iw),
 dp AS (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM d, ks WHERE len(w) >= k),
 hit AS (SELECT dp.doc_id, dp.s, dp.k, iw.item_id FROM dp JOIN iw ON iw.k = dp.k AND iw.g = array_to_string(dp.w[dp.s : dp.s + dp.k - 1], ' ')),
 pos AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + k - 1)) AS p FROM hit) GROUP BY doc_id),
 its AS (SELECT doc_id, count(*)::BIGINT AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
