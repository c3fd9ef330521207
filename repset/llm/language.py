"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repset.llm.worker import bounded, pieces, tidy

BITS = 16
ORDERS = (1, 2, 3)
#: most languages: the broadcast matrix is 2^BITS * MOST_LANGS * 4 bytes at most
MOST_LANGS = 1000
ALPHA = 0.5
#: characters held as features at once
WINDOW = 1 << 20
_SLICE = 4096
_LETTER = regex.compile(r"\p{L}")
_MUL = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 0


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text index, feature) of every n-gram of lower-cased texts, a window of characters at a time."""
    low = [t.lower() for t in texts]
    ends = np.cumsum([len(t) for t in low], dtype=np.int64)
    cp = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    for a in range(0, len(cp), WINDOW):
        b = min(a + WINDOW, len(cp))
        at = np.arange(a, b)
        doc = np.searchsorted(ends, at, side="right")
        room = ends[doc] - at
        h = np.zeros(b - a, dtype=np.uint32)
        for k in range(max(ORDERS)):
            part = cp[a + k : b + k]
            h[: len(part)] = (h[: len(part)] ^ part) * _MUL[k]
            h ^= h >> np.uint32(15)
            if k + 1 in ORDERS:
                ok = room > k
                yield doc[ok], ((h[ok] * _MUL[2]) >> np.uint32(32 - BITS)).astype(np.int64)


@tidy
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for b in pieces(batches):
        rows = [(t or "", lang) for d, t, lang in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "lang")), strict=True) if lang is not None and not held_out(d)]
        names = sorted({lang for _, lang in rows})
        index = {x: k for k, x in enumerate(names)}
        of = np.array([index[lang] for _, lang in rows], dtype=np.int64)
        for lang in names:
            sums.setdefault(lang, np.zeros(1 << BITS, dtype=np.int64))
        for _, lang in rows:
            docs[lang] = docs.get(lang, 0) + 1
        if len(sums) > MOST_LANGS:
            raise ValueError(f"more than {MOST_LANGS} languages")
        for doc, f in features([t for t, _ in rows]):
            for k, x in enumerate(np.bincount(of[doc] << BITS | f, minlength=len(names) << BITS).reshape(len(names), -1)):
                sums[names[k]] += x
    out = [(lang, k, pa.compress(x[k * _SLICE : (k + 1) * _SLICE].tobytes(), codec="zstd", asbytes=True), docs[lang] if k == 0 else 0) for lang, x in sums.items() for k in range((1 << BITS) // _SLICE)]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.binary(), pa.int64()), strict=True)], names=["lang", "slice", "counts", "docs"])


@tidy
def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple, list] = {}
    for b in batches:
        for lang, k, x, n in zip(*(b.column(c).to_pylist() for c in ("lang", "slice", "counts", "docs")), strict=True):
            x = np.frombuffer(pa.decompress(x, decompressed_size=8 * _SLICE, codec="zstd", asbytes=True), "<i8")
            s = sums.setdefault((lang, k), [np.zeros(_SLICE, np.int64), 0])
            s[0] = s[0] + x
            s[1] += n
    if sums:
        out = [(lang, k, x.tobytes(), n) for (lang, k), (x, n) in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.binary(), pa.int64()), strict=True)], names=["lang", "slice", "counts", "docs"])


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log-probability matrix feature x language, log priors) from all documents with a
    language whose crc32(doc_id as text) mod 5 is not 0. Each task sends one sum a language and slice
    of features, so a language with a third of all documents takes no more than the others."""
    schema = "lang string, slice int, counts binary, docs long"
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("lang IS NOT NULL")
    tasks = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = d.mapInArrow(_counted, schema).repartition(tasks, "lang", "slice").mapInArrow(_summed, schema).collect()
    langs = sorted({r["lang"] for r in rows})
    index = {x: k for k, x in enumerate(langs)}
    counts, n = np.zeros((1 << BITS, len(langs))), np.zeros(len(langs))
    for r in rows:
        counts[r["slice"] * _SLICE : (r["slice"] + 1) * _SLICE, index[r["lang"]]] += np.frombuffer(bytes(r["counts"]), "<i8")
        n[index[r["lang"]]] += r["docs"]
    logp = np.log((counts + ALPHA) / (counts.sum(axis=0) + ALPHA * (1 << BITS)))
    return langs, logp.astype(np.float32), np.log(np.maximum(n, 1) / max(n.sum(), 1))


@tidy
def _predicted(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    langs, logp, prior = model.value
    for b in pieces(batches):
        ids, texts = b.column("doc_id").to_pylist(), [t or "" for t in b.column("text").to_pylist()]
        known = [bool(langs) and _LETTER.search(t) is not None for t in texts]
        pred, score = ["und"] * len(texts), [0.0] * len(texts)
        todo = [i for i, k in enumerate(known) if k]
        if todo:
            s = np.tile(prior, (len(todo), 1))
            for doc, f in features([texts[i] for i in todo]):
                if len(doc):
                    cut = np.flatnonzero(np.diff(doc, prepend=-1))
                    s[doc[cut]] += np.add.reduceat(logp[f], cut, axis=0, dtype=np.float64)
            best = s.argmax(axis=1)
            sure = 1 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)
            for i, k, p in zip(todo, best.tolist(), sure.tolist(), strict=True):
                pred[i], score[i] = langs[k], min(1.0, p)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([held_out(d) for d in ids], pa.bool_()), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs`` (doc_id, text, lang).

    lang_pred is the learned language with the largest posterior (ties: first by name) and score
    that posterior; ``und`` with score 0 if the text is null or has no letter, or nothing was
    learned. The whole text counts, lower-cased. Only training reads lang. A null id counts as the
    empty string; repeated rows count and get a row each."""
    bounded(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.mapInArrow(lambda it: _predicted(it, model), "doc_id long, held_out boolean, lang_pred string, score double")
