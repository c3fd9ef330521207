"""Deleted interpolation: bigram, unigram and uniform estimates mixed by context-frequency buckets.

Counts travel as blocks: a chunk of documents (some MB of text) sends, for each range of keys, its
sorted distinct words and word pairs as one row of packed arrays with its own training counts. One
task merges a range and returns to each chunk the corpus counts of just the keys it sent, in the
order it sent them. So no table of counts is broadcast or held whole anywhere, each count is
exact, and a frequent word is one key of a chunk however often it occurs.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repset.llm import hashing
from repset.llm.store import Store
from repset.llm.worker import bounded, pieces, tidy
from repset.session import materialize, scratch

_U = np.uint64
CHUNK_BYTES = 8 << 20
RANGE_BYTES = 24 << 20
BUCKETS = 16
#: quarter octaves over the uniform probability, for the table that expectation-maximisation runs on
BINS = 254
END, BEGIN = _U(0x0123456789ABCDEF), _U(0xFEDCBA9876543210)
_PAIR = _U(0x9E3779B97F4A7C15)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def _tuning(doc_id: int | None) -> bool:
    return zlib.crc32(f"tune:{'' if doc_id is None else doc_id}".encode()) % 10 == 0


def _z(x: np.ndarray) -> bytes:
    raw = x.tobytes()
    return struct.pack("<Q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def _unz(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(b[8:], decompressed_size=struct.unpack("<Q", b[:8])[0], codec="zstd", asbytes=True), kind)


def _pairs(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Keys of (word before, word); before a text's first word stands BEGIN."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[np.append(0, ends[:-1])] = BEGIN
    return hashing.mix(hashing.mix(before) * _PAIR + words)


def _counts(at: np.ndarray, size: int, which: np.ndarray) -> np.ndarray:
    return np.bincount(at[which], minlength=size).astype("<u4")


_BLOCK = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("train", pa.binary()), ("tune", pa.binary())])


@tidy
def _chunks(batches: Iterator[pa.RecordBatch], uri: str, parts: int) -> Iterator[pa.RecordBatch]:
    """Store each chunk's token stream; yield its key blocks."""
    from pyspark import TaskContext

    store, base = Store(uri), TaskContext.get().partitionId() << 24

    def flush(held: list[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        doc, text = t.column("doc_id").combine_chunks(), t.column("text").combine_chunks()
        low, starts, stops, first = hashing.tokens(text)
        h = hashing.hash_spans(low, starts, stops)
        n = np.diff(first) + 1
        ends = np.cumsum(n)
        words = np.empty(len(h) + len(n), dtype=_U)
        last = np.zeros(len(words), dtype=bool)
        last[ends - 1] = True
        words[last], words[~last] = END, h
        ids = doc.to_pylist()
        out = np.array([held_out(d) for d in ids])
        tune = np.array([_tuning(d) for d in ids]) & ~out
        vocab, at = np.unique(words, return_inverse=True)
        store.put(f"chunk-{chunk}", _body(doc, n, out, tune, vocab, at.astype("<u4")))
        learn, hold = np.repeat(~out, n), np.repeat(tune, n)
        sets = [(0, vocab, at), (1, *np.unique(_pairs(words, ends), return_inverse=True))]
        begin = np.array([(~out).sum(), tune.sum()])
        for kind, keys, where in sets:
            a, b = _counts(where, len(keys), learn), _counts(where, len(keys), hold)
            if kind == 0:  # the context before each text is counted like a word, but isn't one
                k = int(np.searchsorted(keys, BEGIN))
                keys, a, b = np.insert(keys, k, BEGIN), np.insert(a, k, begin[0]), np.insert(b, k, begin[1])
            cut = np.searchsorted(keys, hashing.edges(parts)).tolist() + [len(keys)]
            rows = [{"kind": kind, "part": p, "chunk": chunk, "keys": hashing.pack_sorted(keys[i:j]), "train": _z(a[i:j]), "tune": _z(b[i:j])} for p, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if i < j]
            yield pa.RecordBatch.from_pylist(rows, schema=_BLOCK)

    held, size, k = [], 0, 0
    for b in pieces(batches):
        held.append(b)
        raw, _ = hashing.buffers(b.column("text"))
        size += len(raw)
        if size >= CHUNK_BYTES:
            yield from flush(held, base | k)
            held, size, k = [], 0, k + 1
    if held:
        yield from flush(held, base | k)


def _body(doc: pa.Array, n: np.ndarray, out: np.ndarray, tune: np.ndarray, vocab: np.ndarray, at: np.ndarray) -> list[bytes]:
    cols = [np.asarray(doc.fill_null(0), "<i8"), np.asarray(doc.is_valid()).astype("u1"), n.astype("<i8"), out.astype("u1"), tune.astype("u1"), vocab, at]
    packed = [_z(x) for x in cols]
    return [struct.pack(f"<{len(packed)}Q", *map(len, packed)), *packed]


def _load(raw: bytes) -> list[np.ndarray]:
    sizes = struct.unpack("<7Q", raw[:56])
    at, out = 56, []
    for size, kind in zip(sizes, ("<i8", "u1", "<i8", "u1", "u1", "<u8", "<u4"), strict=True):
        out.append(_unz(raw[at : at + size], kind))
        at += size
    return out


_REPLY = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("train", pa.binary()), ("tune", pa.binary()), ("n", pa.int64()), ("v", pa.int64()), ("n_tune", pa.int64())])


@tidy
def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (kind, part), rows in hashing.grouped(batches, ["kind", "part"]):
        keys = [hashing.unpack_sorted(r["keys"]) for r in rows]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([_unz(r["train"], "<u4") for r in rows]), minlength=len(distinct)).astype(np.int64)
        tuned = np.bincount(at, weights=np.concatenate([_unz(r["tune"], "<u4") for r in rows]), minlength=len(distinct)).astype(np.int64)
        n = v = m = 0
        if kind == 0:
            real = distinct != BEGIN
            n, v, m = int(total[real].sum()), int((total[real] > 0).sum()), int(tuned[real].sum())
        yield pa.RecordBatch.from_pylist([{"kind": kind, "part": part, "n": n, "v": v, "n_tune": m}], schema=_REPLY)
        i = 0
        for r, k in zip(rows, keys, strict=True):
            mine = at[i : i + len(k)]
            i += len(k)
            yield pa.RecordBatch.from_pylist([{"chunk": r["chunk"], "kind": kind, "part": part, "train": _z(total[mine].astype("<u8")), "tune": _z(tuned[mine].astype("<u8"))}], schema=_REPLY)


class _Chunk:
    """A chunk with the corpus counts of its tokens, pairs and contexts."""

    def __init__(self, store: Store, chunk: int, rows: list[dict]):
        doc, has, self.n, out, tune, vocab, at = _load(store.get(f"chunk-{chunk}"))
        self.doc = [int(d) if h else None for d, h in zip(doc, has, strict=True)]
        self.out, self.tune = out.astype(bool), tune.astype(bool)
        words, self.ends = vocab[at], np.cumsum(self.n)
        _, pair = np.unique(_pairs(words, self.ends), return_inverse=True)
        self.first = self.ends - self.n
        k = int(np.searchsorted(vocab, BEGIN))
        got = {(kind, what): np.concatenate([_unz(r[what], "<u8") for r in rows if r["kind"] == kind]).astype(np.int64) for kind in (0, 1) for what in ("train", "tune")}

        def counts(what: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            uni = got[0, what]
            begin, c = uni[k], np.delete(uni, k)[at]
            before = np.empty_like(c)
            before[1:] = c[:-1]
            before[self.first] = begin
            return c, before, got[1, what][pair]

        self.counts = counts


def _probabilities(c: np.ndarray, before: np.ndarray, pair: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context bucket, bigram, unigram)"""
    bucket = np.minimum(np.log2(before + 1.0).astype(np.int64), BUCKETS - 1)
    return bucket, pair / np.maximum(before, 1), c / max(n, 1)


@tidy
def _bins(batches: Iterator[pa.RecordBatch], uri: str, n: int, v: int) -> Iterator[pa.RecordBatch]:
    """How many tuning tokens lie in each cell of (bucket, bigram bin, unigram bin), by counts without the tuning part."""
    store = Store(uri)
    for (chunk,), rows in hashing.grouped(batches, ["chunk"]):
        x = _Chunk(store, chunk, rows)
        some = np.repeat(x.tune, x.n)
        if not some.any():
            continue
        rest = [a[some] - b[some] for a, b in zip(x.counts("train"), x.counts("tune"), strict=True)]
        bucket, two, one = _probabilities(*rest, n)

        def grade(p: np.ndarray) -> np.ndarray:
            return np.where(p > 0, 1 + np.clip(np.rint(4 * np.log2(np.maximum(p, 1e-300) * (v + 1))), 0, BINS), 0).astype(np.int64)

        cell, count = np.unique((bucket * (BINS + 2) + grade(two)) * (BINS + 2) + grade(one), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(count)], names=["cell", "n"])


def learn_weights(cells: np.ndarray, counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each bucket by expectation-maximisation."""
    one, rest = cells % (BINS + 2), cells // (BINS + 2)
    two, bucket = rest % (BINS + 2), rest // (BINS + 2)
    p = np.stack([np.where(two > 0, 2.0 ** ((two - 1) / 4), 0), np.where(one > 0, 2.0 ** ((one - 1) / 4), 0), np.ones(len(cells))], axis=1)
    w = np.tile([0.3, 0.5, 0.2], (BUCKETS, 1))
    w[0] = [0.0, 0.7, 0.3]  # a context never seen says nothing
    for _ in range(rounds if len(cells) else 0):
        share = p * w[bucket]
        share *= (counts / share.sum(axis=1))[:, None]
        new = np.zeros_like(w)
        np.add.at(new, bucket, share)
        new += w  # one token's worth of the weights before: a bucket without tokens keeps them
        w = new / new.sum(axis=1, keepdims=True)
    return w


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@tidy
def _scores(batches: Iterator[pa.RecordBatch], uri: str, n: int, v: int, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    store = Store(uri)
    for (chunk,), rows in hashing.grouped(batches, ["chunk"]):
        x = _Chunk(store, chunk, rows)
        c, before, pair = x.counts("train")
        bucket, two, one = _probabilities(c, before, pair, n)
        w = weights[bucket]
        p = w[:, 0] * two + w[:, 1] * one + w[:, 2] / (v + 1) if n else np.ones(len(c))
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        cols = [np.add.reduceat(y, x.first) for y in ((c > 0).astype(np.int64), base, np.log10(p))]
        yield pa.RecordBatch.from_arrays([pa.array(x.doc, pa.int64()), pa.array(x.out), pa.array(x.n), pa.array(cols[0]), pa.array(np.full(len(x.n), n)), pa.array(cols[1]), pa.array(cols[2])], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score_documents(docs: DataFrame) -> DataFrame:
    """Score every text of ``docs`` (doc_id, text); the columns are those of _SCORED.

    The model learns from documents whose crc32(doc_id as text) mod 5 is not 1. A tenth of those
    tunes the weights with counts of the other nine tenths; scores then use the counts of all.
    A token's probability is a weighted sum of its relative frequency after the word before, its
    relative frequency, and 1 / (V + 1), with weights by the frequency of the word before in powers
    of two. Tokens: words, A-Z lowered, split at ASCII white space, then one end.

    Null and wordless texts are the end alone. A null id counts as the empty string. Repeated rows
    count and are scored each. Without training tokens score and base_score are 0."""
    spark = docs.sparkSession
    bounded(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-int(size) // RANGE_BYTES))
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    uri = scratch(spark, "chunks")
    Store(uri).create()
    blocks = d.mapInArrow(lambda it: _chunks(it, uri, parts), "kind int, part int, chunk long, keys binary, train binary, tune binary")
    merged = blocks.repartition(tasks, "kind", "part").sortWithinPartitions("kind", "part", "chunk").mapInArrow(_merge, "chunk long, kind int, part int, train binary, tune binary, n long, v long, n_tune long")
    replies, _ = materialize(merged, "replies")
    total = replies.where("chunk IS NULL").agg(F.sum("n"), F.sum("v"), F.sum("n_tune")).first()
    n, v, n_tune = (int(x or 0) for x in total)
    mine = replies.where("chunk IS NOT NULL").select("chunk", "kind", "part", "train", "tune").repartition(tasks, "chunk").sortWithinPartitions("chunk", "kind", "part")
    # at most BUCKETS * (BINS + 2)^2 cells, whatever the corpus
    cells = mine.mapInArrow(lambda it: _bins(it, uri, n - n_tune, v), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    weights = learn_weights(cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.float64))
    return mine.mapInArrow(lambda it: _scores(it, uri, n, v, weights), _SCORED)
