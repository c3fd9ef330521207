"""Approximate nearest neighbours: inverted lists of coarse centroids, product-quantised residuals, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repset.llm.worker import bounded, tidy
from repset.session import materialize

#: vectors that centroids and codebooks are fitted on; every vector is indexed
SAMPLE = 20_000
MOST_LISTS = 1024
#: a query looks into as many lists as find this share of the nearest neighbours within the sample
TARGET, TRIALS = 0.97, 500
PARTS, CODES = 16, 256
#: vectors of a list in one task; queries pass by in batches, so that many of them take no memory
CHUNK = 16_384
#: ranked anew on the original vectors: the nearest by table in a chunk, and all that are within
#: this share of the product of norms of the last of these (near copies have nearly equal codes)
RERANK, MARGIN = 100, 0.06


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():
            c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class Model:
    """Coarse centroids and, for each part of a vector, codewords of the residual."""

    def __init__(self, sample: np.ndarray, n: int):
        lists = int(np.clip(np.sqrt(n) / 2, 1, MOST_LISTS))
        self.coarse = kmeans(sample, lists)
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(PARTS, sample.shape[1]))
        self.words = [kmeans(rest[:, c], CODES, rounds=8) for c in self.cuts]
        self.probe = self._probe(sample)

    def _probe(self, sample: np.ndarray, k: int = 20) -> int:
        q = sample[:TRIALS]
        k = min(k, len(sample) - 1)
        if k < 1:
            return len(self.coarse)
        s = q @ sample.T
        s[np.arange(len(q)), np.arange(len(q))] = -np.inf
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        order = np.argsort(-(q @ self.coarse.T), axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(len(self.coarse))[None, :], axis=1)
        at = nearest(sample, self.coarse)
        found = np.bincount(np.take_along_axis(rank, at[top], axis=1).ravel(), minlength=len(self.coarse))
        return int(np.searchsorted(np.cumsum(found), TARGET * found.sum())) + 1

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = nearest(x, self.coarse)
        rest = x - self.coarse[at]
        return at, np.stack([nearest(rest[:, c], w) for c, w in zip(self.cuts, self.words, strict=True)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        return [q[:, c] @ w.T for c, w in zip(self.cuts, self.words, strict=True)]


def _matrix(col: pa.Array) -> np.ndarray:
    rows = len(col)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(rows, -1)


_ROW = pa.schema([("list", pa.int32()), ("chunk", pa.int32()), ("is_query", pa.bool_()), ("vec_id", pa.int64()), ("code", pa.binary()), ("vec", pa.binary())])
_ROW_DDL = "list int, chunk int, is_query boolean, vec_id long, code binary, vec binary"


def _rows(lists, ids, codes, vecs, query: bool, chunk=None) -> pa.RecordBatch:
    n = len(ids)
    zero = np.zeros(n, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(lists, np.int32)), pa.array(zero if chunk is None else chunk, pa.int32()), pa.array(np.full(n, query)), pa.array(ids, pa.int64()), pa.array(codes, pa.binary()), pa.array(vecs, pa.binary())], schema=_ROW)


@tidy
def _indexed(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x = _matrix(b.column("embedding"))
            at, code = model.value.encode(x)
            yield _rows(at, b.column("vec_id").to_pylist(), [c.tobytes() for c in code], [v.tobytes() for v in x], False)


@tidy
def _asked(batches: Iterator[pa.RecordBatch], model, sizes: dict[int, int], k: int) -> Iterator[pa.RecordBatch]:
    """Each query to every chunk of the lists nearest to it: as many as the model probes, and on until
    they hold k vectors besides the query itself."""
    m = model.value
    held = np.array([sizes.get(i, 0) for i in range(len(m.coarse))])
    chunks = {i: -(-n // CHUNK) for i, n in sizes.items()}
    for whole in batches:
        for i in range(0, whole.num_rows, 200):
            b = whole.slice(i, 200)
            q = _matrix(b.column("embedding"))
            near = np.argsort(-(q @ m.coarse.T), axis=1, kind="stable")
            probe = np.maximum(m.probe, (held[near].cumsum(axis=1) <= k).sum(axis=1) + 1)
            out = [(int(at), v, x.tobytes(), c) for v, x, row, n in zip(b.column("vec_id").to_pylist(), q, near, probe, strict=True) for at in row[:n] for c in range(chunks.get(int(at), 0))]
            if out:
                at, v, x, c = zip(*out, strict=True)
                yield _rows(at, v, [None] * len(v), x, True, list(c))


_HIT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


@tidy
def _searched(batches: Iterator[pa.RecordBatch], model, k: int) -> Iterator[pa.RecordBatch]:
    """Rows come by (list, chunk): the vectors, by id, and then the queries."""
    m = model.value
    now, ids, codes, vecs, ready = None, [], [], [], None
    for b in batches:
        held: list[tuple[int, bytes]] = []

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal ready
            if not held or not ids:
                held.clear()
                return
            if ready is None:
                ready = (np.array(ids), np.frombuffer(b"".join(codes), np.uint8).reshape(len(ids), -1), np.frombuffer(b"".join(vecs)).reshape(len(ids), -1))
            who, code, x = ready
            for i in range(0, len(held), 64):
                part = held[i : i + 64]
                q = np.stack([np.frombuffer(v) for _, v in part])
                about = (q @ m.coarse[now[0]])[:, None] + sum(t[:, code[:, j]] for j, t in enumerate(m.tables(q)))
                n = min(RERANK, len(who))
                least = np.partition(about, len(who) - n, axis=1)[:, len(who) - n]
                least -= MARGIN * np.sqrt((q * q).sum(axis=1) * (x * x).sum(axis=1).mean())
                for (qid, _), near, own in zip(part, about >= least[:, None], q, strict=True):
                    row = np.flatnonzero(near & (who != qid))
                    score = x[row] @ own
                    best = np.lexsort((who[row], -score))[:k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), qid)), pa.array(who[row][best]), pa.array(score[best])], schema=_HIT)
            held.clear()

        for at, chunk, is_query, vec_id, code, vec in zip(*(b.column(c).to_pylist() for c in _ROW.names), strict=True):
            if (at, chunk) != now:
                yield from _joined(answer())
                now, ids, codes, vecs, ready = (at, chunk), [], [], [], None
            if is_query:
                held.append((vec_id, vec))
            else:
                ids.append(vec_id)
                codes.append(code)
                vecs.append(vec)
        yield from _joined(answer())


def _joined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    some = list(parts)
    if some:
        yield pa.Table.from_batches(some, schema=_HIT).combine_chunks().to_batches()[0]


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` (doubles) of the vectors that take part, repeats of a row once."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0)).distinct()


def search(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of each vector whose id is
    divisible by ``every`` with all other vectors found.

    All vectors are indexed; only centroids and codebooks are fitted on SAMPLE of them. Of equal
    vectors the k + 1 smallest ids are kept, as no more of them can be among the k nearest. Lists are
    dealt in chunks of about CHUNK vectors, so a list with a third of all vectors takes many tasks; each
    vector is sent once and each query once to every chunk it looks into. Scores are exact, in double precision; ties go to the smaller id.

    Vectors null, zero, or with null or non-finite components take no part, nor do rows without id or
    of another length than most (ties: the shorter). Repeated rows count once. A query with fewer
    candidates gets them all; an empty table gives an empty result."""
    spark = vectors.sparkSession
    bounded(spark)
    v = usable(vectors)
    length = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if length is None:
        return none
    v, _ = materialize(v.where(F.size("embedding") == length["d"]), "vectors")
    n = v.count()
    same = Window.partitionBy("embedding").orderBy("vec_id")
    kept, _ = materialize(v.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1), "kept")
    sample = kept.where("copy = 1").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow().column("embedding").combine_chunks()
    model = spark.sparkContext.broadcast(Model(_matrix(sample), n))
    index, _ = materialize(kept.select("vec_id", "embedding").mapInArrow(lambda it: _indexed(it, model), _ROW_DDL), "index")
    # one row a list, MOST_LISTS at most
    sizes = {r["list"]: r["count"] for r in index.groupBy("list").count().collect()}
    per = spark.createDataFrame(sorted((i, -(-n // CHUNK)) for i, n in sizes.items()), "l int, c int")
    placed = index.join(F.broadcast(per), F.col("list") == F.col("l")).withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("c")).cast("int"))
    placed = placed.select(*_ROW.names)
    asked = v.where(F.col("vec_id") % every == 0).mapInArrow(lambda it: _asked(it, model, sizes, k), _ROW_DDL)
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    both = placed.union(asked).repartition(tasks, "list", "chunk").sortWithinPartitions("list", "chunk", "is_query", "vec_id")
    hits = both.mapInArrow(lambda it: _searched(it, model, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
