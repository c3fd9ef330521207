"""Quality classifier: evidence of each document, and hierarchical empirical Bayes over hosts and paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repset.llm import hashing
from repset.llm.worker import bounded, pieces, tidy
from repset.session import drop, materialize

_U = np.uint64
#: a feature is evidence if its likelihood-ratio statistic is at least this; the strongest MOST are used
LEAST_G2, MOST = 25.0, 20_000
#: labelled documents, those with the smallest hashes of their ids, on which the weights are fitted;
#: and the price of a weight's size, in units of log-likelihood
FITTED, PRICE = 30_000, 1.5
#: label rows up to which they are broadcast; beyond, joined by shuffle
BROADCAST_LABELS = 500_000
#: one labelled document in so many calibrates, the others give the weights
FOLDS = 5
TARGETS = ("low", "toxic")
_PREFIX, _SHAPE = _U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F)
_STEPS = np.array([1e-9, 0.01, 0.03, 0.06, 0.12, 0.25, 0.5, 0.75])


def _kind(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


_BYTES = [_kind((0x41, 0x5A)), _kind((0x30, 0x39)), _kind((0x21, 0x21)), _kind((0x7C, 0x7C)), _kind((0x23, 0x26), (0x2A, 0x2B), (0x40, 0x40), (0x5C, 0x5C), (0x5E, 0x60), (0x7E, 0x7E)), _kind((0x20, 0x20), (0x09, 0x0D))]


def _share(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.searchsorted(_STEPS, x / np.maximum(n, 1), side="right")


def _sums(x: np.ndarray, cut: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(x, dtype=np.int64))
    return total[cut[1:]] - total[cut[:-1]]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of words, of the first five bytes of longer words, and of graded shapes of each
    text: shares of kinds of characters, repeated words and lines, word length. With repeats."""
    raw, off = hashing.buffers(texts)
    rows = len(off) - 1
    low, s, e, first = hashing.tokens(texts, hashing.NO_WORD)
    word = hashing.hash_spans(low, s, e)
    of = np.repeat(np.arange(rows), np.diff(first))
    big = np.flatnonzero(e - s > 6)
    prefix = hashing.mix(hashing.hash_spans(low, s[big], s[big] + 5) ^ _PREFIX)
    shapes = [_share(_sums(k[raw], off), np.diff(off)) for k in _BYTES]
    low, ts, te, tf = hashing.tokens(texts)
    token, n = hashing.hash_spans(low, ts, te), np.diff(tf)
    again = np.zeros(len(token), dtype=bool)
    again[1:] = token[1:] == token[:-1]
    again[tf[:-1][tf[:-1] < len(token)]] = False
    shapes.append(_share(_sums(again, tf), n))
    shapes.append(np.minimum(_sums(te - ts, tf) // np.maximum(n, 1), 15))
    by = np.repeat(np.arange(rows), n)
    order = np.lexsort((token, by))
    new = np.ones(len(token), dtype=bool)
    new[1:] = (token[order][1:] != token[order][:-1]) | (by[order][1:] != by[order][:-1])
    shapes.append(_share(n - _sums(new, tf), n) * 16 + np.minimum(np.log2(n + 1).astype(np.int64), 15))
    shape = np.concatenate([hashing.mix((x.astype(_U) + _U(1000 * (k + 1))) ^ _SHAPE) for k, x in enumerate(shapes)])
    return np.concatenate([of, of[big], np.tile(np.arange(rows), len(shapes))]), np.concatenate([word, prefix, shape])


def _present(rows: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (row, hash) once."""
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    return rows[new], h[new]


_COUNTS = ("low1", "low0", "toxic1", "toxic0")
_BLOCK = pa.schema([("part", pa.int32()), ("keys", pa.binary()), *((c, pa.binary()) for c in _COUNTS)])
_BLOCK_DDL = "part int, keys binary, " + ", ".join(f"{c} binary" for c in _COUNTS)


def _z(x: np.ndarray) -> bytes:
    return pa.compress(x.astype("<u4").tobytes(), codec="zstd", asbytes=True)


def _unz(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(b, decompressed_size=4 * n, codec="zstd", asbytes=True), "<u4")


@tidy
def _counted(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Document counts of features by label, summed over some million features at a time."""
    edges = np.array([(p << 64) // parts for p in range(parts)], dtype=_U)

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        h = np.concatenate([x for x, _ in held])
        keys, at = np.unique(h, return_inverse=True)
        flags = np.concatenate([y for _, y in held], axis=1)
        counts = [np.bincount(at[f], minlength=len(keys)) for f in flags]
        cut = np.searchsorted(keys, edges).tolist() + [len(keys)]
        yield pa.RecordBatch.from_pylist([{"part": p, "keys": keys[i:j].tobytes()} | {c: _z(x[i:j]) for c, x in zip(_COUNTS, counts, strict=True)} for p, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if i < j], schema=_BLOCK)

    held, size = [], 0
    for b in pieces(batches):
        q, t = (np.array([-1 if x is None else int(x) for x in b.column(c).to_pylist()]) for c in ("quality", "toxic"))
        rows, h = _present(*features(b.column("text")))
        flags = np.stack([q == 0, q == 1, t == 1, t == 0])
        held.append((h, flags[:, rows]))
        size += len(h)
        if size > 3_000_000:
            yield from flush(held)
            held, size = [], 0
    if held:
        yield from flush(held)


def _g2(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Likelihood-ratio statistic of presence in a of n1 and b of n0."""
    out = np.zeros(len(a))
    p = (a + b) / (n1 + n0)
    for seen, share in ((a, n1 * p), (b, n0 * p), (n1 - a, n1 * (1 - p)), (n0 - b, n0 * (1 - p))):
        out += np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(share, 1e-9)), 0)
    return 2 * out


@tidy
def _selected(batches: Iterator[pa.RecordBatch], n: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Rows come by part: merge its blocks and keep the features that are evidence."""

    def flush(held: list[dict]) -> Iterator[pa.RecordBatch]:
        keys = [np.frombuffer(r["keys"], "<u8") for r in held]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        c = {k: np.bincount(at, weights=np.concatenate([_unz(r[k], len(x)) for r, x in zip(held, keys, strict=True)]), minlength=len(distinct)) for k in _COUNTS}
        for t in TARGETS:
            a, b, n1, n0 = c[f"{t}1"], c[f"{t}0"], n[f"{t}1"], n[f"{t}0"]
            if not n1 or not n0:
                continue
            g, w = _g2(a, b, n1, n0), np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
            ok = (g >= LEAST_G2) & ((w > 0) | (t == "low"))
            yield pa.RecordBatch.from_arrays([pa.array([t] * int(ok.sum()), pa.string()), pa.array(distinct[ok].view(np.int64)), pa.array(w[ok]), pa.array(g[ok])], names=["target", "feature", "weight", "g2"])

    now, held = None, []
    for b in batches:
        for r in b.to_pylist():
            if r["part"] != now:
                if held:
                    yield from flush(held)
                now, held = r["part"], []
            held.append(r)
    if held:
        yield from flush(held)


@tidy
def _marked(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """Which of each target's features a labelled document has, as packed indices."""
    for b in pieces(batches):
        cols = [_hits(*features(b.column("text")), model.value[t][0]) for t in TARGETS]
        packed = [pa.array([at[rows == k].astype("<i4").tobytes() for k in range(b.num_rows)], pa.binary()) for rows, at in cols]
        yield pa.RecordBatch.from_arrays([b.column("quality"), b.column("toxic"), *packed], names=["quality", "toxic", "low_hits", "toxic_hits"])


def _hits(rows: np.ndarray, h: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the features among ``keys``, each once."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    hit = keys[at] == h
    pairs = np.unique(rows[hit] * len(keys) + at[hit])
    return pairs // len(keys), pairs % len(keys)


def fit(packed: list[bytes], y: np.ndarray, size: int, rounds: int = 400) -> np.ndarray:
    """Weights and, last, the offset of a sparse logistic regression with a price on the weights' sizes,
    so that features which only go along with the telling ones (as in copies of a document) get none.
    ``packed``: the features of each row as 32-bit integers. Accelerated proximal gradients; each
    column is scaled by its frequency."""
    n = np.array([len(x) // 4 for x in packed])
    at = np.frombuffer(b"".join(packed), "<i4")
    scale = 1 / np.sqrt(np.maximum(np.append(np.bincount(at, minlength=size), len(n)), 1))
    price = PRICE * scale
    price[size] = 0

    # in blocks of rows of about a million features, so that what is held besides them stays small
    ends = np.cumsum(n)
    rows = np.unique(np.append(np.searchsorted(ends, np.arange(1_000_000, int(ends[-1]) if len(ends) else 0, 1_000_000)), len(n)))
    blocks = [(int(i), int(j), int(ends[i - 1]) if i else 0, int(ends[j - 1])) for i, j in zip(np.append(0, rows[:-1]), rows, strict=True) if j > i]

    def forward(u: np.ndarray) -> np.ndarray:
        v = u * scale
        out = np.full(len(n), float(v[size]))
        for i, j, a, b in blocks:
            some = np.flatnonzero(n[i:j])
            if len(some):
                first = ends[i:j][some] - n[i:j][some] - a
                out[i + some] += np.add.reduceat(v[at[a:b]], first)
        return out

    def back(r: np.ndarray) -> np.ndarray:
        out = np.zeros(size)
        for i, j, a, b in blocks:
            out += np.bincount(at[a:b], weights=np.repeat(r[i:j], n[i:j]), minlength=size)
        return np.append(out, r.sum()) * scale

    u = np.ones(size + 1)
    for _ in range(20):
        u = back(forward(u / np.linalg.norm(u)))
    step = 1 / (0.25 * 1.1 * max(float(np.linalg.norm(u)), 1e-9))
    w, z, t = np.zeros(size + 1), np.zeros(size + 1), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(forward(z), -30, 30)))
        new = z - step * back(p - y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * price, 0)
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t1 * (new - w), new, t1
    return w * scale


@tidy
def _weighed(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        rows, h = features(b.column("text"))
        sums = []
        for t in TARGETS:
            keys, w = model.value[t]
            of, at = _hits(rows, h, keys)
            s = np.bincount(of, weights=w[at], minlength=b.num_rows) + w[len(keys)]
            sums.append(pa.array(s))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "text_hash", "source")), *sums], names=["doc_id", "text_hash", "source", "s_low", "s_toxic"])


def _logistic(s: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of P(pos | s), with a ridge so that separable data stay finite."""
    x = np.stack([s, np.ones(len(s))], axis=1)
    w, n = np.zeros(2), pos + neg
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (pos - n * p) - np.array([0.01, 1e-6]) * w
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag([0.01, 1e-6])
        step = np.linalg.solve(hess, grad)
        w = w + step / max(1.0, np.abs(step).max())
    return float(w[0]), float(w[1])


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(p / (1 - p))


def site_posteriors(x: DataFrame) -> DataFrame:
    """``x`` with ``p_low, p_toxic`` from each document's evidence (e: log odds, v: label or probability, by target) and
    its site (host, path).

    A level's rate is the mean of v over its other documents, shrunk by m pseudo documents towards
    the level above: host to the global mean, path to host; m by the moments of the hosts' rates. A
    path that is all of its host isn't counted twice. The posterior log odds are the evidence plus
    what the site's log odds differ from the global ones."""
    sums_of = lambda level: [F.count(F.lit(1)).alias(f"n_{level}"), *(F.sum(f"v_{t}").alias(f"{t}_{level}") for t in TARGETS)]
    path = x.groupBy("host", "path").agg(*sums_of("path"))
    path, _ = materialize(path, "paths")
    host = path.groupBy("host").agg(F.sum("n_path").alias("n_host"), *(F.sum(f"{t}_path").alias(f"{t}_host") for t in TARGETS))
    site = path.join(host, "host")
    moments = host.agg(F.sum("n_host").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(1 / F.col("n_host")).alias("inv"), *(F.sum(f"{t}_host").alias(t) for t in TARGETS), *(F.sum(F.pow(F.col(f"{t}_host") / F.col("n_host"), 2)).alias(f"{t}2") for t in TARGETS), *(F.sum(F.col(f"{t}_host") / F.col("n_host")).alias(f"{t}m") for t in TARGETS)).first()
    prior, strength = {}, {}
    for t in TARGETS:
        k = max(moments["k"] or 0, 1)
        mean = (moments[t] or 0.0) / max(moments["n"] or 0, 1)
        spread = (moments[f"{t}2"] or 0.0) / k - ((moments[f"{t}m"] or 0.0) / k) ** 2
        between = spread - mean * (1 - mean) * (moments["inv"] or 0.0) / k
        prior[t] = mean
        strength[t] = float(np.clip(mean * (1 - mean) / between - 1, 10, 1e5)) if between > 0 else 1e5
    x = x.join(site.withColumnRenamed("host", "h").withColumnRenamed("path", "p"), (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")))
    out = {}
    for t in TARGETS:
        m = F.lit(strength[t])
        at_host = (F.col(f"{t}_host") - F.col(f"v_{t}") + m * prior[t]) / (F.col("n_host") - 1 + m)
        at_path = (F.col(f"{t}_path") - F.col(f"v_{t}") + m * at_host) / (F.col("n_path") - 1 + m)
        at_path = F.when(F.col("n_path") == F.col("n_host"), at_host).otherwise(at_path)
        out[f"p_{t}"] = 1 / (1 + F.exp(-(F.col(f"e_{t}") + _logit(at_path) - _logit(F.lit(prior[t])))))
    return x.withColumns(out).drop("h", "p", "n_path", "n_host", *(f"{t}_{level}" for t in TARGETS for level in ("path", "host")))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text_hash, source, p_low, p_toxic, keep`` for every row of ``docs`` (doc_id, text, source).

    Document evidence: words, prefixes and shapes that document counts over all labelled rows show
    to tell the labels apart, weighed by a sparse logistic regression on FITTED of them. One fold is
    left out and calibrates the sums into probabilities. Sites: the host is what stands
    before the first slash of ``source``, the path up to the second. Each level's rate is the mean
    over its documents (labels where there are any, else evidence), without the document itself,
    shrunk towards the level above: path to host, host to the mean of labels, by as many pseudo
    documents as the spread between hosts tells (moments). The posterior adds the log odds of the
    evidence and of the site against the global rate. A document is kept if neither is over a half.

    Null or empty text has only the shapes of an empty text. Null source is a site of its own.
    Documents with several label rows count with the largest of each label; a null label doesn't
    count. A target without labels of both kinds rejects nothing. Rows repeat as they come."""
    spark = docs.sparkSession
    bounded(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"))
    y = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("y_id")).agg(F.max("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    y, _ = materialize(y, "labels")
    n_labels = y.count()
    if n_labels <= BROADCAST_LABELS:
        y = F.broadcast(y)
    spare = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0
    with_labels = lambda x: x.join(y, F.col("doc_id") == F.col("y_id"))
    seen = with_labels(d.select("doc_id")).where(~spare).agg(F.count_if(F.expr("quality = 0")).alias("low1"), F.count_if(F.expr("quality = 1")).alias("low0"), F.count_if(F.expr("toxic = 1")).alias("toxic1"), F.count_if(F.expr("toxic = 0")).alias("toxic0")).first().asDict()
    parts = max(1, n_labels // 5000)
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = with_labels(d.select("doc_id", "text")).where(~spare).select("text", "quality", "toxic").mapInArrow(lambda it: _counted(it, parts), _BLOCK_DDL)
    found = blocks.repartition(min(tasks, parts), "part").sortWithinPartitions("part").mapInArrow(lambda it: _selected(it, seen), "target string, feature long, weight double, g2 double")
    found, at_found = materialize(found, "evidence")
    model = {}
    for t in TARGETS:
        rows = found.where(F.col("target") == t).orderBy(F.desc("g2"), "feature").limit(MOST).select("feature").toPandas()
        keys = np.unique(rows["feature"].to_numpy(np.int64).view(_U))
        model[t] = keys, np.zeros(len(keys) + 1)
    drop(spark, at_found)
    sent = spark.sparkContext.broadcast(model)
    some = with_labels(d.select("doc_id", "text")).where(~spare).select("text", "quality", "toxic", "doc_id")
    limit = int(1_000_000 * min(1.0, FITTED / max(sum(seen[c] for c in ("low1", "low0")), sum(seen[c] for c in ("toxic1", "toxic0")), 1)))
    some = some.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1_000_000)) < limit).select("text", "quality", "toxic")
    sample = some.mapInArrow(lambda it: _marked(it, sent), "quality int, toxic int, low_hits binary, toxic_hits binary")
    sample = sample.toPandas()
    sent.destroy()
    for t in TARGETS:
        keys, w = model[t]
        y_t = 1 - sample["quality"] if t == "low" else sample["toxic"]
        ok = y_t.notna().to_numpy()
        if len(keys) and ok.any():
            model[t] = keys, fit(sample.loc[ok, f"{t}_hits"].tolist(), y_t[ok].to_numpy(np.float64), len(keys))
        sample = sample.drop(columns=f"{t}_hits")
    sent = spark.sparkContext.broadcast(model)
    sums = d.withColumn("text_hash", F.xxhash64("text")).mapInArrow(lambda it: _weighed(it, sent), "doc_id long, text_hash long, source string, s_low double, s_toxic double")
    parts_of = F.split(F.coalesce("source", F.lit("")), "/")
    sums = sums.withColumns({"host": F.get(parts_of, F.lit(0)), "path": F.concat_ws("/", F.slice(parts_of, 1, 2))})
    x = sums.join(y, F.col("doc_id") == F.col("y_id"), "left").withColumns({"y_low": 1 - F.col("quality"), "y_toxic": F.col("toxic")}).drop("y_id", "quality", "toxic")
    x, _ = materialize(x, "sums")
    sent.destroy()
    for t in TARGETS:
        grade = F.round(F.greatest(F.lit(-200), F.least(F.lit(200), F.col(f"s_{t}"))) * 4).cast("int")
        cells = x.where(spare & F.col(f"y_{t}").isNotNull()).groupBy(grade.alias("g")).agg(F.sum(f"y_{t}").alias("pos"), F.count(F.lit(1)).alias("n")).toPandas()
        pos, n = cells["pos"].to_numpy(np.float64), cells["n"].to_numpy(np.float64)
        if not len(model[t][0]) or not 0 < pos.sum() < n.sum():
            x = x.withColumns({f"e_{t}": F.lit(-20.0), f"v_{t}": F.lit(0.0)})
            continue
        a, b = _logistic(cells["g"].to_numpy(np.float64) / 4, pos, n - pos)
        e = F.lit(a) * F.col(f"s_{t}") + F.lit(b)
        e = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), e))
        x = x.withColumns({f"e_{t}": e, f"v_{t}": F.coalesce(F.col(f"y_{t}").cast("double"), 1 / (1 + F.exp(-e)))})
    x = site_posteriors(x)
    return x.select("doc_id", "text_hash", "source", "p_low", "p_toxic", ((F.col("p_low") <= 0.5) & (F.col("p_toxic") <= 0.5)).alias("keep"))
