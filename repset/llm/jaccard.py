"""N-gram Jaccard join: single rare tokens and combinations of frequent ones as signatures, then verification.

Tokens are the 64-bit hashes of a document's distinct word shingles. All tokens have one global
order: by the number of distinct sets that hold them, counted over the whole corpus, then by hash.
A set of n tokens may miss at most e = n - ceil(n * t) tokens of a partner, so each set takes the
shortest prefix whose signatures can't all be lost to e missing tokens. A token that no other set
holds is lost from the start and needs no signature; rare tokens are signatures themselves, each
lost to one miss. Frequent tokens fall into groups by hash, and the signatures of a group of c
tokens are its pairs, all lost only to c - 1 misses, or its triples (c - 2) for the most frequent
tokens. Two sets within the threshold then share a signature: of the prefix that ends first, fewer
tokens are missing than it takes to lose all of its signatures, and what the partner has of it lies
inside the partner's longer prefix.

The number of groups depends on the size band of a set, so a set within reach of two bands takes
part in both; a long document needs about as many pairs as a short one needs tokens, never all
pairs of its frequent tokens. Whether there are triples depends on the band alone, so that two sets
that may be partners always agree.

Texts are scanned once. Those that may have partners are kept in compressed chunks, and a set that
occurs many times is worked on where it stands first.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repset.llm import hashing
from repset.llm.store import Store
from repset.llm.worker import bounded, pieces, tidy
from repset.operators.components import connected_components
from repset.session import drop, materialize, scratch

_U = np.uint64


@dataclass(frozen=True)
class Rule:
    """Sets are the distinct shingles of ``words`` words (fewer words are one); two sets link when
    100 * intersection >= ``percent`` * union."""

    words: int = 4
    percent: int = 85


#: sets that hold a token up to which it is a signature by itself; and from which signatures are triples.
#: Triples are some 2.5 times as many as pairs, so they are for tokens whose pairs meet often by chance
RARE, COMMON = 16, 1 << 16
#: triples are for sets whose size lies in this band (2^band tokens) or a higher one
TRIPLES = 5
#: bytes of text in a chunk; bytes of text whose tokens fall into one range of keys
CHUNK_BYTES, RANGE_BYTES = 8 << 20, 16 << 20
#: heads of buckets up to which they are broadcast (some 50 bytes each); beyond, joined by shuffle
BROADCAST_HEADS = 200_000
#: sets in a bucket up to which its remaining pairs are rows; larger buckets are compared in blocks of
#: about BLOCK sets
FEW, BLOCK = 24, 400


def _allowed(percent: int) -> str:
    """Size: the smaller set has enough tokens. Place: what two sets share lies before a shared token in
    both, is it, or lies behind it in both; that must reach the overlap that the sizes ask for."""
    return f"""100 * least(facts >> 32, facts1 >> 32) >= {percent} * greatest(facts >> 32, facts1 >> 32)
    AND (facts & 4294967295 = 0 OR facts1 & 4294967295 = 0 OR {100 + percent} * (least(facts & 4294967295, facts1 & 4294967295)
    + least((facts >> 32) - (facts & 4294967295), (facts1 >> 32) - (facts1 & 4294967295))) >= {percent} * ((facts >> 32) + (facts1 >> 32)))"""


def _sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    low, starts, ends, first = hashing.tokens(texts)
    return hashing.shingles(hashing.hash_spans(low, starts, ends), first, words)


def _identity(s: np.ndarray) -> int:
    """A signed 64-bit identity of a set; equal sets have equal identities."""
    if not len(s):
        return 0
    total = hashing.mix(s).sum(dtype=_U) ^ _U(len(s) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    return int(hashing.mix(np.array([total], dtype=_U)).view(np.int64)[0])


# -- texts in chunks ---------------------------------------------------------------------------

_FACTS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ident", pa.int64()), ("text_hash", pa.int64()), ("chunk", pa.int64()), ("pos", pa.int32()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64())])
_FACTS_DDL = "doc_id long, n long, ident long, text_hash long, chunk long, pos int, file string, at long, size long"


def _packed_texts(texts: list[bytes]) -> bytes:
    raw = np.append(0, np.cumsum([len(t) for t in texts])).astype("<i8").tobytes() + b"".join(texts)
    return struct.pack("<QQ", len(texts), len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked_texts(b: bytes) -> pa.Array:
    n, size = struct.unpack("<QQ", b[:16])
    raw = pa.decompress(b[16:], decompressed_size=size, codec="zstd")
    return pa.LargeStringArray.from_buffers(n, raw.slice(0, 8 * (n + 1)), raw.slice(8 * (n + 1)))


@tidy
def _stored(batches: Iterator[pa.RecordBatch], uri: str, words: int) -> Iterator[pa.RecordBatch]:
    """Per document its set's size and identity, and where its text stands if it may have a partner;
    at the end, the place of each chunk in the task's file."""
    from pyspark import TaskContext

    base, name = TaskContext.get().partitionId() << 24, f"texts-{uuid.uuid4().hex}"
    seen: set[int] = set()  # only saves space: what is stored twice is told apart later
    held: list[bytes] = []
    size, places = 0, []
    with Store(uri).writer(name) as out:

        def flush() -> None:
            b = _packed_texts(held)
            places.append((base | len(places), name, out.tell(), len(b)))
            out.write(b)
            held.clear()

        for b in pieces(batches):
            sets = _sets(b.column("text"), words)
            n, ident = [len(s) for s in sets], [_identity(s) for s in sets]
            chunk, pos = [None] * len(n), [None] * len(n)
            for i, (k, x, d) in enumerate(zip(n, ident, b.column("doc_id").to_pylist(), strict=True)):
                if k > 1 and d is not None and x not in seen:
                    if len(seen) < 200_000:
                        seen.add(x)
                    chunk[i], pos[i] = base | len(places), len(held)
                    held.append(b.column("text")[i].as_buffer().to_pybytes())
                    size += len(held[-1])
                    if size >= CHUNK_BYTES:
                        flush()
                        size = 0
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ident, pa.int64()), b.column("text_hash"), pa.array(chunk, pa.int64()), pa.array(pos, pa.int32()), pa.nulls(len(n), pa.string()), none, none], schema=_FACTS)
        if held:
            flush()
    if places:
        yield pa.RecordBatch.from_pylist([{"chunk": c, "file": f, "at": a, "size": k} for c, f, a, k in places], schema=_FACTS)


def _chunk(uri: str, rows: list[dict]) -> tuple[pa.Array, list[int]]:
    """Texts and identities of the rows of a chunk that have a place; one row tells where it stands."""
    rows = [r for r in rows if r["pos"] is not None or r["file"] is not None]
    where = next(r for r in rows if r["file"] is not None)
    mine = [r for r in rows if r["file"] is None]
    if not mine:
        return pa.array([], pa.large_string()), []
    texts = _unpacked_texts(Store(uri).read(where["file"], where["at"], where["size"]))
    return texts.take(pa.array([r["pos"] for r in mine], pa.int64())), [r["ident"] for r in mine]


@tidy
def _read(batches: Iterator[pa.RecordBatch], uri: str) -> Iterator[pa.RecordBatch]:
    """``ident, text`` of the rows of each chunk."""
    for _, rows in hashing.grouped(batches, ["chunk"]):
        texts, ident = _chunk(uri, rows)
        at = 0
        for b in pieces([pa.RecordBatch.from_arrays([texts], names=["text"])]) if ident else ():
            yield pa.RecordBatch.from_arrays([pa.array(ident[at : at + b.num_rows], pa.int64()), b.column("text").cast(pa.string())], names=["ident", "text"])
            at += b.num_rows


# -- counts of tokens --------------------------------------------------------------------------

#: counts and messages are by the first 48 bits of tokens
_CUT = _U(16)


def _code(count: np.ndarray) -> np.ndarray:
    """A count as a byte: itself below 128, then by eighths of octaves."""
    high = 128 + 8 * np.log2(np.maximum(count, 128) / 128)
    return np.where(count < 128, count, np.minimum(high, 255)).astype(np.uint8)


_ASK = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("times", pa.binary())])
_ASK_DDL = "part int, chunk long, keys binary, times binary"
_TELL = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("codes", pa.binary())])


def _z(x: np.ndarray) -> bytes:
    return struct.pack("<Q", x.nbytes) + pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _unz(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(b[8:], decompressed_size=struct.unpack("<Q", b[:8])[0], codec="zstd", asbytes=True), kind)


def _cuts(keys: np.ndarray, parts: int) -> list[int]:
    """Where the ranges of 48-bit keys begin and end."""
    return np.searchsorted(keys, hashing.edges(parts) >> _CUT).tolist() + [len(keys)]


@tidy
def _asked(batches: Iterator[pa.RecordBatch], uri: str, parts: int, words: int) -> Iterator[pa.RecordBatch]:
    """The distinct tokens of each chunk, by range, and in how many of its sets they are."""
    for (chunk,), rows in hashing.grouped(batches, ["chunk"]):
        texts, ident = _chunk(uri, rows)
        if not ident:
            continue
        keys, times = np.unique(np.concatenate(_sets(texts, words)) >> _CUT, return_counts=True)
        times, cut = np.minimum(times, 2**32 - 1).astype("<u4"), _cuts(keys, parts)
        yield pa.RecordBatch.from_pylist([{"part": p, "chunk": chunk, "keys": hashing.pack_sorted(keys[i:j]), "times": _z(times[i:j])} for p, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if i < j], schema=_ASK)


@tidy
def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by part: tell each chunk the counts of its tokens over the corpus."""
    for (part,), rows in hashing.grouped(batches, ["part"]):
        keys = [hashing.unpack_sorted(r["keys"]) for r in rows]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        code = _code(np.bincount(at, weights=np.concatenate([_unz(r["times"], "<u4") for r in rows])))[at]
        ends = np.cumsum([len(k) for k in keys])
        for r, k, e in zip(rows, keys, ends.tolist(), strict=True):
            yield pa.RecordBatch.from_pylist([{"chunk": r["chunk"], "part": part, "codes": _z(code[e - len(k) : e])}], schema=_TELL)


# -- signatures --------------------------------------------------------------------------------


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of n with any partner."""
    return (percent * n + 99) // 100


def _salt(k: int) -> np.uint64:
    return _U(k * 0x9E3779B97F4A7C15 % 2**64)


def _combined(tokens: np.ndarray, size: int, band: int, need: int) -> tuple[np.ndarray, int]:
    """Combinations of ``size`` of the first tokens, as many as it takes that ``need`` - 1 misses don't lose
    all of them, and how many misses do."""
    groups = max(1, (1 << band) // (4 if size == 2 else 16))
    g = (hashing.mix(tokens ^ _salt(2 * band + size)) % _U(groups)).astype(np.int64)
    by = np.argsort(g, kind="stable")
    begin = np.flatnonzero(np.diff(g[by], prepend=-1))
    nth = np.empty(len(g), dtype=np.int64)
    nth[by] = np.arange(len(g)) - np.repeat(begin, np.diff(np.append(begin, len(g))))
    gain = np.cumsum(nth >= size - 1)
    stop = min(int(np.searchsorted(gain, need)) + 1, len(g))
    part, g = tokens[:stop], g[:stop]
    by = np.lexsort((part, g))
    part, g = part[by], g[by]
    most, out = int(np.bincount(g).max()), []
    one, two, three = hashing.mix(part + _salt(2 * band + size)), hashing.mix(part ^ _salt(3)), hashing.mix(part ^ _salt(5))
    for i in range(1, most):
        same = np.flatnonzero(g[i:] == g[:-i])
        pair = hashing.mix(one[same] + two[same + i])
        if size == 2:
            out.append(pair)
            continue
        for j in range(i + 1, most):
            fits = same + j < len(g)
            fits[fits] = g[same[fits] + j] == g[same[fits]]
            out.append(hashing.mix(pair[fits] + three[same[fits] + j]))
    return np.concatenate(out) if out else part[:0], int(gain[stop - 1])


def signatures(s: np.ndarray, code: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of one set (two tokens or more) whose tokens have these counts, as bytes; of single
    tokens also the place in the order, else -1."""
    n = len(s)
    lose = n - needed(n, percent) + 1
    order = np.lexsort((s, code))
    s, code = s[order], code[order]
    alone, rare, common = np.searchsorted(code, [1, RARE, int(_code(np.array([COMMON]))[0]) - 1], side="right").tolist()
    few = min(rare, lose)  # if rare tokens suffice, they are the prefix; else all of them are in it
    out, place = [s[:0]], [np.zeros(0, np.int64)]
    for band in range(max(needed(n, percent), 2).bit_length() - 1, (100 * n // percent).bit_length()):
        out.append(hashing.mix(s[alone:few] + _salt(band)))
        place.append(np.arange(alone, max(few, alone)))
        need, middle = lose - few, common if band >= TRIPLES else n
        for size, i, j in ((2, rare, middle), (3, max(middle, rare), n)):
            if need > 0 and i < j:
                sig, gain = _combined(s[i:j], size, band, need)
                need -= gain
                out.append(sig)
                place.append(np.full(len(sig), -1))
    return np.concatenate(out), np.concatenate(place)


@tidy
def _signed(batches: Iterator[pa.RecordBatch], uri: str, parts: int, rule: Rule) -> Iterator[pa.RecordBatch]:
    """Rows come by chunk, with the counts of its tokens: store the signatures of its sets by the million;
    yield the distinct ones, by range, to ask which others have too."""
    from pyspark import TaskContext

    store, block = Store(uri), TaskContext.get().partitionId() << 24
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> pa.RecordBatch:
        sig, ident, facts = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        keys, inverse, times = np.unique(sig >> _CUT, return_inverse=True, return_counts=True)
        cols = [keys.astype("<u8"), inverse.astype("<u4"), sig.astype("<u8"), ident.astype("<i8"), facts.astype("<i8")]
        packed = [_z(x) for x in cols]
        store.put(f"sigs-{block}", [struct.pack("<5Q", *map(len, packed)), *packed])
        cut = _cuts(keys, parts)
        return pa.RecordBatch.from_pylist([{"part": p, "chunk": block, "keys": hashing.pack_sorted(keys[i:j]), "times": _z(np.minimum(times[i:j], 2).astype("<u4"))} for p, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if i < j], schema=_ASK)

    size = 0
    for _, rows in hashing.grouped(batches, ["chunk"]):
        codes = [_unz(r["codes"], "u1") for r in rows if r["codes"] is not None]
        if not codes:
            continue
        texts, idents = _chunk(uri, rows)
        sets = _sets(texts, rule.words)
        tokens = np.concatenate(sets)
        _, at = np.unique(tokens >> _CUT, return_inverse=True)
        code = np.concatenate(codes)[at]
        ends = np.cumsum([len(s) for s in sets])
        lone = np.add.reduceat(code <= 1, ends - [len(s) for s in sets])
        for s, i, e, k in zip(sets, idents, ends.tolist(), lone.tolist(), strict=True):
            if k > len(s) - needed(len(s), rule.percent):
                continue  # too many tokens that no other set has
            sig, place = signatures(s, code[e - len(s) : e], rule.percent)
            held.append((sig, np.full(len(sig), i), len(s) << 32 | place + 1))
            size += len(sig)
        if size >= 1_000_000:
            yield flush()
            size, block = 0, block + 1
    if size:
        yield flush()


@tidy
def _kept(batches: Iterator[pa.RecordBatch], uri: str, parts: int) -> Iterator[pa.RecordBatch]:
    """The stored signatures that more than one set has, or nearly only those."""
    store = Store(uri)
    for (block,), rows in hashing.grouped(batches, ["chunk"]):
        raw = store.get(f"sigs-{block}")
        ends = np.cumsum(struct.unpack("<5Q", raw[:40])) + 40
        keys, inverse, sig, ident, facts = (_unz(raw[a:b], t) for a, b, t in zip([40, *ends[:-1].tolist()], ends.tolist(), ("<u8", "<u4", "<i8", "<i8", "<i8"), strict=True))
        cut = _cuts(keys, parts)
        more = np.zeros(len(keys), dtype=bool)
        for r in rows:
            more[cut[r["part"]] : cut[r["part"] + 1]] = _unz(r["codes"], "u1") > 1
        keep = np.flatnonzero(more[inverse])
        for i in range(0, len(keep), 50_000):
            k = keep[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(sig[k]), pa.array(ident[k]), pa.array(facts[k])], names=["sig", "ident", "facts"])


class Corpus:
    """The distinct sets of two tokens or more of a table, and where their texts stand."""

    def __init__(self, docs: DataFrame, rule: Rule):
        spark = self.spark = docs.sparkSession
        self.rule, self.uri = rule, scratch(spark, "texts")
        self.tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        Store(self.uri).create()
        uri, words = self.uri, rule.words
        facts, self.at_facts = materialize(docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(lambda it: _stored(it, uri, words), _FACTS_DDL), "facts")
        self.rows = facts.where("file IS NULL").select("doc_id", "n", "ident", "text_hash")
        self.chunks = facts.where("file IS NOT NULL").select("chunk", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("long").alias("ident"), "file", "at", "size")
        first = facts.where("pos IS NOT NULL").groupBy("ident").agg(F.min(F.struct("chunk", "pos")).alias("x"))
        self.owned, self.at_owned = materialize(first.select("ident", "x.chunk", "x.pos"), "owned")

    def close(self) -> None:
        drop(self.spark, self.uri, self.at_owned)

    def listed(self, sets: DataFrame) -> DataFrame:
        """One row for each of ``sets`` (ident, chunk, pos), and one for each chunk."""
        return sets.selectExpr("chunk", "pos", "ident", "string(null) AS file", "bigint(null) AS at", "bigint(null) AS size").union(self.chunks)

    def texts(self, wanted: DataFrame) -> DataFrame:
        """``ident, text`` of the sets in ``wanted`` (ident)."""
        uri = self.uri
        need = self.listed(wanted.select("ident").distinct().join(self.owned, "ident").select("ident", "chunk", "pos"))
        return need.repartition(self.tasks, "chunk").sortWithinPartitions("chunk", "pos").mapInArrow(lambda it: _read(it, uri), "ident long, text string")

    def buckets(self) -> tuple[DataFrame, str]:
        """``sig, ident, facts`` of the signatures that more than one set has, or nearly only those.

        facts holds the set's size (high half) and the place of the token in the order, from 1, or 0.
        Counts of tokens, and then of signatures, are made by chunks asking ranges of keys, with their
        distinct keys as packed arrays and 48 bits of each, so that some 4 bytes a token are shuffled
        and no row, and a token that a third of all sets has is one key of each chunk."""
        uri, rule, tasks = self.uri, self.rule, self.tasks
        size = self.chunks.agg(F.sum("size")).first()[0] or 0
        parts = max(1, -(-3 * int(size) // RANGE_BYTES))  # texts are stored at a third of their size, about
        by_chunk = self.listed(self.owned.select("ident", "chunk", "pos"))
        asked = by_chunk.repartition(tasks, "chunk").sortWithinPartitions("chunk", "pos").mapInArrow(lambda it: _asked(it, uri, parts, rule.words), _ASK_DDL)
        told = asked.repartition(tasks, "part").sortWithinPartitions("part", "chunk").mapInArrow(_tallied, "chunk long, part int, codes binary")
        told, at_told = materialize(told, "told")
        both = by_chunk.selectExpr("*", "int(null) AS part", "binary(null) AS codes").unionByName(told, allowMissingColumns=True)
        asked = both.repartition(tasks, "chunk").sortWithinPartitions("chunk", "pos", "part").mapInArrow(lambda it: _signed(it, uri, parts, rule), _ASK_DDL)
        told = asked.repartition(tasks, "part").sortWithinPartitions("part", "chunk").mapInArrow(_tallied, "chunk long, part int, codes binary")
        out = materialize(told.repartition(tasks, "chunk").sortWithinPartitions("chunk", "part").mapInArrow(lambda it: _kept(it, uri, parts), "sig long, ident long, facts long"), "shared")
        drop(self.spark, at_told)
        return out


# -- verification ------------------------------------------------------------------------------


@tidy
def _verify(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Rows come by (leader, salt), the leader's own first: one set is held at a time."""
    lead, mine = None, None
    for b in pieces(batches):
        sets = _sets(b.column("text"), rule.words)
        src, dst = [], []
        for u, v, s in zip(b.column("leader").to_pylist(), b.column("ident").to_pylist(), sets, strict=True):
            if u == v:
                lead, mine = u, s
            elif u == lead:
                both = len(np.intersect1d(mine, s, assume_unique=True))
                if 100 * both >= rule.percent * (len(mine) + len(s) - both):
                    src.append(u)
                    dst.append(v)
        if src:
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])


def overlap(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as products of 0/1 matrices over some thousand tokens at a time."""
    out = np.zeros((len(a), len(b)), dtype=np.float64)
    both = [*a, *b]
    row = np.repeat(np.arange(len(both)), [len(s) for s in both])
    _, at, n = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    some = n[at] > 1
    row, at = row[some], at[some]
    _, at = np.unique(at, return_inverse=True)
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    last = int(at[-1]) + 1 if len(at) else 0
    for c in range(0, last, 4096):
        i, j = np.searchsorted(at, [c, c + 4096])
        m = np.zeros((len(both), 4096), dtype=np.float32)
        m[row[i:j], at[i:j] - c] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out


@tidy
def _compared(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Rows come by (grp, i, j): block i against block j of a group, pairs of one component left out."""
    for (_, i, j), rows in hashing.grouped(batches, ["grp", "i", "j"]):
        rows = list({r["ident"]: r for r in rows}.values())
        sets = _sets(pa.array([r["text"] for r in rows], pa.string()), rule.words)
        left = [k for k, r in enumerate(rows) if r["b"] == i]
        right = left if i == j else [k for k, r in enumerate(rows) if r["b"] == j]
        if not left or not right:
            continue
        both = overlap([sets[k] for k in left], [sets[k] for k in right])
        ident, comp = (np.array([r[c] for r in rows], dtype=np.int64) for c in ("ident", "component"))
        n = np.array([len(s) for s in sets])
        link = (100 * both >= rule.percent * (n[left][:, None] + n[right][None, :] - both)) & (comp[left][:, None] != comp[right][None, :])
        x, y = np.nonzero(link)
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(ident[left][x]), pa.array(ident[right][y])], names=["src", "dst"])


def _dense_links(corpus: Corpus, members: DataFrame) -> DataFrame:
    """Links between different components inside groups of sets (grp, ident, component).

    Each group is dealt in blocks by hash, and each pair of blocks is one unit of work: its texts
    come together once and are compared as matrices; only links become rows."""
    spark, rule = corpus.spark, corpus.rule
    blocks = members.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    m = members.join(blocks, "grp").withColumn("b", F.pmod(F.xxhash64("ident"), F.col("blocks")).cast("int"))
    m, at = materialize(m, "members")
    texts, at_texts = materialize(corpus.texts(m), "texts")
    m = m.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("grp", F.least("b", "x").alias("i"), F.greatest("b", "x").alias("j"), "b", "ident", "component")
    full = m.join(texts, "ident").repartition(corpus.tasks, "grp", "i", "j").sortWithinPartitions("grp", "i", "j", "ident")
    links, _ = materialize(full.select("grp", "i", "j", "b", "ident", "component", "text").mapInArrow(lambda it: _compared(it, rule), "src long, dst long").distinct(), "links")
    drop(spark, at, at_texts)
    return links


def _links(corpus: Corpus, pairs: DataFrame, salt_rows: int = 500) -> DataFrame:
    """Those of ``pairs`` (leader, ident) whose sets are within the threshold.

    Each leader's pairs are dealt over salts of about ``salt_rows``, so a leader with very many
    partners takes many tasks."""
    rule = corpus.rule
    heads = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / salt_rows).cast("int").alias("salts"))
    spread = pairs.join(heads, "leader").select("leader", "ident", F.pmod(F.xxhash64("ident"), F.col("salts")).cast("int").alias("salt"))
    own = heads.select("leader", F.col("leader").alias("ident"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    wanted, at = materialize(spread.union(own), "wanted")
    full = wanted.join(corpus.texts(wanted), "ident").repartition(corpus.tasks, "leader", "salt").sortWithinPartitions("leader", "salt", F.col("ident") != F.col("leader"))
    links, _ = materialize(full.select("leader", "ident", "text").mapInArrow(lambda it: _verify(it, rule), "src long, dst long").distinct(), "links")
    drop(corpus.spark, at)
    return links


def jaccard_components(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id`` for every row of ``docs`` (doc_id, text).

    A document's set is its distinct shingles (``rule``; A-Z lowered, split at ASCII white space).
    component_id is the smallest doc_id reachable by links. Null or wordless texts have empty sets
    and link with nothing, not even each other. Repeated rows each get a row. Null ids have their
    sets but take no part in links and get a null component. Other columns are left out. An empty
    table gives an empty result.

    Copies collapse first: equal sets are one class, and links are sought between classes only.
    In each bucket of a signature the smallest class is compared with all others, so a bucket of m
    costs m - 1 pairs; what thereby falls into one component needs no more comparisons. After a
    second such round, the pairs left between different components are compared: of small buckets
    as rows, and the sets of larger ones, grouped by the signatures they share, in blocks. Sets that
    are alike but not near enough to link can't be told apart more cheaply and exactly; such a group
    costs time by its square, and the shuffle of each text once a block."""
    return grouped(docs, rule).drop("group")


def grouped(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``jaccard_components`` and a ``group``, which differs between components that have the same
    smallest doc_id; null for what takes no part in links."""
    spark = docs.sparkSession
    bounded(spark)
    corpus = Corpus(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rule)
    allowed, rows = _allowed(rule.percent), corpus.rows
    buckets, at_buckets = corpus.buckets()

    def with_heads(members: DataFrame, heads: DataFrame) -> DataFrame:
        """Join on sig. A signature that very many sets share is then no key of a shuffle, unless there are
        too many heads to broadcast; those joins are for adaptive execution to split."""
        return members.join(F.broadcast(heads) if heads.count() <= BROADCAST_HEADS else heads, "sig")

    def against_leader(members: DataFrame, pick, component: str) -> tuple[DataFrame, str]:
        """Each bucket's members but its leader, with the leader; where that is all there is to compare
        in the bucket, only those that size and place allow to link with it."""
        head = members.groupBy("sig").agg(pick("facts", "ident").alias("facts1"), pick(component, "ident").alias("c1"), pick("ident", "ident").alias("leader"), F.count(F.lit(1)).alias("k")).where("k > 1")
        head, at_head = materialize(head, "heads")
        found = with_heads(members, head).where("ident <> leader").withColumn("ask", F.expr(f"{component} <> c1 AND {allowed}"))
        out = materialize(found.where("ask OR k > 2").select("sig", "ident", "facts", "leader", "ask", "k"), "against")
        drop(spark, at_head)
        return out

    labels, at_labels, links, left, at_against = None, None, None, buckets, at_buckets
    for pick in (F.min_by, F.max_by, None):
        if labels is not None:  # what a bucket has left: members in more than one component
            b = left.join(labels, F.col("ident") == F.col("node"), "left").select("sig", "ident", "facts", F.coalesce("component", "ident").alias("component"))
            crossing, at_crossing = materialize(b.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("sig"), "crossing")
            left, at_left = materialize(with_heads(b, crossing).dropDuplicates(["sig", "ident"]), "open")
            drop(spark, at_against, at_crossing)
            if left.isEmpty():
                drop(spark, at_left)
                break
        if pick:
            found, at_new = against_leader(left, pick, "ident" if labels is None else "component")
            new_links = _links(corpus, found.where("ask").select("leader", "ident").distinct())
            left = found.where("k > 2").select("sig", "ident", "facts")  # the leader is done with
            if labels is None:
                drop(spark, at_buckets)
            at_against = at_new
        else:
            many = left.groupBy("sig").agg(F.count(F.lit(1)).alias("k"), F.min("ident").alias("first"))
            y = left.join(many.where(F.col("k") <= FEW).select("sig"), "sig")
            x = y.select("sig", *(F.col(a).alias(b) for a, b in (("ident", "leader"), ("facts", "facts1"), ("component", "c1"))))
            pairs = x.join(y, "sig").where("leader < ident AND c1 <> component").where(allowed).select("leader", "ident").distinct()
            near = left.join(many.where(F.col("k") > FEW).select("sig", "first"), "sig").select(F.col("first").alias("src"), F.col("ident").alias("dst")).distinct()
            grp = connected_components(near).select(F.col("node").alias("ident"), F.col("component").alias("grp"))
            members = left.select("ident", "component").distinct().join(grp, "ident")
            new_links = _links(corpus, pairs).union(_dense_links(corpus, members))
        if labels is not None:
            drop(spark, at_left, at_labels)
        links = new_links if links is None else links.union(new_links)
        labels, at_labels = materialize(connected_components(links), "labels")
    corpus.close()
    linked = rows.where("n > 0 AND doc_id IS NOT NULL").join(labels, F.col("ident") == F.col("node"), "left").select("doc_id", "ident", F.coalesce("component", "ident").alias("c"))
    low = linked.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    classes = linked.groupBy("ident").agg(F.first("c").alias("c")).join(low, "c").select(F.col("ident").alias("i"), "component_id", "c")
    out = rows.join(classes, (F.col("ident") == F.col("i")) & (F.col("n") > 0), "left")
    has_id = F.col("doc_id").isNotNull()
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(has_id, F.coalesce("component_id", "doc_id")).alias("component_id"), F.when(has_id, F.col("c")).alias("group"))


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + least(len(w), 4) - 1], ' ') AS g FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS p FROM d WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
 o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*)::BIGINT AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
 e AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
 r AS (SELECT x AS node, x AS seen FROM e UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.seen),
 c AS (SELECT node, min(seen) AS low FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.low, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id
"""
