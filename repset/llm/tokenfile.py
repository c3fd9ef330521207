"""Token ids in canonical, length-limited Huffman code, in files sorted by document."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repset.llm.hashing import hash_spans
from repset.llm.store import Store
from repset.llm.worker import SLICE_BYTES, bounded, pieces, tidy
from repset.session import drop, materialize, scratch

_U = np.uint64
LIMIT = 18
#: ids between two checkpoints
EVERY = 128
#: ids in a block, about; a document is never split
BLOCK = 1 << 20
#: ids that are packed at a time
AT_A_TIME = 1 << 15
#: bytes of text a file, about; more where that would give over MOST_FILES files
FILE_BYTES, MOST_FILES = 16 << 20, 100_000
#: rows looked at for each file, to find where files begin and end
PER_FILE = 64
#: bytes of pieces and ids that an encoder keeps
KEEP_BYTES = 32 << 20
#: bits of the number of places for pieces that are met often
SLOTS = 18
END = 0
#: stands for a document without id in the order of files
_NONE = -(1 << 63)
MAGIC = b"RSTOK1\n\0"
#: fixed values: the public pattern by which the byte-level tokenizer splits text before merging is
#: 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_PUBLIC = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: the characters that stand for bytes there: those that can be seen for themselves, the others from U+0100
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _SEEN} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SEEN)}
#: our splitting is done within these characters; a text with any other goes to the library whole
_PLAIN = regex.compile("[\x09\x0a\x0d\x20-\x7e\xa1-\u024f\u2010-\u2027\u2030-\u205e]")
_LETTER, _DIGIT, _SPACE, _OTHER = 1, 2, 3, 4
#: between these two characters, a blank and the word after it, a piece always begins
_CUT = re.compile(r"(?<=\S)(?= [A-Za-z])")


def _classes() -> np.ndarray:
    """Class of each character below U+2060; 0 for those that aren't plain."""
    out = np.zeros(0x2060, dtype=np.uint8)
    for c in map(chr, range(0x2060)):
        if _PLAIN.match(c):
            out[ord(c)] = _SPACE if c in "\t\n\r " else _LETTER if regex.match(r"\p{L}", c) else _DIGIT if regex.match(r"\p{N}", c) else _OTHER
    return out


def split(cp: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the pieces of texts that lie one after another in ``cp``; ``first``: where each begins."""
    n = len(cp)
    head = np.zeros(n + 1, dtype=bool)
    head[first] = True  # a text's first character, or the end
    prev = np.zeros(n, dtype=np.uint8)
    prev[1:] = kind[:-1]
    prev[head[:-1]] = 0
    follow = np.zeros(n, dtype=np.uint8)
    follow[:-1] = kind[1:]
    follow[head[1:]] = 0
    blank = cp == 32
    after_blank = np.zeros(n, dtype=bool)
    after_blank[1:] = blank[:-1]
    after_blank &= prev != 0
    space = kind == _SPACE
    # a run of one class, with the one blank before it; of white space, its last character stands apart
    start = np.where(space, (prev != _SPACE) | ((follow != _SPACE) & (follow != 0)), (kind != prev) & ~after_blank)
    at = np.flatnonzero((cp == 39) & start & (follow == _LETTER))
    if len(at):
        ends = np.append(first[1:], n)[np.searchsorted(first, at, side="right") - 1]
        for e in ENDINGS:
            fits = at[at + len(e) < ends]
            for k, ch in enumerate(e):
                fits = fits[cp[fits + 1 + k] == ord(ch)]
            start[fits + 1] = False
            fits = fits + len(e) + 1
            start[fits[fits < n]] = True
    start[first[first < n]] = True
    return np.flatnonzero(start)


class Encoder:
    """ids of texts by the ``tokenizers`` library, each distinct piece of text encoded once.

    Byte-level BPE merges only inside the pieces of its split pattern, so a text's ids are those of
    its pieces in a row. Texts are split and their pieces hashed (64 bits) a batch at a time in
    numpy; the library's model encodes the pieces not seen before. They are kept up to a bound, then anew; those met
    often have a place by the first bits of their hash, and only the others are sorted and searched for."""

    def __init__(self, path: str, keep: int = KEEP_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.size = self.tok.get_vocab_size()
        self.special = [str(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        if self.tok.normalizer is not None or json.loads(self.tok.pre_tokenizer.__getstate__()) != _PUBLIC:
            raise ValueError(f"{path} splits texts in another way")
        self.model = self.tok.model
        self.kind = _classes()
        self.keep = keep
        self._anew()

    def _anew(self) -> None:
        # sorted hashes of the pieces known, and where their ids begin and end
        self.keys, self.begin, self.end = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        # of each place the hash (at first one that belongs elsewhere), where its ids begin and how many
        self.slot, self.slot_begin, self.slot_n = np.full(1 << SLOTS, ~_U(0)), np.zeros(1 << SLOTS, np.int32), np.zeros(1 << SLOTS, np.int32)
        self.slot[-1] = 0

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        """Add pieces; ``hashes`` ascend."""
        text, flat, size, at = b"".join(pieces).decode("latin-1").translate(_BYTES), [], [], 0
        for p in pieces:
            got = self.model.tokenize(text[at : at + len(p)])
            flat += [t.id for t in got]
            size.append(len(got))
            at += len(p)
        flat, size = np.array(flat, dtype=np.uint32), np.array(size, dtype=np.int64)
        end = self.used + np.cumsum(size)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids) // 2, len(flat)), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        at = np.searchsorted(self.keys, hashes)
        self.keys = np.insert(self.keys, at, hashes)
        self.begin = np.insert(self.begin, at, (end - size).astype(np.int32))
        self.end = np.insert(self.end, at, end.astype(np.int32))

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, known)"""
        at = np.searchsorted(self.keys, hashes)
        known = np.zeros(len(hashes), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == hashes[inside]
        return at, known

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if 16 * len(self.keys) + 4 * self.used > self.keep:
            self._anew()
        cp = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
        ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
        first = np.append(0, ends[:-1]).astype(np.int64)
        kind = self.kind[np.minimum(cp, len(self.kind) - 1)]
        kind[cp >= len(self.kind)] = 0
        odd = np.zeros(len(texts), dtype=bool)
        odd[np.searchsorted(first, np.flatnonzero(kind == 0), side="right") - 1] = True
        out: list[np.ndarray | None] = [None] * len(texts)
        for i, t in enumerate(texts):
            if odd[i] or any(s in t for s in self.special):
                odd[i] = True
                out[i] = np.array(self.tok.encode(t, add_special_tokens=False).ids, dtype=np.uint32)
        plain = np.flatnonzero(~odd)
        if odd.any():
            texts = [texts[i] for i in plain]
            got = self(texts) if texts else []
            for i, x in zip(plain.tolist(), got, strict=True):
                out[i] = x
            return out
        raw = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
        begin = split(cp, kind, first)
        wide = np.cumsum(1 + (cp >= 0x80) + (cp >= 0x800), dtype=np.int64)
        byte = np.where(begin > 0, wide[begin - 1], 0)
        stop = np.append(byte[1:], len(raw))
        h = hash_spans(raw, byte, stop)
        place = (h >> _U(64 - SLOTS)).astype(np.int64)
        start, n = self.slot_begin[place].astype(np.int64), self.slot_n[place].astype(np.int64)
        rest = np.flatnonzero(self.slot[place] != h)
        if len(rest):
            distinct, at, inverse, times = np.unique(h[rest], return_index=True, return_inverse=True, return_counts=True)
            at = rest[at]
            where, known = self._find(distinct)
            new = np.flatnonzero(~known)
            if len(new):
                data = raw.tobytes()
                self._learn(distinct[new], [data[a:b] for a, b in zip(byte[at[new]].tolist(), stop[at[new]].tolist(), strict=True)])
                where, _ = self._find(distinct)
            begins, sizes = self.begin[where], (self.end - self.begin)[where]
            start[rest], n[rest] = begins[inverse], sizes[inverse]
            often = np.flatnonzero(times > 1)
            own = place[at[often]]
            self.slot[own] = distinct[often]
            won = self.slot[own] == distinct[often]  # of several of one place one
            self.slot_begin[own[won]], self.slot_n[own[won]] = begins[often[won]], sizes[often[won]]
        done = np.cumsum(n)
        flat = self.ids[np.repeat(start - (done - n), n) + np.arange(done[-1] if len(done) else 0)]
        pieces = np.searchsorted(begin, np.append(first, len(cp)))
        cut = np.concatenate([[0], done])[pieces].astype(np.int64)
        for i in range(len(texts)):
            out[i] = flat[cut[i] : cut[i + 1]]
        return out


_KEPT: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a Python worker: what a task has learned serves the next."""
    if path not in _KEPT:
        _KEPT[path] = Encoder(path)
    return _KEPT[path]


def _long(enc: Encoder, text: str, most: int = SLICE_BYTES // 8) -> np.ndarray:
    """ids of one text, encoded in stretches of about ``most`` characters that end where a piece does."""
    out, at = [], 0
    while at < len(text):
        cut = _CUT.search(text, at + most) if at + most < len(text) else None
        end = cut.start() if cut else len(text)
        out += enc([text[at:end]])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _parts(doc: np.ndarray, tie: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of ``bounds``, ascending rows of (doc_id, tie), are not above each (doc, tie)."""
    out = np.searchsorted(bounds[:, 0], doc, side="left")
    end = np.searchsorted(bounds[:, 0], doc, side="right")
    for i in np.flatnonzero(end > out):
        out[i] += np.searchsorted(bounds[out[i] : end[i], 1], tie[i], side="right")
    return out


@tidy
def _encoded(batches: Iterator[pa.RecordBatch], path: str, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(part, doc_id, tie, n, ids) of every row; at the end a row of counts without part."""
    enc = encoder(path)
    kind = np.dtype("<u2") if enc.size <= 1 << 16 else np.dtype("<u4")
    counts = np.zeros(enc.size, dtype=np.int64)
    rows = 0

    def batch(part: list, doc: pa.Array, tie: pa.Array, n: list, ids: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), doc, tie, pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["part", "doc_id", "tie", "n", "ids"])

    for b in pieces(batches, 800):
        doc, tie = b.column("doc_id"), b.column("tie")
        part = _parts(np.asarray(doc.fill_null(_NONE), dtype=np.int64), np.asarray(tie, dtype=np.int64), bounds)
        texts = [t or "" for t in b.column("text").to_pylist()]
        ids = [np.append(x, np.uint32(END)) for x in (enc(texts) if len(texts) > 1 else [_long(enc, texts[0])])]
        counts += np.bincount(np.concatenate(ids), minlength=enc.size)  # once a slice: each call makes an array of all ids' counts
        rows += len(ids)
        yield batch(part.tolist(), doc, tie, [len(x) for x in ids], [pa.compress(x.astype(kind).tobytes(), codec="zstd", asbytes=True) for x in ids])
    if rows:
        yield batch([None], pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), [0], [counts.astype("<i8").tobytes()])


@tidy
def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for x in b.column("ids").to_pylist():
            x = np.frombuffer(x, "<i8")
            total = x if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["ids"])


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for ids without a count."""
    used = np.flatnonzero(counts)
    n = len(used)
    if n > 1 << limit:
        raise ValueError("more ids than codes")
    out = np.zeros(len(counts), dtype=np.uint8)
    if n < 2:
        out[used] = 1
        return out
    used = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[used].astype(np.float64)
    row, leaves = leaf, []
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaf, pairs])
        order = np.argsort(both, kind="stable")
        row = both[order]
        leaves.append(np.cumsum(order < n))
    take, length = 2 * n - 2, np.zeros(n, dtype=np.uint8)
    for some in reversed(leaves):
        k = int(some[take - 1]) if take else 0
        length[:k] += 1
        take = 2 * (take - k)
    length[:take] += 1
    out[used] = length
    return out


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: ascending by (length, id)."""
    out = np.zeros(len(lengths), dtype=np.uint32)
    code, last = 0, 0
    used = np.flatnonzero(lengths)
    for i in used[np.argsort(lengths[used], kind="stable")].tolist():
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        out[i] = code
        code += 1
    return out


def pack(ids: np.ndarray, n: np.ndarray, code: np.ndarray, length: np.ndarray) -> list[tuple[bytes, np.ndarray]]:
    """(bits from the highest, bit length of each stretch of EVERY ids) of documents of ``n`` ids each, at least one,
    that lie one after another in ``ids``."""
    size = length[ids].astype(np.int64)
    end = np.cumsum(size)
    first = np.cumsum(n) - n
    total = np.add.reduceat(size, first)
    words = total + 63 >> 6
    base = np.cumsum(words) - words  # each document starts at a whole word
    own = end[first] - size[first]
    at = end - size + np.repeat(64 * base - own, n)
    word, room = at >> 6, 64 - (at & 63) - size
    c = code[ids].astype(_U)
    high = np.where(room >= 0, c << np.maximum(room, 0).astype(_U), c >> np.maximum(-room, 0).astype(_U))
    out = np.zeros(int(words.sum()) + 1, dtype=_U)
    cut = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[cut]] = np.bitwise_or.reduceat(high, cut)
    over = np.flatnonzero(room < 0)
    out[word[over] + 1] |= c[over] << (64 + room[over]).astype(_U)
    raw = out.byteswap().tobytes()
    stretches = -(-n // EVERY)
    begin = np.cumsum(stretches) - stretches
    last = np.minimum(np.repeat(first, stretches) + EVERY * (np.arange(int(stretches.sum())) - np.repeat(begin, stretches) + 1), np.repeat(first + n, stretches)) - 1
    before = np.concatenate([[0], end[last[:-1]]])
    before[begin] = own
    marks = (end[last] - before).astype("<u2")
    return [(raw[8 * w : 8 * w + (t + 7 >> 3)], marks[x : x + k]) for w, t, x, k in zip(base.tolist(), total.tolist(), begin.tolist(), stretches.tolist(), strict=True)]


def unpack(bits: np.ndarray, at: np.ndarray, n: np.ndarray, table: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Ids of all stretches, decoded side by side: ``at`` their first bits, ``n`` their ids."""
    padded = np.concatenate([bits, np.zeros(8, np.uint8)])
    view = np.ndarray(shape=(len(padded) - 7,), dtype=">u8", buffer=padded.data, strides=(1,))
    out = np.zeros((len(at), int(n.max(initial=0))), dtype=np.uint32)
    live = np.arange(len(at))
    pos = at.astype(np.int64).copy()
    by_n = np.argsort(-n, kind="stable")
    counts = n[by_n]
    pos = pos[by_n]
    alive = len(live)
    for k in range(out.shape[1]):
        while alive and counts[alive - 1] <= k:
            alive -= 1
        p = pos[:alive]
        window = (view[p >> 3].astype(_U) << (p & 7).astype(_U)) >> _U(64 - limit)
        hit = table[window.astype(np.int64)]
        out[by_n[:alive], k] = hit >> 5
        pos[:alive] = p + (hit & 31)
    return out[np.arange(out.shape[1]) < n[:, None]]


def decode_table(length: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """id * 32 + length for every ``limit`` leading bits."""
    table = np.zeros(1 << limit, dtype=np.int64)
    code = codes(length)
    for i in np.flatnonzero(length).tolist():
        free = limit - int(length[i])
        table[int(code[i]) << free : int(code[i]) + 1 << free] = i << 5 | int(length[i])
    return table


def block(docs: list[tuple[int | None, int, bytes, np.ndarray]]) -> bytes:
    """header | ids of documents | has id | ids each | bytes each | stretch bits | payload."""
    marks = np.concatenate([d[3] for d in docs])
    n = len(docs)
    body = [np.array([d[0] or 0 for d in docs], "<i8"), np.array([d[0] is not None for d in docs], np.uint8), np.array([d[1] for d in docs], "<i8"), np.array([len(d[2]) for d in docs], "<i8"), marks]
    raw = b"".join(x.tobytes() for x in body) + b"".join(d[2] for d in docs)
    return struct.pack("<QQQ", n, len(marks), len(raw)) + raw


def read_block(raw: bytes, n: int, n_marks: int, table: np.ndarray) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, ids each, all ids) of a block; any block decodes without the others."""
    at = 0

    def take(kind: str, k: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, k, at)
        at += out.nbytes
        return out

    doc, has, ids, size, marks = take("<i8", n), take("u1", n), take("<i8", n), take("<i8", n), take("<u2", n_marks)
    bits = np.frombuffer(raw, np.uint8, offset=at)
    stretches = -(-ids // EVERY)
    first = np.cumsum(stretches) - stretches
    ends = np.cumsum(marks.astype(np.int64))
    begin = ends - marks
    base = 8 * (np.cumsum(size) - size) - begin[first]  # each document starts at a whole byte
    start = begin + np.repeat(base, stretches)
    held = np.full(n_marks, EVERY, dtype=np.int64)
    held[first + stretches - 1] = ids - EVERY * (stretches - 1)
    return [int(d) if h else None for d, h in zip(doc, has, strict=True)], ids, unpack(bits, start, held, table)


@tidy
def _packed(batches: Iterator[pa.RecordBatch], length: np.ndarray) -> Iterator[pa.RecordBatch]:
    code = codes(length)
    kind = np.dtype("<u2") if len(length) <= 1 << 16 else np.dtype("<u4")
    for b in batches:
        bits, marks, crc = [], [], []
        n, packed = b.column("n").to_numpy(), b.column("ids")
        ends = np.cumsum(n)
        i = 0
        while i < len(n):  # documents of AT_A_TIME ids together, or one
            j = max(i + 1, int(np.searchsorted(ends, ends[i] - n[i] + AT_A_TIME, side="right")))
            ids = [np.frombuffer(pa.decompress(packed[k].as_py(), decompressed_size=int(n[k]) * kind.itemsize, codec="zstd", asbytes=True), kind) for k in range(i, j)]
            for p, m in pack(np.concatenate(ids), n[i:j], code, length):
                bits.append(p)
                marks.append(m.tobytes())
                crc.append(zlib.crc32(p))
            i = j
        yield pa.RecordBatch.from_arrays([b.column("part"), b.column("doc_id"), b.column("tie"), b.column("n"), pa.array(crc, pa.int64()), pa.array(bits, pa.binary()), pa.array(marks, pa.binary())], names=["part", "doc_id", "tie", "n", "crc", "bits", "marks"])


_MANIFEST = pa.schema([("part", pa.int32()), ("name", pa.string()), ("ids", pa.int64()), ("docs", pa.int64()), ("bytes", pa.int64())])


@tidy
def _files(batches: Iterator[pa.RecordBatch], uri: str) -> Iterator[pa.RecordBatch]:
    """Rows come by (part, doc_id): one file a part, blocks written as they fill."""
    store = Store(uri)
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "n", "bits", "marks")), strict=True))
    ahead = next(rows, None)
    while ahead is not None:
        part, total, docs = ahead[0], 0, 0

        def blocks() -> Iterator[bytes]:
            nonlocal ahead, total, docs
            yield MAGIC
            held, n = [], 0
            while ahead is not None and ahead[0] == part:
                held.append((ahead[1], ahead[2], ahead[3], np.frombuffer(ahead[4], "<u2")))
                n, total, docs = n + ahead[2], total + ahead[2], docs + 1
                ahead = next(rows, None)
                if n >= BLOCK:
                    yield block(held)
                    held, n = [], 0
            if held:
                yield block(held)

        name = f"part-{part:06d}.tok"
        size = store.put(name, blocks())
        yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "ids": total, "docs": docs, "bytes": size}], schema=_MANIFEST)


def _bounds(d: DataFrame, rows: int, parts: int) -> np.ndarray:
    """(doc_id, tie) where the files after the first begin, from a sample of some PER_FILE rows a file,
    chosen by hash. Rows with one id, or with none, are dealt over files by the hash of their text."""
    if parts < 2:
        return np.zeros((0, 2), np.int64)
    some = int(1_000_000 * min(1.0, PER_FILE * parts / max(rows, 1)))
    seen = d.where(F.pmod(F.xxhash64("doc_id", "tie", F.lit("bounds")), F.lit(1_000_000)) < some).select(F.coalesce("doc_id", F.lit(_NONE)).alias("d"), "tie").toPandas()
    seen = seen.sort_values(["d", "tie"]).to_numpy(np.int64)
    at = np.arange(1, parts) * len(seen) // parts
    return np.unique(seen[at], axis=0) if len(seen) else np.zeros((0, 2), np.int64)


def write_token_files(docs: DataFrame, uri: str, path: str) -> DataFrame:
    """Encode, count, code and write; returns the manifest (part, name, ids, docs, bytes), one row a file."""
    spark = docs.sparkSession
    Store(uri).create()
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, size = d.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    parts = min(max(1, -(-int(size or 0) // FILE_BYTES)), MOST_FILES)
    d = d.withColumn("tie", F.xxhash64("text"))
    bounds = _bounds(d, rows, parts)
    ids, at = materialize(d.mapInArrow(lambda it: _encoded(it, path, bounds), "part int, doc_id long, tie long, n long, ids binary"), "ids")
    total = ids.where("part IS NULL").select("ids").repartition(1, F.lit(0)).mapInArrow(_summed, "ids binary").first()
    counts = np.frombuffer(bytes(total["ids"]), "<i8") if total else np.zeros(1, np.int64)
    length = code_lengths(counts)
    Store(uri).put("codebook", [length.tobytes()])
    shuffled = ids.where("part IS NOT NULL").mapInArrow(lambda it: _packed(it, length), "part int, doc_id long, tie long, n long, crc long, bits binary, marks binary")
    n = max(1, min(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    shuffled = shuffled.repartition(n, "part").sortWithinPartitions("part", "doc_id", "tie", "n", "crc")
    manifest, _ = materialize(shuffled.mapInArrow(lambda it: _files(it, uri), "part int, name string, ids long, docs long, bytes long"), "manifest")
    drop(spark, at)
    return manifest


@tidy
def _decoded(batches: Iterator[pa.RecordBatch], uri: str) -> Iterator[pa.RecordBatch]:
    store = Store(uri)
    table = decode_table(np.frombuffer(store.get("codebook"), np.uint8))
    for b in batches:
        for name, start in zip(b.column("name").to_pylist(), b.column("start").to_pylist(), strict=True):
            with store.open(name) as f:
                if f.read(len(MAGIC)) != MAGIC:
                    raise ValueError(f"{name} isn't a token file")
                while head := f.read(24):
                    n, marks, size = struct.unpack("<QQQ", head)
                    doc, each, ids = read_block(f.read(size), n, marks, table)
                    ends = np.cumsum(each)
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), each.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start + ends - each, pa.int64()), pa.array(each, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    start += int(ends[-1])


def read_token_files(spark: SparkSession, uri: str, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files. Only the manifest, one row a file, goes through the global window."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("name", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))
    files = files.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "name")
    return files.mapInArrow(lambda it: _decoded(it, uri), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, uri: str | None = None) -> DataFrame:
    """Write the ids of all documents (doc_id, text) in ascending doc_id order and read the files back.

    Each text's ids are those of the tokenizer at ``path`` without special tokens, and an end id 0.
    Null text is empty: the end id alone. Documents without id come before all others; rows with
    equal ids are ordered by a hash of their text. A very long text is encoded in stretches. Other
    columns are left out. No rows give no files."""
    spark = docs.sparkSession
    bounded(spark)
    uri = uri or scratch(spark, "tokens")
    return read_token_files(spark, uri, write_token_files(docs, uri, path))
