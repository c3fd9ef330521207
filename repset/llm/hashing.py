"""Vectorised tokens and 64-bit hashes over the buffers of Arrow string columns."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=_U)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, off, data = texts.buffers()
    off = np.frombuffer(off, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


#: bytes that end a word of ASCII letters and digits and of anything beyond ASCII
NO_WORD = np.ones(256, dtype=bool)
NO_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def tokens(texts: pa.Array, ends_word: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered: (bytes, starts, ends, first word of each row + total).

    With another ``ends_word``, runs of the bytes that it doesn't mark."""
    raw, off = buffers(texts)
    low = _LOWER[raw]
    word = ~ends_word[low]
    before = np.zeros(len(low) + 1, dtype=bool)
    before[1:] = word
    before[off] = False  # a row's first byte starts a word even where the last row ended in one
    after = np.zeros(len(low) + 1, dtype=bool)
    after[:-1] = word
    after[off] = False
    starts = np.flatnonzero(word & ~before[:-1])
    ends = np.flatnonzero(word & ~after[1:]) + 1
    return low, starts, ends, np.searchsorted(starts, off)


def hash_spans(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    eight = np.ndarray(shape=(len(low) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    size = ends - starts
    h = mix(size.astype(_U) + _U(0x9E3779B97F4A7C15))
    todo, at = np.flatnonzero(size <= 256), 0
    while len(todo):
        left = np.minimum(size[todo] - at, 8)
        part = eight[starts[todo] + at] & _KEEP[left]
        h[todo] = mix((h[todo] ^ part) * _U(0x9FB21C651E98DF25) + _U(at + 1))
        at += 8
        todo = todo[size[todo] > at]
    for i in np.flatnonzero(size > 256):
        h[i] = int.from_bytes(hashlib.blake2b(low[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


_STEP = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93)]


def _salt(k: int) -> np.uint64:
    return _U(int(_STEP[k % 4]) * (k + 1) % 2**64)


def shingles(words: np.ndarray, first: np.ndarray, size: int = 4) -> list[np.ndarray]:
    """For each row its sorted distinct hashes of ``size`` words in a row; all words as one if fewer."""
    out: list[np.ndarray] = []
    n = max(len(words) - size + 1, 0)
    rolled = np.zeros(n, dtype=_U)
    for k in range(size):
        rolled += mix(words[k : k + n] + _salt(k)) * _STEP[(k + 1) % 4]
    rolled = mix(rolled)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            h = _U(0)
            with np.errstate(over="ignore"):
                for k, w in enumerate(words[a:b]):
                    h = h + mix(np.array([w + _salt(k)]))[0] * _STEP[(k + 1) % 4]
                h = mix(np.array([h + _U(b - a) * _U(0xA24BAED4963EE407)]))
            out.append(h)
        else:
            out.append(words[:0])
    return out


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending 64-bit keys as compressed byte planes of their differences."""
    planes = np.diff(x.astype(_U), prepend=_U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()
    return struct.pack("<Q", len(x)) + pa.compress(planes, codec="zstd", asbytes=True)


def unpack_sorted(b: bytes) -> np.ndarray:
    n = struct.unpack("<Q", b[:8])[0]
    planes = np.frombuffer(pa.decompress(b[8:], decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel(), dtype=_U)


def edges(parts: int) -> np.ndarray:
    """Lower ends of ``parts`` equal ranges of 64-bit keys."""
    return np.array([(p << 64) // parts for p in range(parts)], dtype=_U)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of equal keys of sorted rows."""
    now, held = None, []
    for b in batches:
        for r in b.to_pylist():
            k = tuple(r[x] for x in keys)
            if k != now:
                if held:
                    yield now, held
                now, held = k, []
            held.append(r)
    if held:
        yield now, held
