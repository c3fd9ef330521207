"""Bounded memory of Python workers: slices of batches by bytes, and release at the end of a task."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: bytes of an Arrow batch between the JVM and Python, and of text that is worked on at a time
BATCH_BYTES, SLICE_BYTES = 4 << 20, 2 << 20
#: glibc's M_MMAP_THRESHOLD and M_ARENA_MAX: larger arrays are given back as soon as they are free
_MMAP, _ARENAS, _LARGE = -3, -8, 1 << 20
_READY: list[bool] = []


def bounded(spark: SparkSession) -> None:
    """Let Arrow batches be BATCH_BYTES at most (for the session), so that long texts don't pile up."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library: nothing to set
        return None


def release() -> None:
    """Give free memory back to the system. Arrays go with their last reference, so no garbage is collected."""
    pa.default_memory_pool().release_unused()
    libc = _libc()
    if libc is not None:
        libc.malloc_trim(0)


def tidy(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """For generators over batches: a reused worker keeps nothing of a task but what it means to keep."""

    @functools.wraps(run)
    def tidied(*args, **kwargs):
        if not _READY:
            libc = _libc()
            if libc is not None:
                libc.mallopt(_MMAP, _LARGE)
                libc.mallopt(_ARENAS, 2)
            _READY.append(True)
        try:
            yield from run(*args, **kwargs)
        finally:
            release()

    return tidied


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 400, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and, but for a single longer text, SLICE_BYTES of ``column``."""
    for b in batches:
        ends = np.cumsum(np.asarray(pc.binary_length(b.column(column)).fill_null(0), dtype=np.int64))
        i = 0
        while i < b.num_rows:
            fits = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SLICE_BYTES, side="right"))
            j = min(i + rows, max(i + 1, fits), b.num_rows)
            yield b.slice(i, j - i)
            i = j
