"""Files of our own formats in a folder that all executors share."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterable, Iterator

from pyarrow import fs as pafs


class Store:
    """A folder given by URI (file, s3, gs, hdfs, ...). A file appears whole or not at all: it is
    written under a name of its own and then moved, so a repeated task replaces it with the same."""

    def __init__(self, uri: str):
        self.uri = uri
        self._fs, self._root = pafs.FileSystem.from_uri(uri)

    def create(self) -> Store:
        self._fs.create_dir(self._root, recursive=True)
        return self

    def put(self, name: str, parts: Iterable[bytes]) -> int:
        tmp, n = f"{self._root}/_{uuid.uuid4().hex}.tmp", 0
        with self._fs.open_output_stream(tmp) as out:
            for x in parts:
                out.write(x)
                n += len(x)
        self._fs.move(tmp, f"{self._root}/{name}")
        return n

    @contextlib.contextmanager
    def writer(self, name: str) -> Iterator:
        """A stream to ``name``; the file appears when the block ends well."""
        tmp = f"{self._root}/_{uuid.uuid4().hex}.tmp"
        try:
            with self._fs.open_output_stream(tmp) as out:
                yield out
            self._fs.move(tmp, f"{self._root}/{name}")
        except BaseException:
            with contextlib.suppress(OSError):
                self._fs.delete_file(tmp)
            raise

    def read(self, name: str, at: int, size: int) -> bytes:
        """``size`` bytes of a file from ``at`` on."""
        with self._fs.open_input_file(f"{self._root}/{name}") as f:
            f.seek(at)
            return f.read(size)

    def open(self, name: str):
        return self._fs.open_input_stream(f"{self._root}/{name}", compression=None)

    def get(self, name: str) -> bytes:
        with self.open(name) as f:
            return f.read()
