"""Files that tasks write and read in a store all executors share, and raw access to Arrow texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs

SLICE_BYTES = 1 << 19  # of text that is worked on at once
HELD: dict = {}  # what a worker keeps from one task to the next of a stage; tasks of other stages drop it


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder's address; a bare path and file: are the (shared) local file system."""
    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", uri)
    return fs.FileSystem.from_uri(uri)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; NULL is empty."""
    HELD.clear()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(rows: list[bytes], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes together; a longer text has a range of its own."""
    begin, size = 0, 0
    for i, text in enumerate(rows):
        if i > begin and size + len(text) > most:
            yield begin, i
            begin, size = i, 0
        size += len(text) + 1
    if rows:
        yield begin, len(rows)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = x ^ np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(n: int, salt: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), salt)
