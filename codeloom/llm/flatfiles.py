"""Raw files in the shared folder, written and read by tasks.

Folders are Hadoop paths.  A local (or locally mounted) folder is opened and memory-mapped
directly; any other store is reached through ``pyarrow.fs`` with ranged reads.  A task gives
each file a name of its own, so an attempt that fails, or runs twice, never touches another
attempt's file; which files count is what the tasks' results say.
"""

from __future__ import annotations

import os
import re

import numpy as np

_LOCAL = re.compile(r"^(?:file:)?(?://)?(/.*)$")


def local_path(uri: str) -> str | None:
    """The path of a folder or file on a local file system, else None."""
    m = _LOCAL.match(uri)
    return "/" + m.group(1).lstrip("/") if m else None


def _store(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def create(uri: str):
    """A binary file opened for writing."""
    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    store, path = _store(uri)
    return store.open_output_stream(path)


class Flat:
    """A file of equal items: ``flat[a:b]`` is a numpy array, memory-mapped where the file is local."""

    def __init__(self, uri: str, dtype: str, items: int):
        self.dtype, self.items = np.dtype(dtype), items
        path = local_path(uri)
        if not items:
            self._read = lambda a, b: np.zeros(0, self.dtype)
        elif path is not None:
            mapped = np.memmap(path, dtype=self.dtype, mode="r", shape=(items,))
            self._read = lambda a, b: mapped[a:b]
        else:
            store, path = _store(uri)
            opened, width = store.open_input_file(path), self.dtype.itemsize
            self._read = lambda a, b: np.frombuffer(opened.read_at((b - a) * width, a * width), self.dtype)

    def __getitem__(self, part: slice) -> np.ndarray:
        return self._read(part.start or 0, self.items if part.stop is None else part.stop)


def write_text(spark, uri: str, text: str) -> None:
    """A small file, written by the driver through Hadoop's file system of the path."""
    path, conf = _hadoop(spark, uri)
    out = path.getFileSystem(conf).create(path, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def read_text(spark, uri: str) -> str:
    path, conf = _hadoop(spark, uri)
    stream = path.getFileSystem(conf).open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def delete_others(spark, folder: str, keep: set[str]) -> None:
    """Delete the folder's files that are not named in ``keep``."""
    path, conf = _hadoop(spark, folder)
    fs = path.getFileSystem(conf)
    if fs.exists(path):
        for status in fs.listStatus(path):
            if status.getPath().getName() not in keep:
                fs.delete(status.getPath(), False)


def _hadoop(spark, uri: str):
    return spark._jvm.org.apache.hadoop.fs.Path(uri), spark.sparkContext._jsc.hadoopConfiguration()
