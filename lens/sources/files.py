"""The filesystem as a table: a task for each directory below the root."""

from __future__ import annotations

import datetime
import os
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lens import errors as e
from lens.errors import EngineError

MAX_ENTRIES, MAX_DEPTH = 10_000_000, 256
SCHEMA = "path string, name string, ext string, size long, modified timestamp_ntz, is_dir boolean, depth long"
_EPOCH = datetime.datetime(1970, 1, 1)


def extension(name: str) -> str | None:
    """What is behind the last dot, in lower case; none for names without a dot or with one at the start only."""
    head, dot, tail = name.rpartition(".")
    return tail.lower() if dot and head else None


def row(path: str, name: str, depth: int) -> tuple | None:
    try:
        s = os.lstat(path)
    except OSError:
        return None
    try:
        modified = _EPOCH + datetime.timedelta(seconds=s.st_mtime_ns // 10**9)
    except OverflowError:
        modified = None
    return path, name, extension(name), s.st_size, modified, stat.S_ISDIR(s.st_mode), depth


def walk(path: str, depth: int) -> Iterator[tuple]:
    """Everything below a directory, each directory before what it holds. Symbolic links are listed, never followed;
    directories that can't be read have nothing in them."""
    waiting = [(path, depth)]
    while waiting:
        directory, level = waiting.pop()
        try:
            names = sorted(os.listdir(directory))
        except OSError:
            continue
        below = []
        for name in names:
            if found := row(full := os.path.join(directory, name), name, level):
                yield found
                if found[5] and level < MAX_DEPTH:
                    below.append((full, level + 1))
        waiting += reversed(below)


class _Part(InputPartition):
    def __init__(self, path: str, whole: bool) -> None:
        self.path, self.whole = path, whole


class _Reader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def partitions(self) -> list[_Part]:
        with os.scandir(self.root) as found:
            below = sorted(x.path for x in found if x.is_dir(follow_symlinks=False))
        return [_Part(self.root, False), *(_Part(p, True) for p in below)]

    def read(self, part: _Part) -> Iterator[tuple]:
        if part.whole:
            rows: Iterator[tuple] = walk(part.path, 1)
        else:
            rows = (r for n in sorted(os.listdir(part.path)) if (r := row(os.path.join(part.path, n), n, 0)))
        for k, r in enumerate(rows):
            if k >= MAX_ENTRIES:
                raise RuntimeError(f"more than {MAX_ENTRIES} entries below {part.path}")
            yield r


class FilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lens_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def load(spark: SparkSession, path: str) -> DataFrame:
    if not os.path.isdir(path):
        raise EngineError(e.IO, f"{path} is not a directory that can be read")
    spark.dataSource.register(FilesSource)
    return spark.read.format("lens_files").schema(SCHEMA).option("path", path).load()
