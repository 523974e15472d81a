"""A log file as an endless source: lines as they are appended, from the start, through truncation and rotation."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, SimpleDataSourceStreamReader

from lens import errors as e
from lens.errors import EngineError

SCHEMA = "line string"
#: At most so many bytes of a file make one batch.
BATCH_BYTES = 16 << 20


def complete_lines(path: str, at: int, most: int = BATCH_BYTES) -> tuple[list[str], int]:
    """The whole lines from a place on, and where the next one begins; a last line without its end is held back."""
    with open(path, "rb") as f:
        f.seek(at)
        data = f.read(most)
        while (end := data.rfind(b"\n") + 1) == 0 and len(data) >= most:
            more = f.read(most)
            if not more:
                break
            data, most = data + more, len(data) + len(more)
    return [x.rstrip(b"\r").decode("utf-8") for x in data[:end].split(b"\n")[:-1]], at + end


def advanced(path: str, offset: dict) -> tuple[list[str], dict]:
    """What is new since an offset. A file that has become shorter, or another file under the name, is read from its start;
    one that is gone is waited for."""
    try:
        s = os.stat(path)
        at = offset["at"] if s.st_ino == offset["inode"] and s.st_size >= offset["at"] else 0
        lines, end = complete_lines(path, at)
    except FileNotFoundError:
        return [], offset
    return lines, {"inode": s.st_ino, "at": end}


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:
        return {"inode": -1, "at": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        lines, end = advanced(self.path, start)
        return iter([(x,) for x in lines]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        at = start["at"] if start["inode"] == end["inode"] and start["at"] <= end["at"] else 0
        try:
            lines, _ = complete_lines(self.path, at, max(1, end["at"] - at))
        except FileNotFoundError:
            lines = []
        return iter([(x,) for x in lines])


class _Once(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def read(self, partition) -> Iterator[tuple]:
        at = 0
        while True:
            lines, end = complete_lines(self.path, at)
            yield from ((x,) for x in lines)
            if end == at:
                return
            at = end


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lens_tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Once(self.options["path"])

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(self.options["path"])


def load(spark: SparkSession, path: str, once: bool = False) -> DataFrame:
    """A streaming DataFrame, or what the file holds now."""
    if not os.path.isfile(path):
        raise EngineError(e.IO, f"can't read {path}: there is no such file")
    spark.dataSource.register(TailSource)
    reader = spark.read if once else spark.readStream
    return reader.format("lens_tail").schema(SCHEMA).option("path", path).load()
