"""What FROM can name."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from lens import errors as e
from lens.errors import EngineError
from lens.plans.lexer import unsupported
from lens.plans.parser import Source
from lens.sources import csvx, files, sqlite
from lens.streaming import tail

# Source, signature, what it reads.
CATALOGUE = (
    ("files", "files | files('path')", "the filesystem, walked recursively"),
    ("env", "env", "environment variables of the server process"),
    ("sqlite", "sqlite('file.db', 'table')", "a table in a SQLite database"),
    ("csv", "csv('file.csv')", "a CSV file with a header row"),
    ("tail", "tail('file.log')", "a log file, streamed as it grows"),
)


class Catalog:
    """Sources of a session, below its directory; files() keeps what it has read of a root for later queries."""

    def __init__(self, spark: SparkSession, directory: str = ".", cache: bool = True, tables: dict[str, DataFrame | str] | None = None, tail_once: bool = False) -> None:
        self.spark, self.directory, self.cache, self.tail_once = spark, directory, cache, tail_once
        self.tables = {k.lower(): v for k, v in (tables or {}).items()}
        self.walks: dict[str, DataFrame] = {}
        self.hits = self.builds = 0

    def _path(self, path: str) -> str:
        return path if "://" in path else os.path.join(self.directory, path)

    def resolve(self, source: Source) -> tuple[DataFrame, bool]:
        """The DataFrame, and whether real numbers in it may be NaN."""
        name, args = source.name, source.args
        count = -1 if args is None else len(args)

        def need(*counts: int) -> None:
            if count not in counts:
                shown = next((s for n, s, _ in CATALOGUE if n == name), f"{name}('path')")
                raise EngineError(e.SYNTAX, f"{name} is written {shown}", position=source.position)

        if args is None and name in self.tables:
            found = self.tables[name]
            return (self.spark.read.parquet(found) if isinstance(found, str) else found), False
        if name == "files":
            need(-1, 0, 1)
            return self._files(self._path(args[0]) if args else self.directory), False
        if name == "env":
            need(-1, 0)
            rows = [(k.encode("utf-8", "replace").decode(), v.encode("utf-8", "replace").decode()) for k, v in os.environ.items()]
            return self.spark.createDataFrame(rows, "name string, value string"), False
        if name == "csv":
            need(1)
            return csvx.load(self.spark, self._path(args[0])), True
        if name == "sqlite":
            need(1, 2)
            if count == 1:
                known = sqlite.tables(self._path(args[0]))
                raise EngineError(e.SYNTAX, "sqlite needs a table: sqlite('file.db', 'table')", "tables: " + ", ".join(known), position=source.position)
            return sqlite.load(self.spark, self._path(args[0]), args[1]), True
        if name == "tail":
            need(1)
            return tail.load(self.spark, self._path(args[0]), self.tail_once), False
        if name == "parquet":
            need(1)
            return self.spark.read.parquet(self._path(args[0])), False
        if name == "json":
            raise unsupported("json() as a source", source.position)
        raise EngineError(e.UNKNOWN_SOURCE, f"there is no source {name}", hint="sources: " + ", ".join(n for n, _, _ in CATALOGUE), position=source.position)

    def _files(self, root: str) -> DataFrame:
        if not self.cache:
            return files.load(self.spark, root)
        if root in self.walks:
            self.hits += 1
        else:
            self.walks[root] = files.load(self.spark, root).persist()
            self.builds += 1
        return self.walks[root]

    def forget(self) -> None:
        for df in self.walks.values():
            df.unpersist()
        self.walks.clear()
