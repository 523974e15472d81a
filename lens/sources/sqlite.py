"""Tables of SQLite database files, read through the standard library in ranges of rowids."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterable, Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNull, LessThan, LessThanOrEqual

from lens import errors as e
from lens.errors import EngineError

ROWS_A_PART = 250_000
_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
_TYPES = {"integer": T.LongType(), "real": T.DoubleType(), "text": T.StringType(), "blob": T.BinaryType()}
# The order in which parts of a declared type say its affinity, and the type that each advertises.
_AFFINITY = (("INT", "integer"), ("CHAR", "text"), ("CLOB", "text"), ("TEXT", "text"), ("BLOB", "blob"), ("REAL", "real"), ("FLOA", "real"), ("DOUB", "real"))


def affinity(declared: str) -> str:
    up = declared.upper()
    if not up.strip():
        return "blob"
    return next((kind for part, kind in _AFFINITY if part in up), "real")


def checked(path: str) -> None:
    """Refuses files that aren't databases, that use reserved bytes, or whose write-ahead log holds pages."""
    try:
        with open(path, "rb") as f:
            head = f.read(100)
    except OSError as x:
        raise EngineError(e.IO, f"can't read {path}: {x.strerror}") from x
    if len(head) < 100 or head[:16] != b"SQLite format 3\0":
        raise EngineError(e.IO, f"{path} is not a SQLite database")
    if head[20]:
        raise EngineError(e.UNSUPPORTED, "lens does not support databases with reserved bytes in their pages")
    wal = f"{path}-wal"
    if 2 in (head[18], head[19]) and os.path.exists(wal) and os.path.getsize(wal) > 32:
        raise EngineError(e.IO, f"{path} has a write-ahead log that isn't merged", "rows may be missing without it", "close the program that writes it, or run PRAGMA wal_checkpoint")


def connect(path: str) -> sqlite3.Connection:
    found = sqlite3.connect(f"file:{quote(os.path.abspath(path))}?mode=ro&immutable=1", uri=True)
    found.text_factory = lambda b: b.decode("utf-8", "replace")
    return found


def tables(path: str) -> list[str]:
    checked(path)
    try:
        with connect(path) as db:
            return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY name")]
    except sqlite3.Error as x:
        raise EngineError(e.IO, f"can't read {path}: {x}") from x


def _name(text: str) -> str:
    return '"' + text.replace('"', '""') + '"'


def described(path: str, table: str) -> tuple[str, list[tuple[str, str, bool]], bool]:
    """The table's name, its columns with types and whether they hold mixed types, and whether it has rowids.

    A column whose values all have the advertised type has that one; integers and real numbers together are real; any
    other mixture is text, since a Spark column has one type.
    """
    known = tables(path)
    name = next((t for t in known if t.lower() == table.lower()), None)
    if name is None:
        raise EngineError(e.UNKNOWN_SOURCE, f"there is no table {table} in {path}", hint="tables: " + ", ".join(known) if known else "the database has no tables")
    try:
        with connect(path) as db:
            if "virtual" in (db.execute("SELECT sql FROM sqlite_master WHERE name = ?", (name,)).fetchone()[0] or "").lower().split()[:2]:
                raise EngineError(e.UNSUPPORTED, "lens does not support virtual tables")
            columns = [(r[1], affinity(r[2])) for r in db.execute(f"PRAGMA table_xinfo({_name(name)})") if r[6] != 1]
            found = db.execute("SELECT " + ", ".join(f"group_concat(DISTINCT typeof({_name(c)}))" for c, _ in columns) + f" FROM {_name(name)}").fetchone()
            try:
                db.execute(f"SELECT rowid FROM {_name(name)} LIMIT 1")
                rowids = True
            except sqlite3.Error:
                rowids = False
    except sqlite3.Error as x:
        raise EngineError(e.IO, f"can't read {path}: {x}") from x
    out = []
    for (column, kind), types in zip(columns, found, strict=True):
        seen = set((types or "").split(",")) - {"null", ""}
        if seen <= {kind} or kind == "real" and seen <= {"integer", "real"}:
            out.append((column, kind, False))
        elif seen == {"integer", "real"} or seen == {"real"}:
            out.append((column, "real", False))
        else:
            out.append((column, next(iter(seen)) if len(seen) == 1 else "text", len(seen) > 1))
    return name, out, rowids


def _shown(value: object) -> object:
    if isinstance(value, bytes):
        return "\\x" + value.hex()
    return str(int(value)) if isinstance(value, float) and value.is_integer() and abs(value) < 1e15 else str(value)


class _Part(InputPartition):
    def __init__(self, low: int | None, high: int | None) -> None:
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str], kinds: list[str], rowids: bool) -> None:
        self.path, self.table, self.columns, self.kinds, self.rowids = path, table, columns, kinds, rowids
        self.conditions: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Conditions on numbers and texts also go to the database, which then reads fewer rows, by rowid or index where it can.
        Spark tests them again, so what the database finds in mixed columns never matters."""
        for f in filters:
            (name,) = f.attribute if len(f.attribute) == 1 else (None,)
            kind = dict(zip(self.columns, self.kinds, strict=True)).get(name)
            values = [*f.value] if isinstance(f, In) else [] if isinstance(f, IsNull) else [getattr(f, "value", None)]
            fits = {"integer": (int, float), "real": (int, float)}.get(kind, ())
            if isinstance(f, (*_SIGNS, In)) and name and values and all(isinstance(v, fits) and not isinstance(v, bool) and v == v for v in values):
                self.conditions.append((f"{_name(name)} IN ({', '.join('?' * len(values))})" if isinstance(f, In) else f"{_name(name)} {_SIGNS[type(f)]} ?", values))
            elif isinstance(f, IsNull) and name:
                self.conditions.append((f"{_name(name)} IS NULL", []))
        return filters

    def partitions(self) -> list[_Part]:
        if not self.rowids:
            return [_Part(None, None)]
        with connect(self.path) as db:
            low, high, n = db.execute(f"SELECT min(rowid), max(rowid), count(*) FROM {_name(self.table)}").fetchone()
        if not n:
            return [_Part(None, None)]
        parts = max(1, n // ROWS_A_PART)
        step = (high - low) // parts + 1
        return [_Part(low + k * step, low + (k + 1) * step) for k in range(parts)]

    def read(self, part: _Part) -> Iterator[tuple]:
        asked = [x for x, _ in self.conditions] + ([] if part.low is None else [f"rowid >= {part.low} AND rowid < {part.high}"])
        where = " WHERE " + " AND ".join(asked) if asked else ""
        with connect(self.path) as db:
            for row in db.execute(f"SELECT {', '.join(map(_name, self.columns))} FROM {_name(self.table)}{where}" + (" ORDER BY rowid" if self.rowids else ""), [v for _, values in self.conditions for v in values]):
                yield tuple(None if v is None else float(v) if k == "real" and isinstance(v, int) else _shown(v) if k == "text" and not isinstance(v, str) else v for v, k in zip(row, self.kinds, strict=True))


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lens_sqlite"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        back = {type(t): k for k, t in _TYPES.items()}
        return _Reader(self.options["path"], self.options["table"], [f.name for f in schema], [back[type(f.dataType)] for f in schema], self.options["rowids"] == "true")


def load(spark: SparkSession, path: str, table: str) -> DataFrame:
    name, columns, rowids = described(path, table)
    fields = T.StructType([T.StructField(c, _TYPES[kind]) for c, kind, _ in columns])
    spark.dataSource.register(SqliteSource)
    return spark.read.format("lens_sqlite").schema(fields).option("path", path).option("table", name).option("rowids", str(rowids).lower()).load()
