"""CSV files with a header row, read by the dialect's own rules."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

from lens import errors as e
from lens.errors import EngineError

MAX_BYTES = 512 << 20
Field = tuple[str, bool]  # text, whether it was quoted


def records(text: str) -> Iterator[list[Field]]:
    """Comma-separated records: a quote opens at the start of a field only and may hold commas and line ends; text behind
    the closing quote is appended; lines end in LF or CRLF; a blank line is a record of one empty field."""
    row: list[Field] = []
    at, n = 0, len(text)
    while at < n:
        quoted, field = False, ""
        if text[at] == '"':
            quoted, at = True, at + 1
            while at < n:
                end = text.find('"', at)
                if end < 0:
                    field, at = field + text[at:], n
                    break
                field, at = field + text[at:end], end + 1
                if text[at : at + 1] != '"':
                    break
                field, at = field + '"', at + 1
        m = _REST.match(text, at)
        rest, at = m[0], m.end()
        ended = at >= n or text[at] == "\n"
        if at < n and text[at] == "\n" and rest.endswith("\r"):
            rest = rest[:-1]
        row.append((field + rest, quoted))
        if ended:
            yield row
            row = []
            at += 1
        else:
            at += 1  # the comma
            if at >= n:
                yield [*row, ("", False)]
                row = []
    if row:
        yield row


_REST = re.compile(r"[^,\n]*")
_INTEGER, _REAL = re.compile(r"[+-]?[0-9]+"), re.compile(r"(?i)[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|[+-]?(inf|infinity|nan)")


def _text(path: str) -> str:
    try:
        if os.path.getsize(path) > MAX_BYTES:
            raise EngineError(e.LIMIT_EXCEEDED, f"{path} is larger than {MAX_BYTES >> 20} MiB")
        with open(path, "rb") as f:
            return f.read().decode("utf-8", "replace").removeprefix("﻿")
    except OSError as x:
        raise EngineError(e.IO, f"can't read {path}: {x.strerror}") from x


def header(row: list[Field]) -> list[str]:
    names: list[str] = []
    for k, (name, _) in enumerate(row, 1):
        name = name.strip().lower() or f"column{k}"
        names.append(f"{name}_{k}" if name in names else name)
    return names


def value(field: Field, kind: str) -> object:
    text, quoted = field
    if not quoted and not text.strip():
        return None
    try:
        return int(text.strip()) if kind == "integer" else float(text.strip()) if kind == "real" else text
    except ValueError:
        return text


def _fits(field: Field, kind: str) -> bool:
    text, quoted = field[0].strip(), field[1]
    if not quoted and not text:
        return True
    if quoted:
        return False
    return bool((_INTEGER if kind == "integer" else _REAL).fullmatch(text)) and (kind != "integer" or -(2**63) <= int(text) < 2**63)


def schema_of(path: str) -> list[tuple[str, str]]:
    """Column names and types. All rows are read, since a Spark column has one type: a column whose values are all integers is
    one of integers, integers with real numbers among them are real, and anything else, or quoted, makes it text."""
    rows = records(_text(path))
    first = next(rows, None)
    if first is None:
        raise EngineError(e.IO, f"{path} is empty: a header row is needed")
    names = header(first)
    kinds, seen = ["integer"] * len(names), [False] * len(names)
    for row in rows:
        for k, field in enumerate(row[: len(names)]):
            if field[1] or field[0].strip():
                seen[k] = True
                if kinds[k] == "integer" and not _fits(field, "integer"):
                    kinds[k] = "real"
                if kinds[k] == "real" and not _fits(field, "real"):
                    kinds[k] = "text"
    return [(n, kind if s else "text") for n, kind, s in zip(names, kinds, seen, strict=True)]


class _Reader(DataSourceReader):
    def __init__(self, path: str, kinds: list[str]) -> None:
        self.path, self.kinds = path, kinds

    def read(self, partition) -> Iterator[tuple]:
        rows = records(_text(self.path))
        next(rows, None)
        n = len(self.kinds)
        for row in rows:
            cells = [*row[:n], *[("", False)] * (n - len(row))]
            yield tuple(value(c, k) for c, k in zip(cells, self.kinds, strict=True))


_TYPES = {"integer": T.LongType(), "real": T.DoubleType(), "text": T.StringType()}


class CsvSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lens_csv"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, _TYPES[k]) for n, k in schema_of(self.options["path"])])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        back = {type(t): k for k, t in _TYPES.items()}
        return _Reader(self.options["path"], [back[type(f.dataType)] for f in schema])


def load(spark: SparkSession, path: str) -> DataFrame:
    fields = T.StructType([T.StructField(n, _TYPES[k]) for n, k in schema_of(path)])
    spark.dataSource.register(CsvSource)
    return spark.read.format("lens_csv").schema(fields).option("path", path).load()
