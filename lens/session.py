"""Sessions: query text in, DataFrames or results out."""

from __future__ import annotations

import datetime
import json
import queue
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lens import errors as e
from lens.errors import EngineError, translated
from lens.functions.types import kind_of
from lens.operators.lower import lower
from lens.plans import logical as L
from lens.plans.binder import bind
from lens.plans.lexer import unsupported
from lens.plans.parser import Explain, Select, ShowSources, parse
from lens.sources.catalog import CATALOGUE, Catalog

# Catalogue names of other servers that clients ask for, and wire types by name: (oid, width).
_FOREIGN = ("pg_catalog", "pg_class", "pg_namespace", "pg_attribute", "pg_database")
_WIRE = {"boolean": (16, 1), "integer": (20, 8), "real": (701, 8), "text": (25, -1), "blob": (17, -1), "timestamp": (1114, 8), "unknown": (25, -1), "other": (25, -1)}
LOG_CHARS = 300
#: Rows of an endless query that wait for their reader.
MOST_WAITING = 10_000


def wire_type(kind: str) -> tuple[int, int]:
    return _WIRE[kind]


def shown(value: Any) -> str | None:
    """A value as text, the way results print it."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "t" if value else "f"
    if isinstance(value, bytes | bytearray):
        return "\\x" + bytes(value).hex()
    if isinstance(value, datetime.datetime):
        return value.strftime("%Y-%m-%d %H:%M:%S")
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            return {"nan": "NaN", "inf": "Infinity", "-inf": "-Infinity"}[str(value)]
        return repr(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)
    return str(value)


@dataclass
class Result:
    columns: list[tuple[str, str]]
    rows: list[tuple]
    plan: list[str]
    tag: str
    truncated: bool = False
    micros: int = 0
    kind: str = "rows"

    def to_json(self) -> str:
        if self.kind == "empty":
            return json.dumps({"kind": "empty"})
        columns = [{"name": n, "type": t, "oid": _WIRE[t][0], "width": _WIRE[t][1]} for n, t in self.columns]
        return json.dumps({"kind": "rows", "columns": columns, "rows": [[shown(v) for v in r] for r in self.rows], "plan": self.plan, "tag": self.tag, "truncated": self.truncated, "micros": self.micros})


def _endless(plan: L.Plan) -> bool:
    return isinstance(plan, L.Scan) and plan.streaming or any(_endless(p) for p in plan.below)


def _followed(found: L.Plan) -> tuple[L.Plan, int | None]:
    """The plan of an endless query without its LIMIT, and the LIMIT, which ends it."""
    if not isinstance(found, L.Limit):
        return found, None
    if found.offset:
        raise unsupported("OFFSET over an endless source")
    return found.below[0], found.limit


def error_json(error: EngineError) -> str:
    return json.dumps({"kind": "error", "code": error.state, "message": error.message, "detail": error.detail, "hint": error.hint, "position": error.position})


@dataclass
class Session:
    """Queries run in a copy of the given Spark session, with the time zone (UTC) and the ANSI arithmetic that the dialect's
    rules stand on; the session that was given keeps its settings.

    tables: names for FROM, each a DataFrame or the path of Parquet files. log has an entry for each query that run() or
    follow() ended.
    """

    spark: SparkSession
    directory: str = "."
    cache: bool = True
    tables: dict[str, DataFrame | str] = field(default_factory=dict)
    tail_once: bool = False
    log: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.spark = SparkSession(self.spark.sparkContext, self.spark._jsparkSession.cloneSession())
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark.conf.set("spark.sql.ansi.enabled", "true")
        self.spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        self.catalog = Catalog(self.spark, self.directory, self.cache, self.tables, self.tail_once)
        self.running: dict[str, Any] = {}

    def plan(self, text: str) -> L.Plan | ShowSources | Explain | None:
        if word := next((w for w in _FOREIGN if w in text.lower()), None):
            raise unsupported(f"the system catalogue {word}", hint="SHOW SOURCES lists what can be queried")
        found = parse(text)
        return bind(found, self.catalog.resolve) if isinstance(found, Select) else found

    def sql(self, text: str) -> DataFrame | None:
        """The query as a DataFrame that hasn't run; None for an empty query."""
        return self._frame(self.plan(text))

    def _frame(self, found: L.Plan | ShowSources | Explain | None) -> DataFrame | None:
        if found is None:
            return None
        if isinstance(found, ShowSources):
            return self.spark.createDataFrame([*CATALOGUE], "source string, signature string, reads string")
        if isinstance(found, Explain):
            lines = bind(found.select, self.catalog.resolve).lines()
            return self.spark.createDataFrame([(x,) for x in lines], "`QUERY PLAN` string")
        try:
            return lower(found, self.spark)
        except EngineError:
            raise
        except Exception as x:
            raise translated(x) from x

    def explain(self, text: str, physical: bool = False) -> list[str]:
        found = self.plan(text)
        lines = found.lines() if isinstance(found, L.Plan) else []
        if physical and isinstance(found, L.Plan):
            lines += str(lower(found, self.spark)._jdf.queryExecution().toString()).splitlines()
        return lines

    def run(self, text: str, limit: int | None = None) -> Result:
        """All rows of a finite query, or the first `limit`, in memory. rows() is for results that are too large for that."""
        began, tag = time.time(), f"lens-{uuid.uuid4().hex}"
        try:
            found = self.plan(text)
            df = self._frame(found)
            if df is None:
                return Result([], [], [], "", kind="empty")
            if df.isStreaming:
                raise unsupported("run() for an endless source", hint="use follow()")
            with self._tagged(tag, df):
                rows = [tuple(r) for r in (df if limit is None else df.limit(limit + 1)).collect()]
            cut = limit is not None and len(rows) > limit
            rows = rows[:limit] if cut else rows
            out = Result(self.columns(df), rows, found.lines() if isinstance(found, L.Plan) else [], f"SELECT {len(rows)}", cut, int(1e6 * (time.time() - began)))
            self._note(text, len(rows), began, "ok", out.tag)
            return out
        except Exception as x:
            found = translated(x)
            self._note(text, 0, began, found.state, found.message)
            raise found from x

    def columns(self, df: DataFrame) -> list[tuple[str, str]]:
        return [(f.name, kind_of(f.dataType)) for f in df.schema]

    def open(self, text: str) -> tuple[list[tuple[str, str]], Iterator[tuple], bool] | None:
        """Columns, the rows as they come, and whether they may never end: of a finite query a partition at a time, of an
        endless one until it is cancelled. None for an empty query."""
        began = time.time()
        try:
            found = self.plan(text)
            df = self._frame(_followed(found)[0] if isinstance(found, L.Plan) and _endless(found) else found)
        except Exception as x:
            self._note(text, 0, began, (error := translated(x)).state, error.message)
            raise error from x
        if df is None:
            return None
        rows = self._follow(text, *_followed(found), df, None, lambda: False) if df.isStreaming else self._rows(text, df, began)
        return self.columns(df), rows, df.isStreaming

    def rows(self, text: str) -> Iterator[tuple]:
        """The rows of a finite query, one partition in memory at a time."""
        df = self.sql(text)
        if df is not None and df.isStreaming:
            raise unsupported("rows() for an endless source", hint="use follow()")
        return iter(()) if df is None else self._rows(text, df, time.time())

    def _rows(self, text: str, df: DataFrame, began: float) -> Iterator[tuple]:
        count, status, detail = 0, "ok", ""
        try:
            with self._tagged(f"lens-{uuid.uuid4().hex}", df):
                for row in df.toLocalIterator(prefetchPartitions=True):
                    count += 1
                    yield tuple(row)
        except Exception as x:
            status, detail = (error := translated(x)).state, error.message
            raise error from x
        finally:
            self._note(text, count, began, status, detail or f"SELECT {count}")

    @contextmanager
    def _tagged(self, tag: str, df: DataFrame) -> Iterator[None]:
        """What runs inside can be cancelled by its tag."""
        self.running[tag] = df
        self.spark.sparkContext.addJobTag(tag)
        try:
            yield
        finally:
            self.running.pop(tag, None)
            self.spark.sparkContext.removeJobTag(tag)

    def follow(self, text: str, seconds: float | None = None, stop: Callable[[], bool] = lambda: False) -> Iterator[tuple]:
        """Rows of an endless query as they come, until its LIMIT, `seconds` or `stop`."""
        found, limit = _followed(self.plan(text))
        df = lower(found, self.spark)
        if not df.isStreaming:
            raise unsupported("follow() for a finite query", hint="use run()")
        return self._follow(text, found, limit, df, seconds, stop)

    def _follow(self, text: str, _: L.Plan, limit: int | None, df: DataFrame, seconds: float | None, stop: Callable[[], bool]) -> Iterator[tuple]:
        began, count, ended, rows = time.time(), 0, threading.Event(), queue.Queue(MOST_WAITING)

        def put(batch: DataFrame, _: int) -> None:
            for row in batch.toLocalIterator():
                while not ended.is_set():  # a slow reader holds the stream back
                    try:
                        rows.put(tuple(row), timeout=0.1)
                        break
                    except queue.Full:
                        continue

        query = df.writeStream.outputMode("append").trigger(processingTime="100 milliseconds").foreachBatch(put).start()
        self.running[str(query.id)] = query
        try:
            while (limit is None or count < limit) and not stop() and (seconds is None or time.time() - began < seconds):
                try:
                    row = rows.get(timeout=0.02)
                except queue.Empty:
                    if not query.isActive:
                        if query.exception():
                            raise translated(query.exception()) from None
                        raise EngineError(e.CANCELLED, "the query was cancelled") from None
                    continue
                count += 1
                yield row
        finally:
            ended.set()
            query.stop()
            self.running.pop(str(query.id), None)
            self._note(text, count, began, "ok", f"SELECT {count}")

    def cancel(self) -> None:
        """Ends what this session runs; the session can be used again."""
        for key, what in list(self.running.items()):
            if hasattr(what, "isActive"):
                what.stop()
            else:
                self.spark.sparkContext.cancelJobsWithTag(key)

    def _note(self, text: str, rows: int, began: float, status: str, detail: str) -> None:
        cached = "cached" if self.catalog.hits else "indexed" if self.catalog.builds else ""
        self.log.append({"at": began, "sql": " ".join(text.split())[:LOG_CHARS], "rows": rows, "ms": int(1000 * (time.time() - began)), "status": status, "detail": detail, "index": cached})
