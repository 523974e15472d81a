"""Logical nodes: what a bound query does, bottom up, with Spark columns over unique internal names."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame


@dataclass
class Attribute:
    qualifier: str | None
    name: str
    type: str
    internal: str
    nan: bool = False


@dataclass
class Plan:
    below: tuple = ()

    label = ""

    def lines(self, depth: int = 0) -> list[str]:
        return ["  " * depth + self.label, *(x for p in self.below for x in p.lines(depth + 1))]


@dataclass
class Values(Plan):
    label = "Values (1 rows)"


@dataclass
class Scan(Plan):
    load: Callable[[], DataFrame] | None = None
    attributes: list[Attribute] | None = None
    qualifier: str = ""
    streaming: bool = False

    @property
    def label(self) -> str:
        return f"Scan on {self.qualifier}"


@dataclass
class Join(Plan):
    on: Column | None = None
    left: bool = False
    equi: bool = False

    @property
    def label(self) -> str:
        return f"{'Left' if self.left else 'Inner'} Join (nested loop)"


@dataclass
class Filter(Plan):
    condition: Column | None = None
    label = "Filter"


@dataclass
class Aggregate(Plan):
    keys: list[Column] | None = None
    calls: list[Column] | None = None

    @property
    def label(self) -> str:
        return f"Aggregate ({len(self.keys)} keys, {len(self.calls)} aggregates)"


@dataclass
class Sort(Plan):
    keys: list[tuple[Column, bool, bool]] | None = None  # descending, nulls first
    outputs: list[Column] | None = None  # of the projection above, if a DISTINCT is above that
    distinct: bool = False
    covered: list[int | None] | None = None  # the output that each key is, if one is

    @property
    def label(self) -> str:
        return f"Sort ({len(self.keys)} keys)"


@dataclass
class Project(Plan):
    columns: list[Column] | None = None
    names: list[str] | None = None

    @property
    def label(self) -> str:
        return f"Project ({len(self.columns)} columns)"


@dataclass
class Distinct(Plan):
    label = "Distinct"


@dataclass
class Limit(Plan):
    limit: int | None = None
    offset: int = 0

    @property
    def label(self) -> str:
        return "Limit" + (f" {self.limit}" if self.limit is not None else "") + (f" offset {self.offset}" if self.offset else "")
