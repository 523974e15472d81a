"""The thirteen scalar functions and five aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lens import errors as e
from lens.errors import EngineError
from lens.functions.expressions import WHITE, Typed, common, compare, instant, mismatch, number, text_of, time_text
from lens.functions.types import NUMERIC

#: name: fewest and most arguments
SCALARS = {"lower": (1, 1), "upper": (1, 1), "length": (1, 1), "substr": (2, 3), "trim": (1, 1), "replace": (3, 3), "abs": (1, 1), "round": (1, 2), "coalesce": (2, 99), "nullif": (2, 2), "typeof": (1, 1), "date": (1, 1), "datetime": (1, 1)}
AGGREGATES = ("count", "sum", "avg", "min", "max")


def unknown_function(name: str, position: int) -> EngineError:
    near = [f for f in (*SCALARS, *AGGREGATES) if f[:2] == name[:2]]
    return EngineError(e.UNKNOWN_FUNCTION, f"there is no function {name}", hint=f"did you mean {near[0]}?" if near else None, position=position)


def _whole(x: Typed, position: int) -> Column:
    """Rounded towards zero where it is a real number."""
    return number(x, position).cast("long")


def _substr(args: list[Typed], position: int) -> Column:
    s, start = text_of(args[0], position), _whole(args[1], position)
    if len(args) == 2:
        return F.substring(s, F.greatest(start, F.lit(1)).cast("int"), F.length(s))
    size = F.greatest(_whole(args[2], position) - F.greatest(1 - start, F.lit(0)), F.lit(0))
    return F.substring(s, F.greatest(start, F.lit(1)).cast("int"), F.least(size, F.lit(2**31 - 1)).cast("int"))


def _round(args: list[Typed], position: int) -> Typed:
    x = args[0]
    if x.type not in (*NUMERIC, "unknown"):
        raise mismatch(f"round() takes a number, not {x.type}", position)
    if len(args) == 1:
        return x if x.type == "integer" else Typed(F.round(number(x).cast("double")), "real", x.nan)
    digits = F.greatest(F.least(_whole(args[1], position), F.lit(15)), F.lit(-15))
    scale = F.pow(F.lit(10.0), digits.cast("double"))
    scaled = F.round(number(x).cast("double") * scale) / scale
    return Typed(scaled, "real", x.nan)


def scalar(name: str, args: list[Typed], position: int, literal_digits: int | None = None) -> Typed:
    least, most = SCALARS[name]
    if not least <= len(args) <= most:
        raise EngineError(e.SYNTAX, f"{name}() takes {least if least == most else f'{least} to {most}'} arguments, not {len(args)}", position=position)
    x = args[0]
    if name == "lower":
        return Typed(F.lower(text_of(x, position)), "text")
    if name == "upper":
        return Typed(F.upper(text_of(x, position)), "text")
    if name == "length":
        return Typed(F.length(text_of(x, position)).cast("long"), "integer")
    if name == "trim":
        return Typed(F.regexp_replace(text_of(x, position), WHITE, ""), "text")
    if name == "substr":
        return Typed(_substr(args, position), "text")
    if name == "replace":
        return Typed(F.replace(*(text_of(a, position) for a in args)), "text")
    if name == "abs":
        if x.type not in (*NUMERIC, "unknown"):
            raise mismatch(f"abs() takes a number, not {x.type}", position)
        return Typed(F.abs(number(x)), "integer" if x.type == "unknown" else x.type, x.nan)
    if name == "round":
        if x.type == "integer" and literal_digits is not None and literal_digits >= 0:
            return x
        return _round(args, position)
    if name == "coalesce":
        columns, kind, nan = common(args, position)
        return Typed(F.coalesce(*columns), kind, nan)
    if name == "nullif":
        same = compare("=", x, args[1], position).column
        return Typed(F.when(x.column.isNull() | args[1].column.isNull() | F.coalesce(same, F.lit(False)), None).otherwise(x.column), x.type, x.nan)
    if name == "typeof":
        return Typed(F.when(x.column.isNull(), "unknown").otherwise(F.lit(x.type)), "text")
    if x.type not in ("integer", "timestamp", "unknown"):
        raise mismatch(f"{name}() takes seconds or a timestamp, not {x.type}", position)
    at = instant(x) if x.type == "timestamp" else F.timestamp_seconds(number(x))
    return Typed(time_text(at, "yyyy-MM-dd") if name == "date" else time_text(at), "text")


def aggregate(name: str, x: Typed | None, distinct: bool, position: int) -> Typed:
    """x is None for COUNT(*)."""
    if x is None:
        return Typed(F.count(F.lit(1)), "integer")
    if name == "count":
        return Typed(F.count_distinct(x.column) if distinct else F.count(x.column), "integer")
    if name in ("sum", "avg"):
        if x.type not in (*NUMERIC, "unknown"):
            raise mismatch(f"{name.upper()} takes numbers, not {x.type}", position)
        values = number(x)
        if name == "sum":
            return Typed(F.sum_distinct(values) if distinct else F.sum(values), "integer" if x.type == "unknown" else x.type, x.nan)
        mean = F.sum_distinct(values.cast("double")) / F.nullif(F.count_distinct(values), F.lit(0)) if distinct else F.avg(values)
        return Typed(mean, "real", x.nan)
    if x.type == "other":
        raise mismatch(f"{name.upper()} can't order this type", position)
    return Typed(F.min(x.column) if name == "min" else F.max(x.column), x.type, x.nan)
