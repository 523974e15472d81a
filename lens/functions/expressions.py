"""Typed expressions as Spark columns, with this dialect's rules where they differ from Spark's."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lens import errors as e
from lens.errors import EngineError
from lens.functions.types import NUMERIC, SPARK, comparable

WHITE = r"\A\p{IsWhite_Space}+|\p{IsWhite_Space}+\z"


@dataclass(frozen=True)
class Typed:
    column: Column
    type: str
    nan: bool = False  # whether a value may be NaN, which compares as unknown


def null() -> Typed:
    return Typed(F.lit(None).cast("string"), "unknown")


def mismatch(message: str, position: int | None = None, hint: str | None = None) -> EngineError:
    return EngineError(e.TYPE_MISMATCH, message, hint=hint, position=position)


def instant(x: Typed) -> Column:
    return x.column.cast("timestamp")


def number(x: Typed, position: int | None = None) -> Column:
    """A number as it is, a timestamp as seconds."""
    if x.type == "timestamp":
        return instant(x).cast("double")
    if x.type not in (*NUMERIC, "unknown"):
        raise mismatch(f"{x.type} is not a number", position, "CAST it first")
    return x.column.cast("long") if x.type == "unknown" else x.column


def truth(x: Typed, position: int | None = None) -> Column:
    if x.type not in ("boolean", "unknown"):
        raise mismatch(f"a condition must be boolean, not {x.type}", position)
    return x.column.cast("boolean") if x.type == "unknown" else x.column


def _real_text(x: Column) -> Column:
    """The shortest digits that give the number back, never with an exponent."""
    text = x.cast("string")
    sign, digits = F.when(F.startswith(text, F.lit("-")), "-").otherwise(""), F.regexp_replace(F.regexp_replace(text, "E.*|-|\\.0E.*", ""), "[.]", "")
    mantissa = F.regexp_replace(F.regexp_replace(text, "E.*|^-", ""), "\\.0$", "")
    digits = F.replace(mantissa, F.lit("."), F.lit(""))
    power = F.regexp_extract(text, "E(-?[0-9]+)$", 1).try_cast("int")
    whole = F.when(F.length(digits) - 1 <= power, F.rpad(digits, power + 1, F.lit("0"))).otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.length(digits))))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    plain = F.regexp_replace(text, "\\.0$", "")
    special = F.when(F.isnan(x), "NaN").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    return F.when(special.isNotNull(), special).when(power.isNull(), plain).when(power >= 0, F.concat(sign, whole)).otherwise(F.concat(sign, small))


def time_text(at: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Years of more than four digits without a plus sign, and with a minus sign of three digits at least."""
    return F.regexp_replace(F.date_format(at, pattern), r"\A(?:[+]|(-)0(?=[0-9]{3}-))", "$1")


def text_of(x: Typed, position: int | None = None) -> Column:
    if x.type == "text" or x.type == "unknown":
        return x.column
    if x.type == "real":
        return _real_text(x.column)
    if x.type == "timestamp":
        return time_text(instant(x))
    if x.type in ("integer", "boolean"):
        return x.column.cast("string")
    raise mismatch(f"{x.type} has no text", position)


def compare(op: str, a: Typed, b: Typed, position: int | None = None) -> Typed:
    if not comparable(a.type, b.type):
        raise mismatch(f"can't compare {a.type} with {b.type}", position, "CAST one side to the type of the other")
    kind = b.type if a.type == "unknown" else a.type
    left, right = ((x.column.cast(SPARK[kind]) if x.type == "unknown" else instant(x) if x.type == "timestamp" else x.column) for x in (a, b))
    out = {"=": left == right, "<>": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]
    unknown = [F.isnan(x.column) for x in (a, b) if x.nan and x.type == "real"]
    if unknown:
        out = F.when(~(unknown[0] if len(unknown) == 1 else unknown[0] | unknown[1]), out)
    return Typed(out, "boolean")


def arithmetic(op: str, a: Typed, b: Typed, position: int | None = None) -> Typed:
    left, right = number(a, position), number(b, position)
    real = op == "/" or any(x.type in ("real", "timestamp") for x in (a, b))
    if real:
        left, right = left.cast("double"), right.cast("double")
    out = {"+": left + right, "-": left - right, "*": left * right, "/": left / right, "%": left % right}[op]
    return Typed(out, "real" if real else "integer", a.nan or b.nan)


def negated(x: Typed, position: int | None = None) -> Typed:
    if x.type not in (*NUMERIC, "unknown"):
        raise mismatch(f"can't negate {x.type}", position)
    return Typed(-number(x), "integer" if x.type == "unknown" else x.type, x.nan)


def like(x: Typed, pattern: Typed, position: int | None = None) -> Typed:
    for side in (x, pattern):
        if side.type not in ("text", "unknown"):
            raise mismatch(f"LIKE compares text, not {side.type}", position, "CAST it to text")
    return Typed(F.like(x.column, F.replace(pattern.column, F.lit("\\"), F.lit("\\\\"))), "boolean")


def common(parts: list[Typed], position: int | None = None) -> tuple[list[Column], str, bool]:
    """The parts with one type, for CASE and COALESCE."""
    kinds = {p.type for p in parts} - {"unknown"}
    if not kinds:
        return [p.column for p in parts], "unknown", False
    kind = "real" if kinds == {"integer", "real"} else next(iter(kinds))
    if len(kinds) > 1 and kind != "real":
        raise mismatch(f"the branches have types {' and '.join(sorted(kinds))}", position, "CAST them to one type")
    return [p.column.cast("double") if kind == "real" and p.type == "integer" else p.column.cast(SPARK[kind]) if p.type == "unknown" else p.column for p in parts], kind, any(p.nan for p in parts)


def _checked(good: Column, value: Column, what: str) -> Column:
    return F.when(good, value).otherwise(F.raise_error(F.lit(f"not {what}")).cast("string").cast(SPARK_NAMES[what]))


SPARK_NAMES = {"an integer": "long", "a number": "double", "a boolean": "boolean"}


def cast(x: Typed, to: str, position: int | None = None) -> Typed:
    if x.type == to:
        return x
    if x.type == "unknown":
        return Typed(F.lit(None).cast(SPARK[to]), to)
    refused = mismatch(f"can't cast {x.type} to {to}", position)
    if to == "text":
        return Typed(text_of(x, position), "text")
    if x.type == "text" and to != "timestamp":
        s = F.regexp_replace(x.column, WHITE, "")
        none = x.column.isNull()
        if to == "integer":
            return Typed(_checked(none | s.try_cast("long").isNotNull() & s.rlike(r"\A[+-]?[0-9]+\z"), s.try_cast("long"), "an integer"), to)
        if to == "real":
            finite = s.rlike(r"\A[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\z")
            named = F.lower(F.regexp_replace(s, r"\A[+]", ""))
            value = F.when(finite, s.try_cast("double")).when(named.isin("inf", "infinity"), F.lit(float("inf"))).when(named.isin("-inf", "-infinity"), F.lit(float("-inf"))).when(named.isin("nan", "-nan"), F.lit(float("nan")))
            return Typed(_checked(none | value.isNotNull(), value, "a number"), to, True)
        low = F.lower(s)
        value = F.when(low.isin("t", "true", "yes", "on", "1"), True).when(low.isin("f", "false", "no", "off", "0"), False)
        return Typed(_checked(none | value.isNotNull(), value, "a boolean"), to)
    if (x.type, to) == ("integer", "real") or (x.type, to) == ("boolean", "integer"):
        return Typed(x.column.cast(SPARK[to]), to)
    if (x.type, to) == ("integer", "boolean"):
        return Typed(x.column != 0, to)
    if (x.type, to) == ("integer", "timestamp"):
        return Typed(F.timestamp_seconds(x.column).cast("timestamp_ntz"), to)
    if (x.type, to) == ("real", "integer"):
        return Typed(x.column.cast("long"), to)
    if (x.type, to) == ("timestamp", "integer"):
        return Typed(F.floor(instant(x).cast("double")).cast("long"), to)
    raise refused
