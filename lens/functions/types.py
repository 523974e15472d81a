"""The seven types and what Spark types they are."""

from __future__ import annotations

from pyspark.sql import types as T

NUMERIC = ("integer", "real")
#: Spellings that CAST knows.
SPELLINGS = {word: kind for kind, words in {"text": "text varchar char string", "integer": "int integer int4 int8 bigint smallint", "real": "real float float8 double numeric decimal", "boolean": "bool boolean", "timestamp": "timestamp datetime"}.items() for word in words.split()}
SPARK = {"boolean": T.BooleanType(), "integer": T.LongType(), "real": T.DoubleType(), "text": T.StringType(), "blob": T.BinaryType(), "timestamp": T.TimestampNTZType(), "unknown": T.StringType()}


def kind_of(t: T.DataType) -> str:
    for kind, classes in (("boolean", T.BooleanType), ("integer", (T.ByteType, T.ShortType, T.IntegerType, T.LongType)), ("real", (T.FloatType, T.DoubleType, T.DecimalType)), ("text", (T.StringType, T.VarcharType, T.CharType)), ("blob", T.BinaryType), ("timestamp", (T.TimestampType, T.TimestampNTZType)), ("unknown", T.NullType)):
        if isinstance(t, classes):
            return kind
    return "other"


def comparable(a: str, b: str) -> bool:
    return "unknown" in (a, b) or a == b != "other" or a in NUMERIC and b in NUMERIC
