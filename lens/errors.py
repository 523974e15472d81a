"""Errors with an SQLSTATE, and Spark's run-time errors as such."""

from __future__ import annotations

SYNTAX, UNKNOWN_SOURCE, UNKNOWN_COLUMN, UNKNOWN_FUNCTION, TYPE_MISMATCH = "42601", "42P01", "42703", "42883", "42804"
UNSUPPORTED, DIVISION_BY_ZERO, OUT_OF_RANGE, LIMIT_EXCEEDED, TOO_DEEP, IO, CANCELLED, INTERNAL = "0A000", "22012", "22003", "54000", "54001", "58030", "57014", "XX000"


class EngineError(Exception):
    """state, message, detail, hint, and the 1-based byte position in the query text where one is known."""

    def __init__(self, state: str, message: str, detail: str | None = None, hint: str | None = None, position: int | None = None) -> None:
        super().__init__(f"{state}: {message}")
        self.state, self.message, self.detail, self.hint, self.position = state, message, detail, hint, position


_CONDITIONS = (
    (("DIVIDE_BY_ZERO", "REMAINDER_BY_ZERO"), DIVISION_BY_ZERO, "division by zero"),
    (("ARITHMETIC_OVERFLOW", "BINARY_ARITHMETIC_OVERFLOW", "CAST_OVERFLOW"), OUT_OF_RANGE, "number out of range"),
    (("CAST_INVALID_INPUT", "DATATYPE_MISMATCH", "USER_RAISED_EXCEPTION"), TYPE_MISMATCH, "a value doesn't have the type that is asked for"),
)


def translated(error: Exception) -> EngineError:
    """An error that Spark raised while it ran a query, in the engine's terms."""
    if isinstance(error, EngineError):
        return error
    condition = getattr(error, "getCondition", lambda: None)() or ""
    text = f"{condition} {error}"
    for names, state, message in _CONDITIONS:
        if any(condition.startswith(n) or f"[{n}" in text for n in names):
            return EngineError(state, message, detail=str(error).split("\n")[0][:300])
    if "cancelled" in text.lower() or "interrupted" in text.lower():
        return EngineError(CANCELLED, "the query was cancelled")
    return EngineError(INTERNAL, str(error).split("\n")[0][:500])
