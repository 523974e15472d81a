"""A read-only SQL inspection engine on Spark."""

from lens.errors import EngineError
from lens.session import Result, Session

__all__ = ["EngineError", "Result", "Session"]
