"""Messages of the PostgreSQL protocol, version 3, as bytes."""

from __future__ import annotations

import struct
from typing import BinaryIO

from lens import errors as e
from lens.errors import EngineError

# Fixed values of the protocol.
VERSION, CANCEL, SSL, GSS = 196608, 80877102, 80877103, 80877104
MOST_BYTES = 64 << 20
PARAMETERS = {"server_version": "16.0", "server_encoding": "UTF8", "client_encoding": "UTF8", "DateStyle": "ISO, MDY", "TimeZone": "UTC", "integer_datetimes": "on", "standard_conforming_strings": "on", "IntervalStyle": "postgres", "is_superuser": "off", "session_authorization": "lens", "application_name": ""}


def message(kind: str, body: bytes = b"") -> bytes:
    return kind.encode() + struct.pack("!i", len(body) + 4) + body


def text(value: str) -> bytes:
    return value.replace("\0", "").encode("utf-8", "replace") + b"\0"


def ready() -> bytes:
    return message("Z", b"I")


def greeting(pid: int, secret: int) -> bytes:
    """What follows a startup packet: no password is asked for."""
    told = b"".join(message("S", text(k) + text(v)) for k, v in PARAMETERS.items())
    return message("R", struct.pack("!i", 0)) + told + message("K", struct.pack("!ii", pid, secret)) + ready()


def description(columns: list[tuple[str, int, int]]) -> bytes:
    """columns: name, type, width."""
    body = b"".join(text(name) + struct.pack("!ihihih", 0, 0, oid, width, -1, 0) for name, oid, width in columns)
    return message("T", struct.pack("!h", len(columns)) + body)


def row(values: list[str | None]) -> bytes:
    parts = [struct.pack("!i", -1) if v is None else struct.pack("!i", len(raw := v.encode("utf-8", "replace"))) + raw for v in values]
    return message("D", struct.pack("!h", len(values)) + b"".join(parts))


def complete(tag: str) -> bytes:
    return message("C", text(tag))


def empty() -> bytes:
    return message("I")


def error(x: EngineError) -> bytes:
    fields = [("S", "ERROR"), ("V", "ERROR"), ("C", x.state), ("M", x.message), ("D", x.detail), ("H", x.hint), ("P", x.position and str(x.position))]
    return message("E", b"".join(k.encode() + text(v) for k, v in fields if v) + b"\0")


def _exactly(source: BinaryIO, n: int) -> bytes:
    got = source.read(n)
    if len(got) < n:
        raise EOFError
    return got


def read_startup(source: BinaryIO) -> tuple[int, bytes]:
    """The code of a startup packet, and what follows it."""
    (size,) = struct.unpack("!i", _exactly(source, 4))
    if not 8 <= size <= 10_000:
        raise EngineError(e.SYNTAX, f"a startup packet can't have {size} bytes")
    (code,) = struct.unpack("!i", _exactly(source, 4))
    return code, _exactly(source, size - 8)


def read(source: BinaryIO) -> tuple[str, bytes]:
    """The kind of the next message, and its body."""
    kind = _exactly(source, 1).decode("latin-1")
    (size,) = struct.unpack("!i", _exactly(source, 4))
    if not 4 <= size <= MOST_BYTES:
        raise EngineError(e.LIMIT_EXCEEDED, f"a message can't have {size} bytes")
    return kind, _exactly(source, size - 4)
