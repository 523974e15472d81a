"""A server for the simple query protocol: each connection has a session, and rows go out as Spark makes them."""

from __future__ import annotations

import os
import secrets
import socketserver
import struct
import threading
import time
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.util import InheritableThread

from lens import errors as e
from lens.errors import EngineError, translated
from lens.plans.lexer import unsupported
from lens.session import Session, shown, wire_type
from lens.wire import messages as m

HANDSHAKE_SECONDS, FLUSH_SECONDS, FLUSH_BYTES = 10, 0.05, 1 << 16


class _Connection(socketserver.StreamRequestHandler):
    server: Server

    def handle(self) -> None:
        try:
            self._serve()
        except (EOFError, ConnectionError, TimeoutError):
            pass  # the client is gone, or never spoke
        except EngineError as x:
            self._send(m.error(x))

    def _send(self, data: bytes) -> None:
        self.wfile.write(data)
        self.wfile.flush()

    def _serve(self) -> None:
        self.connection.settimeout(HANDSHAKE_SECONDS)
        while True:
            code, body = m.read_startup(self.rfile)
            if code in (m.SSL, m.GSS):
                self._send(b"N")
            elif code == m.CANCEL:
                if len(body) == 8:
                    self.server.cancel(*struct.unpack("!ii", body))
                return
            elif code == m.VERSION:
                break
            else:
                raise unsupported(f"protocol {code >> 16}.{code & 0xFFFF}")
        self.connection.settimeout(None)
        session, key = self.server.opened()
        try:
            self._send(m.greeting(*key))
            self._queries(session)
        finally:
            session.cancel()
            self.server.sessions.pop(key, None)

    def _queries(self, session: Session) -> None:
        skipping = False  # after a message of the extended protocol, until the client asks to go on
        while True:
            kind, body = m.read(self.rfile)
            if kind == "X":
                return
            if kind == "S":
                skipping = False
                self._send(m.ready())
            elif kind == "Q" and not skipping:
                try:
                    self._answer(session, body.rstrip(b"\0").decode("utf-8", "replace"))
                except (BrokenPipeError, ConnectionResetError):
                    raise
                except Exception as x:  # noqa: BLE001  whatever it was, the connection goes on
                    self._send(m.error(translated(x)))
                self._send(m.ready())
            elif not skipping:
                skipping = True
                self._send(m.error(unsupported("the extended query protocol", hint="use simple queries")))

    def _answer(self, session: Session, text: str) -> None:
        found = session.open(text)
        if found is None:
            self._send(m.empty())
            return
        columns, rows, endless = found
        self._send(m.description([(name, *wire_type(kind)) for name, kind in columns]))
        waiting, last, count = bytearray(), time.monotonic(), 0
        try:
            for values in rows:
                waiting += m.row([shown(v) for v in values])
                count += 1
                if endless or len(waiting) >= FLUSH_BYTES or time.monotonic() - last >= FLUSH_SECONDS:
                    self._send(bytes(waiting))
                    waiting, last = bytearray(), time.monotonic()
        finally:
            rows.close()
            if waiting:
                self._send(bytes(waiting))
        self._send(m.complete(f"SELECT {count}"))


class Server(socketserver.ThreadingTCPServer):
    """Serves queries on host and port (0: any that is free) until shutdown(). `log` has an entry for each query."""

    allow_reuse_address = daemon_threads = True

    def __init__(self, spark: SparkSession, directory: str = ".", host: str = "127.0.0.1", port: int = 5432, cache: bool = True, **more) -> None:
        self.make: Callable[[], Session] = lambda: Session(spark, directory, cache, log=self.log, **more)
        self.log: list[dict] = []
        self.sessions: dict[tuple[int, int], Session] = {}
        super().__init__((host, port), _Connection)

    def process_request(self, request, address) -> None:
        InheritableThread(target=self.process_request_thread, args=(request, address), daemon=True).start()

    def opened(self) -> tuple[Session, tuple[int, int]]:
        session, key = self.make(), (os.getpid() & 0x7FFFFFFF, secrets.randbits(31))
        self.sessions[key] = session
        return session, key

    def cancel(self, pid: int, secret: int) -> None:
        if session := self.sessions.get((pid, secret)):
            session.cancel()

    def started(self) -> Server:
        threading.Thread(target=self.serve_forever, daemon=True).start()
        return self


def refused(x: OSError, host: str, port: int) -> EngineError:
    return EngineError(e.IO, f"can't listen on {host}:{port}: {x.strerror}")
