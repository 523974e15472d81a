"""A page that lists queries as they end: server-sent events from a server's log."""

from __future__ import annotations

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

HEARTBEAT_SECONDS, POLL_SECONDS = 15, 0.2
PAGE = """<!doctype html><meta charset="utf-8"><title>lens</title>
<style>body{font:14px sans-serif;margin:2em}td,th{padding:.2em .8em;text-align:left;border-bottom:1px solid #ddd}code{white-space:pre-wrap}</style>
<h1>Queries</h1><table><thead><tr><th>at<th>query<th>rows<th>ms<th>status<th>detail<th>files</tr></thead><tbody id="log"></tbody></table>
<script>
new EventSource("events").onmessage = e => {
  const q = JSON.parse(e.data), row = document.getElementById("log").insertRow(0);
  for (const v of [new Date(q.at * 1000).toLocaleTimeString(), q.sql, q.rows, q.ms, q.status, q.detail, q.index]) row.insertCell().textContent = v;
};
</script>"""


class Dashboard(ThreadingHTTPServer):
    """Serves `log`, a list that grows, on host and port (0: any that is free): / is the page, /events the stream."""

    daemon_threads = True

    def __init__(self, log: list[dict], host: str = "127.0.0.1", port: int = 8080) -> None:
        self.log, self.closed = log, threading.Event()
        super().__init__((host, port), _Request)

    def started(self) -> Dashboard:
        threading.Thread(target=self.serve_forever, daemon=True).start()
        return self

    def shutdown(self) -> None:
        self.closed.set()
        super().shutdown()


class _Request(BaseHTTPRequestHandler):
    server: Dashboard

    def do_GET(self) -> None:
        if self.path == "/events":
            self._events()
        elif self.path == "/":
            self._head(200, "text/html; charset=utf-8")
            self.wfile.write(PAGE.encode())
        else:
            self._head(404, "text/plain")

    def _head(self, status: int, kind: str) -> None:
        self.send_response(status)
        self.send_header("Content-Type", kind)
        self.send_header("Cache-Control", "no-store")
        self.end_headers()

    def _events(self) -> None:
        self._head(200, "text/event-stream")
        sent, beat = 0, time.monotonic()
        try:
            while not self.server.closed.is_set():
                for event in self.server.log[sent:]:
                    self.wfile.write(f"data: {json.dumps(event)}\n\n".encode())
                    sent, beat = sent + 1, time.monotonic()
                if time.monotonic() - beat >= HEARTBEAT_SECONDS:
                    self.wfile.write(b": still here\n\n")
                    beat = time.monotonic()
                self.wfile.flush()
                self.server.closed.wait(POLL_SECONDS)
        except OSError:
            pass  # the reader is gone

    def log_message(self, *_: object) -> None:
        pass
