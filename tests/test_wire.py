"""The front door, spoken to as a client speaks: bytes over a socket."""

import socket
import struct
import threading
import time
import urllib.request

import pytest

from lens.__main__ import answer, parser
from lens.session import Session
from lens.wire import messages as m
from lens.wire.dashboard import Dashboard
from lens.wire.server import Server


class Client:
    def __init__(self, address, code=m.VERSION, body=b"user\0me\0\0"):
        self.socket = socket.create_connection(address, timeout=60)
        self.source = self.socket.makefile("rb")
        self.socket.sendall(struct.pack("!ii", len(body) + 8, code) + body)

    def until_ready(self):
        out = []
        while not out or out[-1][0] != "Z":
            out.append(m.read(self.source))
        return out

    def ask(self, text):
        self.socket.sendall(m.message("Q", m.text(text)))
        return self.until_ready()


def values(body):
    (n,), at, out = struct.unpack_from("!h", body), 2, []
    for _ in range(n):
        (size,) = struct.unpack_from("!i", body, at)
        at += 4
        out.append(None if size < 0 else body[at : at + size].decode())
        at += max(0, size)
    return out


def fields(body):
    return {x[:1].decode(): x[1:].decode() for x in body.split(b"\0") if x}


@pytest.fixture(scope="module")
def server(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("served")
    (at / "a.csv").write_text("id,name,score\n1,one,1.5\n2,,2\n")
    (at / "x.log").write_text("a\nb\n")
    with Server(spark, str(at), port=0, tables={"numbers": spark.range(100_000)}) as s:
        yield s.started()
        s.shutdown()


def test_handshake_and_rows(server):
    c = Client(server.server_address, m.SSL, b"")
    assert c.source.read(1) == b"N"
    c.socket.sendall(struct.pack("!ii", 8, m.GSS))
    assert c.source.read(1) == b"N"
    c.socket.sendall(struct.pack("!ii", 9, m.VERSION) + b"\0")
    kinds = [k for k, _ in c.until_ready()]
    assert kinds[0] == "R" and kinds[-2:] == ["K", "Z"] and kinds.count("S") == len(m.PARAMETERS)
    got = c.ask("SELECT id, name, score, id > 1 AS big FROM csv('a.csv') ORDER BY id")
    assert [k for k, _ in got] == ["T", "D", "D", "C", "Z"] and got[3][1] == b"SELECT 2\0"
    assert [values(b) for k, b in got if k == "D"] == [["1", "one", "1.5", "f"], ["2", None, "2", "t"]]
    oids = [struct.unpack_from("!ihih", got[0][1], got[0][1].index(n) + len(n)) for n in (b"id\0", b"name\0", b"score\0", b"big\0")]
    assert [(x[2], x[3]) for x in oids] == [(20, 8), (25, -1), (701, 8), (16, 1)]
    assert [k for k, _ in c.ask(" -- nothing\n")] == ["I", "Z"]
    many = c.ask("SELECT id FROM numbers")
    assert len(many) == 100_003 and many[-2][1] == b"SELECT 100000\0"


def test_errors_keep_the_connection(server):
    c = Client(server.server_address)
    c.until_ready()
    got = c.ask("SELECT 1 FROM nowhere")
    assert [k for k, _ in got] == ["E", "Z"] and fields(got[0][1])["C"] == "42P01" and "P" in fields(got[0][1])
    late = c.ask("SELECT 10 / (id - 99999) FROM numbers")  # the error comes after rows
    assert late[0][0] == "T" and late[-2][0] == "E" and fields(late[-2][1])["C"] == "22012"
    c.socket.sendall(m.message("P", b"\0\0\0\0") + m.message("B", b"") + m.message("S"))
    got = c.until_ready()
    assert [k for k, _ in got] == ["E", "Z"] and fields(got[0][1])["C"] == "0A000"
    assert [k for k, _ in c.ask("SELECT 1")] == ["T", "D", "C", "Z"]
    assert m.read(Client(server.server_address, 131072).source)[0] == "E"


def test_cancel(server):
    c = Client(server.server_address)
    key = next(body for kind, body in c.until_ready() if kind == "K")
    c.socket.sendall(m.message("Q", m.text("SELECT line FROM tail('x.log')")))
    assert [m.read(c.source)[0] for _ in range(3)] == ["T", "D", "D"]  # and it goes on
    Client(server.server_address, m.CANCEL, struct.pack("!i", 1) + key[4:])  # another's key does nothing
    time.sleep(0.5)
    Client(server.server_address, m.CANCEL, key)
    got = c.until_ready()
    assert [k for k, _ in got] == ["E", "Z"] and fields(got[0][1])["C"] == "57014"
    assert [k for k, _ in c.ask("SELECT 1")] == ["T", "D", "C", "Z"]


def test_cancel_of_a_finite_query(spark):
    s, seen = Session(spark, tables={"n": spark.range(10**11)}), []
    t = threading.Thread(target=lambda: seen.append(pytest.raises(Exception, s.run, "SELECT COUNT(*) AS n FROM n WHERE id % 7 = 3 AND id * 3 % 11 = 2")))
    t.start()
    for _ in range(100):  # it may still be planning when it is first cancelled
        s.cancel()
        t.join(0.5)
    assert seen and seen[0].value.state == "57014" and s.run("SELECT 1 AS one").rows == [(1,)]


def test_dashboard(server):
    c = Client(server.server_address)
    c.until_ready()
    c.ask("SELECT   40 +\n 2 AS sum")
    with Dashboard(server.log, port=0) as d:
        d.started()
        base = "http://{}:{}".format(*d.server_address)
        assert b"EventSource" in urllib.request.urlopen(f"{base}/", timeout=10).read()
        with urllib.request.urlopen(f"{base}/events", timeout=10) as events:
            assert any(b'"SELECT 40 + 2 AS sum"' in events.readline() for _ in range(2 * len(server.log)))
        d.shutdown()


def test_command_line(spark, tmp_path, capsys):
    a = parser().parse_args(["-H", "0.0.0.0", "-p", "7", "--dashboard", "--dashboard-port", "8", "--no-cache", "here"])
    assert (a.host, a.port, a.dashboard, a.dashboard_port, a.no_cache, a.directory) == ("0.0.0.0", 7, True, 8, True, "here")
    with pytest.raises(SystemExit):
        parser().parse_args(["--unknown"])
    s = Session(spark, str(tmp_path))
    assert answer(s, "SELECT 1 AS a, NULL AS b", False) == 0 and capsys.readouterr().out == "a\tb\n1\t\nSELECT 1\n"
    assert answer(s, "SELECT 1 AS a", True) == 0 and '"rows": [["1"]]' in capsys.readouterr().out
    assert answer(s, "SELEC 1", False) == 1 and "42601" in capsys.readouterr().err


def test_settings_stay(spark):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        s = Session(spark)
        assert s.spark.conf.get("spark.sql.ansi.enabled") == "true" and spark.conf.get("spark.sql.ansi.enabled") == "false"
        assert list(s.rows("SELECT 7 / 2 AS h")) == [(3.5,)]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
