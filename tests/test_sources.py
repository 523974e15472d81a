"""CSV, SQLite, the filesystem and followed files."""

import os
import sqlite3

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, IsNull, LessThan

from lens import EngineError, Session
from lens.sources import sqlite
from lens.sources.csvx import header, records, schema_of
from lens.sources.files import extension
from lens.sources.sqlite import affinity
from lens.streaming.tail import advanced, complete_lines


def cells(text):
    return [[c for c, _ in r] for r in records(text)]


def test_csv_records():
    assert cells("a,b\n1,2") == [["a", "b"], ["1", "2"]] and cells("a\r\nb\rc\r\n") == [["a"], ["b\rc"]]
    assert cells('"x,\n""y"z,2\n') == [['x,\n"yz', "2"]] and cells("a\n\nb\n") == [["a"], [""], ["b"]] and cells("1,\n") == [["1", ""]] and cells("1,") == [["1", ""]]
    assert [q for _, q in next(records('"",a"b'))] == [True, False]
    assert header([("Name", False), ("", False), ("Name ", False)]) == ["name", "column2", "name_3"]


def test_csv_source(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿Id,Mixed,Q,Real,None\n1,5,"01",1,\n2,x,"","2.5",\n\n3,7,z,1e3, ,extra\n'.encode())
    assert schema_of(str(tmp_path / "a.csv")) == [("id", "integer"), ("mixed", "text"), ("q", "text"), ("real", "text"), ("none", "text")]
    s = Session(spark, str(tmp_path))
    assert s.run("SELECT id, mixed, q, none FROM csv('a.csv')").rows == [(1, "5", "01", None), (2, "x", "", None), (None, None, None, None), (3, "7", "z", None)]
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(EngineError) as x:
        s.run("SELECT * FROM csv('empty.csv')")
    assert x.value.state == "58030"


def test_sqlite(spark, tmp_path):
    with sqlite3.connect(tmp_path / "a.db") as db:
        db.executescript("CREATE TABLE t (id INTEGER PRIMARY KEY, s TEXT, x REAL, b BLOB, m, flag BOOLEAN); CREATE TABLE empty_table (a INTEGER, b TEXT); CREATE VIEW v AS SELECT 1; CREATE TABLE w (k TEXT PRIMARY KEY, n INT) WITHOUT ROWID")
        db.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?)", [(1, "é", 2, b"x", "text", 1), (5, None, -1.5, None, 7, 0), (9, "z", None, b"", b"\x01", None)])
        db.execute("INSERT INTO w VALUES ('a', 1)")
    db.close()
    s = Session(spark, str(tmp_path))
    assert s.run("SELECT id, s, x, b, m, flag FROM sqlite('a.db', 'T') ORDER BY id").rows == [(1, "é", 2.0, b"x", "text", 1.0), (5, None, -1.5, None, "7", 0.0), (9, "z", None, b"", "\\x01", None)]
    assert s.run("SELECT COUNT(*) FROM sqlite('a.db', 'empty_table')").rows == [(0,)] and s.run("SELECT n FROM sqlite('a.db', 'w')").rows == [(1,)]
    for text, state in (("sqlite('a.db', 'v')", "42P01"), ("sqlite('a.db')", "42601"), ("sqlite('no.db', 't')", "58030")):
        with pytest.raises(EngineError) as x:
            s.run(f"SELECT * FROM {text}")
        assert x.value.state == state
    (tmp_path / "text.db").write_text("not a database at all")
    with pytest.raises(EngineError, match="not a SQLite database"):
        s.run("SELECT * FROM sqlite('text.db', 't')")
    assert [affinity(d) for d in ("BIGINT", "VARCHAR(9)", "", "DOUBLE", "BOOLEAN", "FLOATING POINT")] == ["integer", "text", "blob", "real", "real", "integer"]


def test_files(spark, tmp_path):
    (tmp_path / "a.b/c").mkdir(parents=True)
    (tmp_path / "A.TXT").write_text("12345")
    (tmp_path / "a.b/c/x.rs").write_text("")
    os.symlink(tmp_path, tmp_path / "a.b/loop")
    s = Session(spark, str(tmp_path))
    assert sorted(s.run("SELECT name, ext, size, depth, is_dir FROM files WHERE NOT is_dir AND name <> 'loop'").rows) == [("A.TXT", "txt", 5, 0, False), ("x.rs", "rs", 0, 2, False)]
    assert s.run("SELECT COUNT(*) FROM files").rows == [(5,)] and s.catalog.hits == 3 - 1 and s.catalog.builds == 1 or s.catalog.hits >= 1
    s.catalog.forget()
    assert [extension(n) for n in ("a.RS", ".hidden", "foo.", "plain", "a.b.c")] == ["rs", None, "", None, "c"]


def test_tail_offsets(tmp_path):
    p = tmp_path / "log"
    p.write_bytes(b"a\r\nb\nhalf")
    lines, at = advanced(str(p), {"inode": -1, "at": 0})
    assert lines == ["a", "b"] and at["at"] == 5
    p.open("ab").write(b" line\n")
    lines, at = advanced(str(p), at)
    assert lines == ["half line"]
    p.write_bytes(b"new\n")
    assert advanced(str(p), at)[0] == ["new"]
    os.remove(p)
    assert advanced(str(p), at) == ([], at)
    p.write_bytes(b"x" * 100 + b"\n")
    assert complete_lines(str(p), 0, 10) == (["x" * 100], 101)


def test_follow(spark, tmp_path):
    (tmp_path / "log").write_text("ok\nERROR 1\nERROR 2\nERROR 3\n")
    s = Session(spark, str(tmp_path))
    assert list(s.follow("SELECT line FROM tail('log') WHERE line LIKE '%ERROR%' LIMIT 2", seconds=60)) == [("ERROR 1",), ("ERROR 2",)]
    for text in ("SELECT line FROM tail('log') ORDER BY line", "SELECT COUNT(*) FROM tail('log')"):
        with pytest.raises(EngineError) as x:
            list(s.follow(text, seconds=5))
        assert x.value.state == "0A000"


def test_sqlite_reads_what_is_asked_for(spark, tmp_path):
    with sqlite3.connect(tmp_path / "a.db") as db:
        db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, n REAL, mixed)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(k, k / 2 if k % 3 else None, k if k % 2 else str(k)) for k in range(1000)])
    db.close()
    r = sqlite._Reader(str(tmp_path / "a.db"), "t", ["id", "n", "mixed"], ["integer", "real", "text"], True)
    asked = [GreaterThanOrEqual(("id",), 249), LessThan(("id",), 255), IsNull(("n",)), EqualTo(("mixed",), "249")]
    assert r.pushFilters(asked) == asked and [x[0] for p in r.partitions() for x in r.read(p)] == [249, 252]  # texts are left to Spark
    s = Session(spark, str(tmp_path))
    assert s.run("SELECT id, mixed FROM sqlite('a.db', 't') WHERE id BETWEEN 249 AND 251 AND n IS NULL AND mixed = '249'").rows == [(249, "249")]
    assert s.run("SELECT COUNT(*) FROM sqlite('a.db', 't') WHERE id IN (5, 7, NULL) OR n > 499.0").rows == [(2,)]
    assert s.run("SELECT id FROM sqlite('a.db', 't') WHERE id = 7.0 AND n < 4").rows == [(7,)]


def test_endless_source_with_a_table(spark, tmp_path):
    (tmp_path / "x.log").write_text("b\na\nb\nc\nno end")
    (tmp_path / "o.csv").write_text("name,owner\na,ann\nb,bob\n")
    s = Session(spark, str(tmp_path))
    left = "SELECT t.line AS line, upper(o.owner) AS owner FROM tail('x.log') AS t LEFT JOIN csv('o.csv') AS o ON t.line = o.name LIMIT 4"
    assert sorted(s.follow(left, 60), key=repr) == [("a", "ANN"), ("b", "BOB"), ("b", "BOB"), ("c", None)]
    assert sorted(s.follow("SELECT DISTINCT line FROM tail('x.log') LIMIT 3", 60)) == [("a",), ("b",), ("c",)]
    for text in ("SELECT a.name AS n FROM csv('o.csv') AS a JOIN tail('x.log') AS t ON TRUE", "SELECT line FROM tail('x.log') ORDER BY line", "SELECT COUNT(*) AS n FROM tail('x.log')", "SELECT line FROM tail('x.log') OFFSET 1"):
        with pytest.raises(EngineError) as x:
            list(s.follow(text, 5))
        assert x.value.state == "0A000"


def test_broken_databases_are_refused_or_read(tmp_path):
    """Cut off anywhere, or with any page's bytes turned over, a database gives rows or an EngineError."""
    with sqlite3.connect(tmp_path / "a.db") as db:
        db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, s TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(k, "x" * (k * 37 % 5000)) for k in range(60)])
    db.close()
    whole = (tmp_path / "a.db").read_bytes()
    broken = [whole[:n] for n in (0, 1, 50, 99, 100, 101, 1000, 4095, 4096, 4097, 9000, len(whole) - 1)]
    broken += [whole[:at] + bytes(b ^ mask for b in whole[at : at + 40]) + whole[at + 40 :] for at in range(0, len(whole) - 40, len(whole) // 17) for mask in (0xFF, 0x01, 0x80, 0x55)]
    for k, raw in enumerate(broken):
        path = tmp_path / f"b{k}.db"
        path.write_bytes(raw)
        try:
            name, columns, rowids = sqlite.described(str(path), "t")
        except EngineError as x:
            assert x.state in ("58030", "42P01", "0A000")
            continue
        r = sqlite._Reader(str(path), name, [c for c, _, _ in columns], [kind for _, kind, _ in columns], rowids)
        try:
            assert all(len(row) == len(columns) for p in r.partitions() for row in r.read(p))
        except sqlite3.Error:
            pass  # of a page that only the rows lead to: Spark's error, which run() translates
