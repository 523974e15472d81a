"""Results of whole queries, and errors."""

import pytest
from pyspark.sql import functions as F

from lens import EngineError, Session


@pytest.fixture(scope="module")
def session(spark):
    t = spark.createDataFrame([(1, "a", 1.5, True), (2, None, None, None), (3, "b%\\", float("nan"), False), (None, "a", -0.0, None)], "id long, s string, x double, b boolean")
    dup = spark.createDataFrame([(1, 10), (1, 20), (2, 30)], "k int, v int")
    return Session(spark, tables={"t": t, "dup": dup, "stamps": spark.range(3).select(F.timestamp_seconds(F.col("id") - 1).alias("ts"))})


def one(session, expression):
    return session.run(f"SELECT {expression} AS v").rows[0][0]


@pytest.mark.parametrize(
    ("expression", "value"),
    [
        ("7 / 2", 3.5), ("-7 % 3", -1), ("NULL + 1", None), ("1.5 || 'x'", "1.5x"), ("1e20 || ''", "100000000000000000000"), ("1.5e-7 || ''", "0.00000015"), ("12345678.5 || ''", "12345678.5"), ("2.0 || ''", "2"), ("TRUE || ''", "true"),
        ("NULL AND FALSE", False), ("NULL AND TRUE", None), ("NULL OR TRUE", True), ("NOT NULL", None), ("NULL IN (1)", None), ("1 IN (2, NULL)", None), ("1 IN (1, NULL)", True), ("1 NOT IN (2, NULL)", None),
        ("2 BETWEEN NULL AND 1", False), ("NULL BETWEEN 1 AND 2", None), ("'a_b' LIKE 'a\\_b'", False), ("'a\\b' LIKE 'a\\b'", True), ("'a\nb' LIKE 'a%b'", True), ("'é' LIKE '_'", True),
        ("substr('hello', 0, 2)", "h"), ("substr('hello', -1, 3)", "h"), ("substr('hello', -5, 2)", ""), ("substr('hello', 2)", "ello"), ("substr('hello', 2, 3)", "ell"), ("length('héllo')", 5), ("length(1.0)", 1),
        ("trim('　 x\t')", "x"), ("replace('aXa', '', 'y')", "aXa"), ("round(1.005, 2)", 1.0), ("round(-2.5)", -3.0), ("round(1234, -2)", 1200.0), ("round(7, 2)", 7), ("nullif(1, NULL)", None), ("nullif(1, 1)", None), ("nullif(1, 2)", 1),
        ("typeof(1)", "integer"), ("typeof(1.0)", "real"), ("typeof(NULL)", "unknown"), ("typeof('')", "text"), ("typeof(TRUE)", "boolean"), ("date(-1)", "1969-12-31"), ("datetime(0)", "1970-01-01 00:00:00"), ("upper('ß')", "SS"),
        ("CAST(' 12 ' AS int)", 12), ("CAST(-2.9 AS int)", -2), ("CAST('yes' AS bool)", True), ("CAST('OFF' AS bool)", False), ("CAST('inf' AS real) > 1", True), ("CAST(5 AS text)", "5"), ("CAST(NULL AS int)", None), ("typeof(-9223372036854775808)", "real"),
        ("CASE WHEN FALSE THEN 1 END", None), ("CASE WHEN NULL THEN 1 ELSE 2 END", 2), ("coalesce(NULL, 2, 3)", 2), ("abs(-3)", 3),
    ],
)
def test_values(session, expression, value):
    assert one(session, expression) == value


@pytest.mark.parametrize(
    ("seconds", "text"),
    [(253402300799, "9999-12-31 23:59:59"), (253402300800, "10000-01-01 00:00:00"), (518399999900, "18397-06-10 23:58:20"), (-62135596801, "0000-12-31 23:59:59"), (-62167219201, "-001-12-31 23:59:59"), (-99999999999, "-1199-02-15 14:13:21")],
)
def test_years_of_any_length(session, seconds, text):
    assert one(session, f"datetime({seconds})") == one(session, f"CAST(CAST({seconds} AS timestamp) AS text)") == text
    assert one(session, f"date({seconds})") == text.split()[0]


@pytest.mark.parametrize(
    ("text", "state"),
    [
        ("SELECT 1 / 0", "22012"), ("SELECT 1 % 0", "22012"), ("SELECT 9223372036854775807 + 1", "22003"), ("SELECT CAST('x' AS int)", "42804"), ("SELECT CAST('y' AS bool)", "42804"), ("SELECT CAST('1.0d' AS real)", "42804"), ("SELECT CAST(1e30 AS int)", "22003"),
        ("SELECT '5' = 5", "42804"), ("SELECT 1 WHERE 1", "42804"), ("SELECT CAST(1.5 AS bool)", "42804"), ("SELECT CAST('2020' AS timestamp)", "42804"), ("SELECT CAST(1 AS blob)", "42804"), ("SELECT -'a'", "42804"), ("SELECT 1 LIKE 'a'", "42804"),
        ("SELECT nope FROM t", "42703"), ("SELECT id FROM t AS a JOIN t AS b ON a.id = b.id", "42703"), ("SELECT t.id FROM t AS x", "42703"), ("SELECT s, COUNT(*) FROM t GROUP BY id", "42703"), ("SELECT x.id FROM t AS x GROUP BY id", "42703"), ("SELECT * FROM t GROUP BY id", "42703"),
        ("SELECT id FROM t WHERE COUNT(*) > 1", "42883"), ("SELECT nofn(1)", "42883"), ("SELECT SUM(COUNT(*)) FROM t", "0A000"), ("SELECT SUM(*) FROM t", "42601"), ("SELECT SUM(s) FROM t", "42804"), ("SELECT SUM(b) FROM t", "42804"), ("SELECT lower()", "42601"), ("SELECT lower(DISTINCT 'a')", "42601"),
        ("SELECT * FROM nowhere", "42P01"), ("SELECT * FROM json('x')", "0A000"), ("SELECT * FROM csv('missing.csv')", "58030"), ("SELECT * FROM files('/no/such/place')", "58030"), ("SELECT relname FROM pg_class", "0A000"), ("SELECT *", "42601"), ("SELECT date(1.5)", "42804"),
    ],
)
def test_errors(session, text, state):
    with pytest.raises(EngineError) as x:
        session.run(text)
    assert x.value.state == state


def test_grouping_and_order(session):
    assert session.run("SELECT s, COUNT(*) AS n FROM t GROUP BY s ORDER BY s").rows == [("a", 2), ("b%\\", 1), (None, 1)]
    assert session.run("SELECT id FROM t ORDER BY id DESC").rows == [(None,), (3,), (2,), (1,)]
    assert session.run("SELECT COUNT(*), COUNT(s), COUNT(DISTINCT s), SUM(id) FROM t").rows == [(4, 3, 2, 6)]
    assert session.run("SELECT COUNT(*) FROM t WHERE FALSE").rows == [(0,)] and session.run("SELECT s, COUNT(*) FROM t WHERE FALSE GROUP BY s").rows == []
    assert session.run("SELECT k + 1 AS a, k + 1 + SUM(v) AS b FROM dup GROUP BY k + 1 ORDER BY SUM(v) DESC").rows in ([(2, 32), (3, 33)], [(3, 33), (2, 32)])
    assert session.run("SELECT DISTINCT k FROM dup ORDER BY v DESC").rows == [(2,), (1,)]
    assert session.run("SELECT id FROM t ORDER BY id LIMIT 1 OFFSET 1").rows == [(2,)] and session.run("SELECT COUNT(DISTINCT *) AS n FROM t").rows == [(4,)]
    assert session.run("SELECT AVG(DISTINCT k) AS a FROM dup").rows == [(1.5,)] and session.run("SELECT 1 AS one GROUP BY 2").rows == [(1,)]


def test_joins(session):
    assert session.run("SELECT t.id, d.v FROM t LEFT JOIN dup AS d ON t.id = d.k ORDER BY t.id, d.v").rows == [(1, 10), (1, 20), (2, 30), (3, None), (None, None)]
    assert session.run("SELECT COUNT(*) FROM t AS a JOIN t AS b ON a.id = b.id").rows == [(3,)] and session.run("SELECT COUNT(*) FROM t AS a JOIN dup ON NULL").rows == [(0,)]
    assert session.run("SELECT * FROM dup AS a JOIN dup AS b ON a.v < b.v AND a.k = b.k").rows == [(1, 10, 1, 20)]


def test_timestamps(session):
    assert session.run("SELECT datetime(ts) AS d, ts - 1 AS s FROM stamps ORDER BY ts LIMIT 1").rows == [("1969-12-31 23:59:59", -2.0)]
    assert session.run("SELECT CAST(ts AS int) AS i FROM stamps ORDER BY 1 DESC, ts").rows == [(-1,), (0,), (1,)]
    with pytest.raises(EngineError):
        session.run("SELECT ts = 1 FROM stamps")


def test_results(session):
    assert session.run("EXPLAIN SELECT s, COUNT(*) FROM t WHERE id > 1 GROUP BY s ORDER BY s LIMIT 2 OFFSET 1").rows == [("Limit 2 offset 1",), ("  Project (2 columns)",), ("    Sort (1 keys)",), ("      Aggregate (1 keys, 1 aggregates)",), ("        Filter",), ("          Scan on t",)]
    assert session.run("").kind == "empty" and len(session.run("SHOW SOURCES").rows) == 5
    cut = session.run("SELECT id FROM t", limit=2)
    assert cut.truncated and cut.tag == "SELECT 2" and '"oid": 20' in cut.to_json()
    assert session.log[-1]["rows"] == 2 and session.run("SELECT COUNT(*), 1 + 1 FROM t").columns[0][0] == "count"


def test_oracle(spark):
    """The queries over the smallest tables against DuckDB."""
    import os

    import duckdb

    from lens import queries

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in queries.TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")

    def rows(names, values):
        order = sorted(range(len(names)), key=lambda k: names[k])
        return sorted(repr([round(r[k], 6) if isinstance(r[k], float) else r[k] for k in order]) for r in values)

    found = queries.queries()
    for name, sql in queries.oracle_sql().items():
        df, relation = found[name](spark, d), db.sql(sql)
        assert rows(df.columns, df.collect()) == rows(relation.columns, relation.fetchall()), name


def test_plans_of_scans(spark, tmp_path):
    """Conditions and columns reach the scan, equalities make an equi-join, and ORDER BY with LIMIT keeps few rows."""
    spark.range(100).selectExpr("CAST(id AS INT) AS a", "id / 2 AS b", "'x' AS c", "timestamp_ntz '2024-01-01 00:00:00' AS d").write.parquet(str(tmp_path / "t.parquet"))
    s = Session(spark, tables={"t": str(tmp_path / "t.parquet")})
    physical = lambda text: "\n".join(s.explain(text, physical=True)).partition("== Physical Plan ==")[2]
    scan = physical("SELECT b FROM t WHERE a > 7 AND b < 40")
    assert "GreaterThan(a,7)" in scan and "LessThan(b,40.0)" in scan and "ReadSchema: struct<a:int,b:double>" in scan
    assert "HashJoin" in physical("SELECT x.a AS a FROM t AS x JOIN t AS y ON x.a = y.a")
    assert "TakeOrderedAndProject" in physical("SELECT a FROM t ORDER BY b LIMIT 3")
    assert "partial_count" in physical("SELECT c, COUNT(*) AS n FROM t GROUP BY c")
