"""A query for each part of the dialect over the test tables, with the SQL that another engine must agree with."""

from __future__ import annotations

import atexit
import os
import shutil
import sqlite3
import tempfile
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from lens.session import Session
from lens.sources.catalog import CATALOGUE

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_EPOCH = "CAST(floor(epoch({})) AS BIGINT)"
_L = "CAST(l_linenumber AS BIGINT)"
_DL = "documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id"

#: name: (query, the same for DuckDB; None: the query's own text)
PAIRS: dict[str, tuple[str, str | None]] = {
    "flagship": (
        "SELECT l_returnflag, COUNT(*) AS n, SUM(l_quantity) AS qty FROM lineitem WHERE l_discount > 0.05 GROUP BY l_returnflag ORDER BY qty DESC LIMIT 10",
        "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS qty FROM lineitem WHERE l_discount > 0.05::DOUBLE GROUP BY l_returnflag ORDER BY qty DESC NULLS FIRST LIMIT 10",
    ),
    "scan_all_region": ("SELECT * FROM region", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region"),
    "project_exprs": ("SELECT l_orderkey AS k, l_linenumber * 10 AS ten, l_extendedprice * (1 - l_discount) AS net FROM lineitem", f"SELECT l_orderkey AS k, {_L} * 10 AS ten, l_extendedprice * (1 - l_discount) AS net FROM lineitem"),
    "select_no_from": ("SELECT 1 AS one, 'a' || 'b' AS ab, 7 / 2 AS half, TRUE AS yes", "SELECT CAST(1 AS BIGINT) AS one, 'ab' AS ab, 3.5::DOUBLE AS half, TRUE AS yes"),
    "qualified_alias": ("SELECT n.n_name AS nation, n.n_regionkey AS region FROM nation AS n WHERE n.n_regionkey = 2", "SELECT n_name AS nation, CAST(n_regionkey AS BIGINT) AS region FROM nation WHERE n_regionkey = 2"),
    "case_insensitive_ref": ("SELECT N_NAME AS name, Nation.N_NationKey AS k FROM nation", "SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS k FROM nation"),
    "where_cmp": ("SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus <> 'F'", None),
    "where_and_or_not": ("SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 0 OR c_mktsegment = 'BUILDING') AND c_nationkey % 2 = 0", None),
    "where_is_null": (f"SELECT d.doc_id AS doc_id, l.quality AS quality FROM {_DL} WHERE l.quality IS NULL", f"SELECT d.doc_id, CAST(l.quality AS BIGINT) AS quality FROM {_DL} WHERE l.quality IS NULL"),
    "where_is_not_null": (f"SELECT d.doc_id AS doc_id, l.toxic AS toxic FROM {_DL} WHERE l.toxic IS NOT NULL", f"SELECT d.doc_id, CAST(l.toxic AS BIGINT) AS toxic FROM {_DL} WHERE l.toxic IS NOT NULL"),
    "where_like": ("SELECT c_name FROM customer WHERE c_name LIKE '%_00%1'", None),
    "where_not_like": ("SELECT p_partkey, p_type FROM part WHERE p_type NOT LIKE '%A%'", None),
    "where_in": ("SELECT n_name FROM nation WHERE n_regionkey IN (1, 3)", None),
    "where_in_null": ("SELECT COUNT(*) AS n FROM nation WHERE n_regionkey NOT IN (1, NULL)", None),
    "where_between": ("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 11", None),
    "where_not_between": ("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity NOT BETWEEN 2 AND 49", None),
    "three_valued_logic": (
        f"SELECT d.doc_id AS doc_id, l.toxic = 1 AND TRUE AS a, l.toxic = 1 OR TRUE AS b, NOT l.toxic = 1 AS c, l.toxic = 1 AND FALSE AS f FROM {_DL}",
        f"SELECT d.doc_id, l.toxic = 1 AND TRUE AS a, l.toxic = 1 OR TRUE AS b, NOT l.toxic = 1 AS c, l.toxic = 1 AND FALSE AS f FROM {_DL}",
    ),
    "arith_int": ("SELECT l_orderkey AS k, l_linenumber + l_partkey - 3 AS s, l_linenumber * 7 AS m FROM lineitem", f"SELECT l_orderkey AS k, {_L} + l_partkey - 3 AS s, {_L} * 7 AS m FROM lineitem"),
    "arith_real": ("SELECT l_orderkey AS k, l_quantity + 0.5 AS a, l_quantity * l_tax AS b, l_quantity - 1 AS c FROM lineitem", "SELECT l_orderkey AS k, l_quantity + 0.5::DOUBLE AS a, l_quantity * l_tax AS b, l_quantity - 1 AS c FROM lineitem"),
    "div_widens": ("SELECT o_orderkey AS k, o_custkey / 7 AS d FROM orders", "SELECT o_orderkey AS k, o_custkey / 7::DOUBLE AS d FROM orders"),
    "modulo": ("SELECT o_orderkey AS k, o_orderkey % 7 AS m, (3 - o_orderkey) % 5 AS neg FROM orders", None),
    "unary_minus": ("SELECT c_custkey AS k, -c_acctbal AS neg, - -c_custkey AS pos, +c_nationkey AS plus FROM customer", "SELECT c_custkey AS k, -c_acctbal AS neg, c_custkey AS pos, CAST(c_nationkey AS BIGINT) AS plus FROM customer"),
    "concat_op": ("SELECT n_name || '-' || n_nationkey || '/' || (n_regionkey = 1) AS label FROM nation", "SELECT n_name || '-' || n_nationkey || '/' || CASE WHEN n_regionkey = 1 THEN 'true' ELSE 'false' END AS label FROM nation"),
    "precedence": ("SELECT c_custkey AS k, 1 + 2 * 3 AS a, 'x' || 1 + 2 AS b, NOT c_custkey = 1 OR c_custkey < 3 AND FALSE AS c FROM customer", "SELECT c_custkey AS k, CAST(7 AS BIGINT) AS a, 'x3' AS b, (NOT c_custkey = 1) OR (c_custkey < 3 AND FALSE) AS c FROM customer"),
    "compare_widens": ("SELECT COUNT(*) AS n FROM lineitem WHERE l_linenumber < l_quantity", None),
    "timestamp_arith": ("SELECT o_orderkey AS k, o_orderdate - 86400 AS before FROM orders", "SELECT o_orderkey AS k, epoch(o_orderdate) - 86400 AS before FROM orders"),
    "fn_lower": ("SELECT lower(n_name) AS s FROM nation", None),
    "fn_upper": ("SELECT upper(lang) AS s, upper(source) AS t FROM documents", None),
    "fn_length": ("SELECT doc_id, length(text) AS n, length(doc_id) AS digits FROM documents", "SELECT doc_id, length(text) AS n, length(doc_id::VARCHAR) AS digits FROM documents"),
    "fn_substr": ("SELECT substr(c_name, 3, 4) AS a, substr(c_name, 10) AS b FROM customer", None),
    "fn_substr_neg": ("SELECT substr(n_name, 0, 3) AS a, substr(n_name, -1, 4) AS b, substr(n_name, -5, 2) AS c, substr(n_name, -3) AS d FROM nation", "SELECT substr(n_name, 1, 2) AS a, substr(n_name, 1, 2) AS b, '' AS c, n_name AS d FROM nation"),
    "fn_trim": ("SELECT trim('  ' || n_name || '  ') AS s FROM nation", "SELECT n_name AS s FROM nation"),
    "fn_replace": ("SELECT replace(p_name, 'a', '<>') AS s, replace(p_name, '', 'x') AS same FROM part", "SELECT replace(p_name, 'a', '<>') AS s, p_name AS same FROM part"),
    "fn_abs": ("SELECT c_custkey AS k, abs(c_acctbal) AS a, abs(3 - c_custkey) AS b FROM customer", None),
    "fn_round": ("SELECT o_orderkey AS k, round(o_totalprice) AS a, round(o_totalprice, 1) AS b, round(o_orderkey, 2) AS c, round(o_orderkey, -2) AS d FROM orders", "SELECT o_orderkey AS k, round(o_totalprice) AS a, round(o_totalprice * 10.0::DOUBLE) / 10.0::DOUBLE AS b, o_orderkey AS c, round(o_orderkey * 0.01::DOUBLE) / 0.01::DOUBLE AS d FROM orders"),
    "fn_coalesce": (f"SELECT d.doc_id AS doc_id, coalesce(l.quality, -1) AS q FROM {_DL}", f"SELECT d.doc_id, CAST(coalesce(l.quality, -1) AS BIGINT) AS q FROM {_DL}"),
    "fn_nullif": (f"SELECT d.doc_id AS doc_id, nullif(d.lang, 'en') AS lang, nullif(1, l.quality) AS one FROM {_DL}", f"SELECT d.doc_id, nullif(d.lang, 'en') AS lang, CASE WHEN l.quality <> 1 THEN CAST(1 AS BIGINT) END AS one FROM {_DL}"),
    "fn_typeof": (f"SELECT d.doc_id AS doc_id, typeof(d.doc_id) AS a, typeof(d.text) AS b, typeof(l.toxic) AS c, typeof(d.doc_id / 2) AS r FROM {_DL}", f"SELECT d.doc_id, 'integer' AS a, 'text' AS b, CASE WHEN l.toxic IS NULL THEN 'unknown' ELSE 'integer' END AS c, 'real' AS r FROM {_DL}"),
    "fn_date": ("SELECT event_id, date(ts) AS d, date(event_id * 86400 - 100) AS e FROM events", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS d, strftime(to_timestamp(event_id * 86400 - 100), '%Y-%m-%d') AS e FROM events"),
    "fn_datetime": ("SELECT event_id, datetime(ts) AS d, datetime(event_id - 5000) AS e FROM events", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS d, strftime(to_timestamp(event_id - 5000), '%Y-%m-%d %H:%M:%S') AS e FROM events"),
    "cast_text": ("SELECT l_orderkey AS k, CAST(l_linenumber AS text) AS a, CAST(l_quantity AS varchar) AS b, CAST(l_tax = 0 AS text) AS c FROM lineitem", "SELECT l_orderkey AS k, CAST(l_linenumber AS VARCHAR) AS a, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS b, CASE WHEN l_tax = 0 THEN 'true' ELSE 'false' END AS c FROM lineitem"),
    "cast_int": ("SELECT o_orderkey AS k, CAST(o_totalprice AS integer) AS a, CAST(' 42 ' AS int) AS b, CAST(o_orderdate AS bigint) AS t FROM orders", f"SELECT o_orderkey AS k, CAST(trunc(o_totalprice) AS BIGINT) AS a, CAST(42 AS BIGINT) AS b, {_EPOCH.format('o_orderdate')} AS t FROM orders"),
    "cast_real": ("SELECT n_nationkey AS k, CAST(n_nationkey AS real) AS a, CAST('1e3' AS double) AS b FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_nationkey AS DOUBLE) AS a, 1000.0::DOUBLE AS b FROM nation"),
    "cast_bool": ("SELECT n_nationkey AS k, CAST(n_regionkey AS bool) AS a, CAST('off' AS boolean) AS b FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_regionkey <> 0 AS a, FALSE AS b FROM nation"),
    "cast_timestamp": ("SELECT o_orderkey AS k, CAST(o_orderkey AS timestamp) AS t FROM orders", "SELECT o_orderkey AS k, make_timestamp(o_orderkey * 1000000) AS t FROM orders"),
    "case_when": ("SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 5000 THEN 'rich' END AS s FROM customer", None),
    "agg_count_star": ("SELECT COUNT(*) AS n FROM lineitem", None),
    "agg_count_expr": (f"SELECT COUNT(l.quality) AS n, COUNT(*) AS every FROM {_DL}", None),
    "agg_count_distinct": ("SELECT COUNT(DISTINCT l_suppkey) AS n FROM lineitem", None),
    "agg_sum_int": ("SELECT SUM(l_linenumber) AS s FROM lineitem", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem"),
    "agg_sum_real": ("SELECT round(SUM(l_extendedprice), 2) AS s FROM lineitem", "SELECT round(sum(l_extendedprice), 2) AS s FROM lineitem"),
    "agg_avg": ("SELECT l_returnflag, round(AVG(l_quantity), 6) AS a, AVG(l_linenumber) AS b FROM lineitem GROUP BY l_returnflag", None),
    "agg_avg_distinct": ("SELECT AVG(DISTINCT l_quantity) AS a FROM lineitem", None),
    "agg_min_max": ("SELECT MIN(o_orderdate) AS a, MAX(o_orderdate) AS b, MIN(o_orderpriority) AS c, MAX(o_totalprice) AS d FROM orders", None),
    "agg_sum_distinct": ("SELECT SUM(DISTINCT l_linenumber) AS s FROM lineitem", "SELECT CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s FROM lineitem"),
    "agg_empty": ("SELECT COUNT(*) AS n, SUM(n_nationkey) AS s, MAX(n_name) AS m FROM nation WHERE n_nationkey < 0", "SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS s, CAST(NULL AS VARCHAR) AS m"),
    "group_by": ("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority", None),
    "group_by_expr": ("SELECT o_custkey % 10 AS d, COUNT(*) AS n, MAX(o_custkey % 10 + 1) AS m FROM orders GROUP BY o_custkey % 10", "SELECT o_custkey % 10 AS d, count(*) AS n, max(o_custkey % 10 + 1) AS m FROM orders GROUP BY 1"),
    "group_by_null_key": (f"SELECT l.quality AS q, COUNT(*) AS n FROM {_DL} GROUP BY l.quality", f"SELECT CAST(l.quality AS BIGINT) AS q, count(*) AS n FROM {_DL} GROUP BY l.quality"),
    "having": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12", None),
    "having_no_group": ("SELECT COUNT(*) AS n FROM orders HAVING COUNT(*) > 5", None),
    "order_asc": ("SELECT n_name FROM nation ORDER BY n_name", None),
    "order_desc_nulls": (f"SELECT d.doc_id AS doc_id, l.quality AS q FROM {_DL} ORDER BY l.quality DESC, d.doc_id LIMIT 50", f"SELECT d.doc_id, CAST(l.quality AS BIGINT) AS q FROM {_DL} ORDER BY l.quality DESC NULLS FIRST, d.doc_id LIMIT 50"),
    "nulls_first_last": (f"SELECT d.doc_id AS doc_id FROM {_DL} ORDER BY l.quality DESC NULLS LAST, l.toxic ASC NULLS FIRST, d.doc_id LIMIT 40", f"SELECT d.doc_id FROM {_DL} ORDER BY l.quality DESC NULLS LAST, l.toxic ASC NULLS FIRST, d.doc_id LIMIT 40"),
    "order_unselected": ("SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20", "SELECT c_name FROM customer ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 20"),
    "order_alias": ("SELECT c_custkey AS k, -c_acctbal AS c_nationkey FROM customer ORDER BY c_nationkey, k LIMIT 15", "SELECT c_custkey AS k, -c_acctbal AS c_nationkey FROM customer ORDER BY -c_acctbal, c_custkey LIMIT 15"),
    "topk": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", None),
    "limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 20 LIMIT 10", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20"),
    "limit_zero": ("SELECT n_name FROM nation LIMIT 0", None),
    "distinct": ("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", None),
    "distinct_order": ("SELECT DISTINCT o_orderpriority FROM orders ORDER BY o_orderpriority DESC LIMIT 3", "SELECT DISTINCT o_orderpriority FROM orders ORDER BY o_orderpriority DESC LIMIT 3"),
    "distinct_order_unselected": ("SELECT DISTINCT o_custkey FROM orders ORDER BY o_orderkey LIMIT 10", "SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY min(o_orderkey) LIMIT 10"),
    "join_inner": ("SELECT o.o_orderkey AS k, c.c_name AS name FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey", "SELECT o_orderkey AS k, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "join_left": ("SELECT d.doc_id AS doc_id, l.toxic AS toxic FROM documents d LEFT OUTER JOIN labels l ON d.doc_id = l.doc_id AND l.toxic = 1", "SELECT d.doc_id, CAST(l.toxic AS BIGINT) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.toxic = 1"),
    "join_null_keys": ("SELECT COUNT(*) AS n FROM nation AS a JOIN nation AS b ON nullif(a.n_regionkey, 1) = nullif(b.n_regionkey, 1)", None),
    "join_theta": ("SELECT a.n_name AS a, b.n_name AS b FROM nation AS a JOIN nation AS b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey", None),
    "join_like": ("SELECT n.n_name AS n, p.p_name AS p FROM nation AS n JOIN part AS p ON p.p_name || p.p_partkey LIKE 'r%' || substr(n.n_name, 8)", "SELECT n.n_name AS n, p.p_name AS p FROM nation n JOIN part p ON p.p_name || CAST(p.p_partkey AS VARCHAR) LIKE 'r%' || substr(n.n_name, 8)"),
    "join_like_left": ("SELECT r.r_name AS r, p.p_type AS p FROM region AS r LEFT JOIN part AS p ON p.p_type LIKE substr(r.r_name, 1, 1) || '%' AND p.p_partkey < 100", "SELECT r.r_name AS r, p.p_type AS p FROM region r LEFT JOIN part p ON p.p_type LIKE substr(r.r_name, 1, 1) || '%' AND p.p_partkey < 100"),
    "limit_beyond_int": ("SELECT n_name FROM nation ORDER BY n_name LIMIT 5000000000 OFFSET 3", "SELECT n_name FROM nation ORDER BY n_name OFFSET 3"),
    "offset_beyond_int": ("SELECT n_name FROM nation ORDER BY n_name OFFSET 3000000000", "SELECT n_name FROM nation WHERE FALSE"),
    "join_constant": ("SELECT a.r_name AS a, b.r_name AS b FROM region AS a JOIN region AS b ON TRUE", "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b"),
    "join_group": (
        "SELECT c.c_mktsegment AS segment, COUNT(*) AS n, round(SUM(o.o_totalprice), 2) AS total FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment HAVING COUNT(*) > 1 ORDER BY n DESC",
        "SELECT c_mktsegment AS segment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment HAVING count(*) > 1",
    ),
    "join_lineitem": (
        "SELECT o.o_orderpriority AS p, COUNT(*) AS n, round(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM lineitem AS l JOIN orders AS o ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'O' GROUP BY o.o_orderpriority",
        "SELECT o_orderpriority AS p, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' GROUP BY o_orderpriority",
    ),
    "explain": ("EXPLAIN SELECT o_orderstatus, COUNT(*) FROM orders GROUP BY o_orderstatus", "SELECT unnest(['Project (2 columns)', '  Aggregate (1 keys, 1 aggregates)', '    Scan on orders']) AS \"QUERY PLAN\""),
    "show_sources": ("SHOW SOURCES", "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in CATALOGUE) + ") t(source, signature, reads)"),
}


def session(spark: SparkSession, sf_dir: str, directory: str = ".", **more) -> Session:
    return Session(spark, directory, tables={t: f"{sf_dir}/{t}.parquet" for t in TABLES}, **more)


def _query(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).sql(text)


def _fixtures(spark: SparkSession) -> str:
    """A folder with a CSV file, a database, a log and a directory tree, until this process ends: below spark.checkpoint.dir,
    which executors share, or of this machine where that isn't set or isn't a folder."""
    shared = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://")
    at = tempfile.mkdtemp(prefix="lens-fixtures-", dir=shared if os.path.isdir(shared) else None)
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    with open(f"{at}/owners.csv", "w") as f:
        f.write('filename,owner,priority\nmain.rs,alice,3\nlib.rs,"carol, jr",10\nREADME,,07\n"quoted.rs",bob,1\n')
    with sqlite3.connect(f"{at}/simple.db") as db:
        db.execute("CREATE TABLE users (id INTEGER PRIMARY KEY, name TEXT, score REAL, active INT)")
        db.executemany("INSERT INTO users VALUES (?, ?, ?, ?)", [(n, f"user_{n}", n * 1.5, n % 2) for n in range(1, 501)])
    db.close()
    with open(f"{at}/server.log", "w") as f:
        f.write("start\nERROR one\r\nok\nERROR two\npartial")
    os.makedirs(f"{at}/tree/a.b/c")
    for name in ("tree/A.TXT", "tree/.hidden", "tree/foo.", "tree/a.b/c/deep.rs"):
        with open(f"{at}/{name}", "w") as f:
            f.write("x" * len(name))
    return at


def _source(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    os.environ["LENS_SEEN"] = "as it is"
    return session(spark, sf_dir, _fixtures(spark), tail_once=True, cache=False).sql(text)


SOURCES = {
    "src_csv": ("SELECT filename, owner, priority FROM csv('owners.csv') WHERE priority > 2", "SELECT * FROM (VALUES ('main.rs', 'alice', 3::BIGINT), ('lib.rs', 'carol, jr', 10::BIGINT), ('README', NULL, 7::BIGINT)) t(filename, owner, priority)"),
    "src_sqlite": ("SELECT name, score, active FROM sqlite('simple.db', 'users') WHERE id BETWEEN 249 AND 251", "SELECT * FROM (VALUES ('user_249', 373.5::DOUBLE, 1::BIGINT), ('user_250', 375.0::DOUBLE, 0::BIGINT), ('user_251', 376.5::DOUBLE, 1::BIGINT)) t(name, score, active)"),
    "src_files": ("SELECT name, ext, depth, is_dir FROM files('tree') WHERE NOT is_dir OR depth = 0", "SELECT * FROM (VALUES ('A.TXT', 'txt', 0::BIGINT, FALSE), ('.hidden', NULL, 0::BIGINT, FALSE), ('foo.', '', 0::BIGINT, FALSE), ('a.b', 'b', 0::BIGINT, TRUE), ('deep.rs', 'rs', 2::BIGINT, FALSE)) t(name, ext, depth, is_dir)"),
    "src_tail_once": ("SELECT line FROM tail('server.log') WHERE line LIKE '%ERROR%'", "SELECT * FROM (VALUES ('ERROR one'), ('ERROR two')) t(line)"),
    "src_env": ("SELECT name, value FROM env WHERE name = 'LENS_SEEN' OR name = 'LENS_UNSEEN'", "SELECT 'LENS_SEEN' AS name, 'as it is' AS value"),
    "src_join": ("SELECT u.name AS name, o.owner AS owner FROM sqlite('simple.db', 'users') AS u JOIN csv('owners.csv') AS o ON u.id = o.priority", "SELECT * FROM (VALUES ('user_3', 'alice'), ('user_10', 'carol, jr'), ('user_7', NULL), ('user_1', 'bob')) t(name, owner)"),
}


def _parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Session(spark, sf_dir).sql("SELECT r_name FROM parquet('region.parquet')")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable] = {name: partial(_query, text) for name, (text, _) in PAIRS.items()}
    out |= {name: partial(_source, text) for name, (text, _) in SOURCES.items()}
    out["src_parquet"] = _parquet
    return out


def oracle_sql() -> dict[str, str]:
    out = {name: sql or text for name, (text, sql) in PAIRS.items()}
    out |= {name: sql for name, (_, sql) in SOURCES.items() if sql}
    out["src_parquet"] = "SELECT r_name FROM region"
    return out
