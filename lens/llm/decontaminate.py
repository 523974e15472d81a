"""Benchmark decontamination by Wu-Manber search over words: shift tables of two-word blocks say how far a window may move on;
where it may not, the hash of its suffix block and of its words select the benchmark's windows, and their bytes are
compared.

The benchmark is searched for in blocks of bounded size, held as arrays. One block goes to the tasks as a broadcast. Of
more, each has its own pass over the documents, whose hits are written before the next block is built, so that neither
the driver nor a task ever holds more than one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lens.llm.common import U64, byte_set, lowered, mixed, plain, rows_of, small_batches, span_hashes, spans, table, utf8, window_hashes, written

WINDOW = 13
#: At most about so many bytes of benchmark text are searched for in one pass over the documents (one item at least).
PASS_BYTES = 8 << 20
WORD = byte_set(range(0x30, 0x3A), range(0x41, 0x5B), range(0x61, 0x7B), range(0x80, 0x100))
TABLE_BITS = 20
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and where each word starts and ends."""
    data = lowered(data)
    return data, *spans(WORD[data], at)


@dataclass
class Tables:
    """The search for the windows of one length, in words."""

    length: int
    shift: np.ndarray  # by a block's hash: how far the window may move on
    keys: np.ndarray  # of each window, from the hashes of its suffix block and of its words, in order
    begins: np.ndarray  # the word of the benchmark that each window begins at
    items: np.ndarray


@dataclass
class Benchmark:
    """Items as arrays: bytes in lower case, where words start and end, and the windows by length."""

    raw: bytes
    first: np.ndarray
    last: np.ndarray
    ids: list[int]
    tables: list[Tables]


def _blocks(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of the block of `width` words that ends at each place."""
    if width == 1:
        return hashes
    out = np.zeros(len(hashes), U64)
    out[1:] = mixed(hashes[1:] + hashes[:-1] * U64(0x9E3779B97F4A7C15))
    return out


def _keys(hashes: np.ndarray, blocks: np.ndarray, begins: np.ndarray, length: int) -> np.ndarray:
    return mixed(blocks[begins + length - 1] + mixed(window_hashes(hashes, length)[begins]))


def build(items: list[tuple[int | None, str | None]], window: int = WINDOW) -> Benchmark:
    """The items' windows, in tables for each length that they have. Items without an id or a text have none."""
    items = [(i, t) for i, t in items if i is not None and t]
    ids = sorted({i for i, _ in items})
    raw, at = utf8(pa.array([t for _, t in items], pa.string()))
    data, first, last = words_of(raw, at)
    owner = rows_of(first, at)
    number = np.searchsorted(ids, np.array([i for i, _ in items], np.int64)) if items else np.zeros(0, np.int64)
    counts = np.bincount(owner, minlength=len(items)) if len(items) else np.zeros(0, np.int64)
    lengths, ends = np.minimum(window, counts), np.cumsum(counts)
    hashes, tables = span_hashes(data, first, last), []
    for length in sorted({*lengths.tolist()} - {0}):
        width = min(2, length)
        most = length - width + 1
        blocks = _blocks(hashes, width)
        begins = np.flatnonzero((lengths[owner] == length) & (np.arange(len(first)) + length <= ends[owner]))
        shift = np.full(1 << TABLE_BITS, min(most, 255), np.uint8)
        slots = (blocks >> U64(64 - TABLE_BITS)).astype(np.int64)
        for away in range(min(most, 255) - 1, -1, -1):
            shift[slots[begins + length - 1 - away]] = away
        keys, item = _keys(hashes, blocks, begins, length), number[owner[begins]]
        order = np.lexsort((item, keys))
        keys, item, begins = keys[order], item[order], begins[order]
        new = np.ones(len(keys), bool)  # a window that an item has twice counts once
        new[1:] = (keys[1:] != keys[:-1]) | (item[1:] != item[:-1])
        tables.append(Tables(length, shift, keys[new], begins[new].astype(np.int32), item[new].astype(np.int32)))
    return Benchmark(data.tobytes(), first.astype(np.int32), last.astype(np.int32), ids, tables)


def search(found: Benchmark, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[list[int], list[int], set[int]]]]:
    """For each text its number of words, and for those with a hit: word starts and ends of the hits, and the items' ids."""
    data, first, last = words_of(data, at)
    hashes = span_hashes(data, first, last)
    bounds = np.searchsorted(first, at)
    raw = data.tobytes()
    hits: dict[int, tuple[list[int], list[int], set[int]]] = {}
    for t in found.tables:
        blocks = _blocks(hashes, min(2, t.length))
        skip = t.shift[(blocks >> U64(64 - TABLE_BITS)).astype(np.int64)].tobytes()
        places = []  # the last words of windows that no block rules out
        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            place = start + t.length - 1
            while place < end:
                if step := skip[place]:
                    place += step
                else:
                    places.append(place)
                    place += 1
        if not places:
            continue
        begins = np.array(places) - t.length + 1
        keys = _keys(hashes, blocks, begins, t.length)
        low, high = np.searchsorted(t.keys, keys), np.searchsorted(t.keys, keys, "right")
        some = np.flatnonzero(high > low)
        docs = np.searchsorted(bounds, begins[some], "right") - 1
        for begin, doc, a, b in zip(begins[some].tolist(), docs.tolist(), low[some].tolist(), high[some].tolist(), strict=True):
            words = [raw[first[k] : last[k]] for k in range(begin, begin + t.length)]
            for k in range(a, b):
                other = int(t.begins[k])
                if words == [found.raw[found.first[j] : found.last[j]] for j in range(other, other + t.length)]:
                    starts, ends, owners = hits.setdefault(doc, ([], [], set()))
                    start = int(begin - bounds[doc])
                    if not starts or (starts[-1], ends[-1]) != (start, start + t.length):
                        starts.append(start)
                        ends.append(start + t.length)
                    owners.add(found.ids[t.items[k]])
    return np.diff(bounds), hits


def _union(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_HITS = "array<struct<a:long,b:long>>"
_FOUND = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _pass(docs: DataFrame, items: list) -> DataFrame:
    """Adds what a block of items hits as the columns n_words, hits and items. Rows stay where they are."""
    shared = docs.sparkSession.sparkContext.broadcast(build(items))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, found = search(shared.value, *utf8(batch.column(names.index("text"))))
            hits, owners = [[]] * batch.num_rows, [[]] * batch.num_rows
            for doc, (starts, ends, ids) in found.items():
                hits[doc], owners[doc] = [{"a": a, "b": b} for a, b in _union(starts, ends)], sorted(ids)
            more = [pa.array(n_words), pa.array(hits, _FOUND), pa.array(owners, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*names, "n_words", "hits", "items"])

    schema = docs.select("*", F.lit(0).cast("long").alias("n_words"), F.array().cast(_HITS).alias("hits"), F.array().cast("array<long>").alias("items")).schema
    return docs.mapInArrow(run, schema)


def _merged(found: DataFrame) -> DataFrame:
    """The hits of several passes as ranges that don't touch."""
    names = found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = names.index("hits")
            hits = [[{"a": a, "b": b} for a, b in _union([x["a"] for x in row], [x["b"] for x in row])] for row in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(hits, _FOUND) if k == at else c for k, c in enumerate(batch.columns)], names)

    return found.mapInArrow(run, found.schema)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (a text, and what else) with the columns n_words, hits (ranges of words that don't touch) and items added; their
    names, key and size must be free.

    A benchmark of one block takes one pass, in which no row moves. Else the hits of each pass are written by text, and
    joined with the documents once.
    """
    small_batches(docs.sparkSession)
    items = plain(benchmark, "item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // PASS_BYTES)
    if n <= 1:
        return _pass(docs, [tuple(x) for x in items.collect()])
    keys = [F.xxhash64("text").alias("key"), F.octet_length("text").alias("size")]
    texts, found = docs.select("text").where("text IS NOT NULL"), []
    for k in range(n):
        block = [tuple(x) for x in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]
        hit = _pass(texts, block).where("size(hits) > 0").select(*keys, "hits", "items")
        found.append(written(hit.groupBy("key", "size").agg(F.first("hits").alias("hits"), F.first("items").alias("items")), "hits"))
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    every = _merged(reduce(DataFrame.unionByName, found).groupBy(F.col("key").alias("key_"), F.col("size").alias("size_")).agg(flat("hits"), flat("items")))
    wide = _pass(docs, []).drop("hits", "items").select("*", *keys).join(every, (F.col("key") == F.col("key_")) & (F.col("size") == F.col("size_")), "left")
    columns = [F.coalesce("hits", F.array().cast(_HITS)).alias("hits"), F.coalesce(F.array_distinct("items"), F.array().cast("array<long>")).alias("items")]
    return wide.select(*docs.columns, "n_words", *columns)


def decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text): its words, those inside occurrences of windows of 13 words of benchmark
    items (shorter items whole), the items with occurring windows, and whether a twentieth of the words or more is hit.

    Null and empty texts have no words and aren't contaminated; items with null id, null text or no words match nothing;
    equal rows each get a row, equal items are both listed; an empty table on either side gives no rows or no hits;
    further columns are ignored.
    """
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda t, x: t + x["b"] - x["a"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    found = contamination(plain(docs, "doc_id", "text"), benchmark).select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def removing(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without its contaminated rows, all columns as they are, whatever their names. Null and empty texts and rows without
    an id stay; equal rows are judged alike; an empty table, or an empty benchmark, changes nothing."""
    inner = docs.select(F.struct("*").alias("row"), F.col("text"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda t, x: t + x["b"] - x["a"])
    found = contamination(inner, benchmark).withColumn("n_hit", n_hit)
    return found.where("NOT (n_hit > 0 AND 20 * n_hit >= n_words)").select("row.*")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents)
, i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark)
, sizes AS (SELECT item_id, ws, least({WINDOW}, len(ws)) AS n FROM i WHERE len(ws) > 0)
, pats AS (SELECT item_id, n, array_to_string(ws[k:k + n - 1], ' ') AS pat FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS k FROM sizes) t)
, wins AS (SELECT doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') AS pat
    FROM (SELECT d.doc_id, d.ws, l.n, unnest(range(1, len(d.ws) - l.n + 2)) AS k FROM d CROSS JOIN (SELECT DISTINCT n FROM sizes) l) t)
, hits AS (SELECT w.doc_id, w.k, w.n, p.item_id FROM wins w JOIN pats p ON w.n = p.n AND w.pat = p.pat)
, covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM hits) t GROUP BY doc_id)
, owners AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) t GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(o.n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(o.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN owners o ON o.doc_id = d.doc_id"""
QUERIES = {"op3_decontamination": op3_decontamination}
SQL = {"op3_decontamination": _SQL}
