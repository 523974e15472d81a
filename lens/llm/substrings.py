"""Removal of strings of bytes that an earlier document has, by suffix arrays.

Of each window of `LENGTH` bytes the leftmost least hash of the GRAM-byte strings in it is its anchor, so equal windows have
equal anchors in the same place. Anchors are counted in buckets by hash; of those that several texts have, the bytes of
their windows are read again and brought together by bucket. A bucket's distinct strings of bytes are cut into shards. Each
shard gets a suffix array (Larsson-Sadakane refinement) and common prefixes (Kasai); runs of suffixes that agree in LENGTH
bytes give the least doc_id of each window; the shards of a bucket are merged by binary search.

Equal texts are one text, however many documents have it: of those, all but the ones with the least doc_id go as a whole.
Texts are told apart by 64 bits of a hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lens.llm import common
from lens.llm.common import _TABLE, U64, discard, in_parts, mixed, plain, small_batches, table, utf8, written

LENGTH, GRAM = 50, 20
SPAN = LENGTH - GRAM + 1  # anchors that a window may have; windows that an anchor may be in
AROUND = LENGTH + SPAN - 1  # the most bytes that the windows of an anchor take
#: Usual buckets are several shards; a shard's suffixes are numbered by PLACE bits.
ANCHORS_A_BUCKET, SHARD, PLACE, BYTES_A_GROUP = 150_000, 6000, 19, 16 << 20
FIRST = 5  # symbols of 9 bits that suffixes are sorted by at first, in one key with their places
LAST = 2**63 - 1  # the order of rows without a doc_id: behind all others
_ENTRY = np.dtype([("rest", "<u4"), ("key", "<u8")])
_AROUND = np.dtype([("key", "<u8"), ("doc", "<i8"), ("at", "<i8"), ("first", "u1"), ("size", "u1")])
_COVER = np.dtype([("key", "<u8"), ("at", "<i8"), ("mask", "<u4")])


def _slide(x: np.ndarray, n: int, f: np.ufunc) -> np.ndarray:
    """f over each n neighbours, by doubling."""
    width = 1
    while 2 * width <= n:
        x = f(x[: len(x) - width], x[width:])
        width *= 2
    return f(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the windows' anchors in order, their hashes, and the first and the last window that each is the anchor of."""
    n = len(data)
    nothing = np.zeros(0, np.int64)
    if n < LENGTH:
        return nothing, np.zeros(0, U64), nothing, nothing
    common._grown(n)
    sums = np.empty(n + 1, U64)
    sums[0] = 0
    np.cumsum(_TABLE[data] * common._powers[0][:n], out=sums[1:])
    hashes = mixed((sums[GRAM:] - sums[:-GRAM]) * common._powers[1][: n - GRAM + 1])
    least = _slide(hashes, SPAN, np.minimum)  # of the window from each place on
    inside = np.zeros(len(least) + 1, np.int32)
    has = np.flatnonzero(np.diff(at) >= LENGTH)
    np.add.at(inside, at[has], 1)
    np.add.at(inside, at[has + 1] - LENGTH + 1, -1)
    whole = np.cumsum(inside[:-1]) > 0  # not over the end of a text
    # Windows with the same least hash, one after the other, have the same anchor, but for one that comes again.
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | ~whole[:-1]
    runs = np.flatnonzero(new & whole)
    ends = np.concatenate([np.flatnonzero(new | ~whole), [len(least)]])
    ends = ends[np.searchsorted(ends, runs, "right")] if len(runs) else nothing
    todo_first, todo_end, found = runs, ends, []
    while len(todo_first):
        place = todo_first.copy()
        value = least[todo_first]
        behind = np.flatnonzero(hashes[place] != value)
        while len(behind):
            place[behind] += 1
            behind = behind[hashes[place[behind]] != value[behind]]
        stop = np.minimum(todo_end, place + 1)  # the first window that no longer holds it
        found.append((place, todo_first, stop - 1))
        more = stop < todo_end
        todo_first, todo_end = stop[more], todo_end[more]
    if not found:
        return nothing, np.zeros(0, U64), nothing, nothing
    place, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(low)
    place, low, high = place[order], low[order], high[order]
    return place, hashes[place], low, high


def _bucketed(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return (hashes >> U64(33)) % U64(buckets), hashes & U64(0xFFFFFFFF)


def _asked(key: np.ndarray, bucket: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """One number for an anchor of a text. Two that share one by chance cost a look at some bytes, and change no result."""
    return mixed(key + mixed(rest | bucket << U64(32)))


def _packed(which: np.ndarray, rows: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """rows by `which`, as one blob for each of its values."""
    order = np.argsort(which, kind="stable")
    which, rows = which[order], rows[order]
    places = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]])) if len(which) else np.zeros(0, np.int64)
    return pa.array(which[places].astype(np.int32)), pa.array([x.tobytes() for x in np.split(rows, places[1:])] if len(places) else [], pa.binary())


def _together(column: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column if x.is_valid), kind)


def _steps(size: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of these sizes."""
    after = np.cumsum(size)
    return np.arange(after[-1] if len(after) else 0) - np.repeat(after - size, size)


def suffix_array(flat: np.ndarray, remain: np.ndarray) -> np.ndarray:
    """The order of all suffixes of strings of bytes, one after the other in flat; remain: bytes from each place to its
    string's end. Equal suffixes are in the order of their places.

    Suffixes are sorted by FIRST symbols, then sets of equal ones again by the rank of what follows, which doubles the
    depth each time. What is sorted is one number of set, rank and place."""
    n = len(flat)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.concatenate([flat.astype(U64) + U64(1), np.zeros(FIRST, U64)])
    key = np.zeros(n, U64)
    for k in range(FIRST):
        key = key << U64(9) | np.where(remain > k, padded[k : k + n], U64(0))
    places = np.arange(n, dtype=U64)
    low = U64((1 << PLACE) - 1)
    key = np.sort(key << U64(PLACE) | places)
    order = (key & low).astype(np.int64)
    key >>= U64(PLACE)
    new = np.concatenate([[True], key[1:] != key[:-1]])
    depth, longest = FIRST, int(remain.max())
    rank = np.empty(n, np.int64)
    start = np.flatnonzero(new)
    rank[order] = np.repeat(start, np.diff(np.concatenate([start, [n]])))  # where an equal set begins
    open_ = np.flatnonzero(~new | ~np.concatenate([new[1:], [True]]))
    while depth < longest and len(open_):
        open_ = open_[remain[order[open_]] >= depth]  # what has ended before is equal to its whole set
        suffix = order[open_]
        follows = np.where(remain[suffix] > depth, rank[np.minimum(suffix + depth, n - 1)] + 1, 0)
        key = np.sort(rank[suffix].astype(U64) << U64(2 * PLACE + 1) | follows.astype(U64) << U64(PLACE) | suffix.astype(U64))
        order[open_] = (key & low).astype(np.int64)
        key >>= U64(PLACE)
        new[open_[1:]] = key[1:] != key[:-1]
        heads = np.flatnonzero(new[open_])
        rank[order[open_]] = np.repeat(open_[heads], np.diff(np.concatenate([heads, [len(open_)]])))
        alone = new[open_] & np.concatenate([new[open_][1:], [True]])
        open_ = open_[~alone]
        depth *= 2
    return order


def common_prefixes(flat: np.ndarray, remain: np.ndarray, order: np.ndarray, starts: np.ndarray, least: int = 1) -> np.ndarray:
    """For each suffix of at least `least` bytes, in order, what it has in common with the one before it, up to LENGTH: Kasai's
    walk along the strings, which begin at starts, all in step."""
    order = order[remain[order] >= least]
    n = len(flat)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)
    padded = np.concatenate([flat, np.zeros(LENGTH + 1, flat.dtype)])
    here, h = starts.copy(), np.zeros(len(starts), np.int64)
    live = remain[here] >= least if len(here) else np.zeros(0, bool)
    here, h = here[live], h[live]
    while len(here):
        other = before[here]
        most = np.where(other >= 0, np.minimum(np.minimum(remain[here], remain[other]), LENGTH), 0)
        h = np.minimum(h, most)
        going = np.flatnonzero(h < most)
        while len(going):
            going = going[padded[here[going] + h[going]] == padded[other[going] + h[going]]]
            h[going] += 1
            going = going[h[going] < most[going]]
        shared[here] = h
        # what follows has one byte less in common with what follows the other, if that is among the suffixes too
        h = np.where((other >= 0) & (remain[other] > least), np.maximum(h - 1, 0), 0)
        live = remain[here] > least
        here, h = here[live] + 1, h[live]
    return shared[order]


def _shard(flat: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct strings of LENGTH bytes in order with the least doc of each, and for each (row, window) its string."""
    starts = np.cumsum(size) - size
    column = _steps(size)
    remain = np.repeat(size, size) - column
    order = suffix_array(flat, remain)
    agree = common_prefixes(flat, remain, order, starts, LENGTH)
    order = order[remain[order] >= LENGTH]
    string = np.cumsum(agree < LENGTH) - 1
    row = np.repeat(np.arange(len(size)), size)[order]
    heads = np.flatnonzero(agree < LENGTH)
    docs = np.minimum.reduceat(doc[row], heads) if len(heads) else np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(flat, LENGTH)[order[heads]] if len(heads) else np.zeros((0, LENGTH), np.uint8)
    keys = np.ascontiguousarray(windows).view(f"S{LENGTH}").reshape(-1)
    return keys, docs, row * SPAN + column[order], string


def least_docs(flat: np.ndarray, size: np.ndarray, doc: np.ndarray, shard: int = SHARD) -> np.ndarray:
    """For each string of bytes (one after the other in flat) and each window in it the least doc that has the window's bytes
    (LAST: no window). Each shard's windows are looked up in all other shards of these strings by binary search."""
    out = np.full((len(size), SPAN), LAST)
    ends = np.concatenate([[0], np.cumsum(size)])
    shards = [(k, *_shard(flat[ends[k] : ends[min(k + shard, len(size))]], size[k : k + shard], doc[k : k + shard])) for k in range(0, len(size), shard)]
    for k, keys, docs, places, string in shards:
        docs = docs.copy()
        for other, keys2, docs2, _, _ in shards:
            if other != k and len(keys2):
                at = np.searchsorted(keys2, keys)
                at[at == len(keys2)] = 0
                same = keys2[at] == keys
                docs[same] = np.minimum(docs[same], docs2[at[same]])
        out[k : k + shard].reshape(-1)[places] = docs[string]
    return out


def _covers(rows: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Which windows an earlier document has too, as bits; rows without any are left out."""
    size = rows["size"].astype(np.int64)
    starts = np.cumsum(size) - size
    wide = np.zeros((len(rows), AROUND + 2), np.uint8)
    wide[:, 0], wide[:, 1] = rows["first"], rows["size"]
    wide[np.repeat(np.arange(len(rows)), size), 2 + _steps(size)] = flat
    _, index, inverse = np.unique(wide.view(f"S{AROUND + 2}").reshape(-1), return_index=True, return_inverse=True)
    least = np.full(len(index), LAST)
    np.minimum.at(least, inverse, rows["doc"])
    own = size[index]
    distinct = flat[np.repeat(starts[index], own) + _steps(own)]
    earlier = least_docs(distinct, own, least)[inverse] < rows["doc"][:, None]
    mask = (earlier.astype(np.uint64) << np.arange(SPAN, dtype=np.uint64)).sum(1).astype(np.uint32)
    out = np.empty(len(rows), _COVER)
    out["key"], out["at"], out["mask"] = rows["key"], rows["at"], mask
    return out[mask > 0]


def _removed(data: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each byte of a batch of texts is in one of the windows from these places."""
    step = np.zeros(len(data) + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + LENGTH, -1)
    return np.cumsum(step[:-1]) > 0


def repeated_substrings(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """A row for each row of docs (doc_id, text): its bytes, those removed because a string of 50 bytes around them also
    starts in a document with a smaller doc_id, the runs they make, and a digest of the others (and these, if asked for).

    Null and empty texts have no bytes. Rows without a doc_id come behind all others, and none is earlier than another;
    equal rows, and others with one doc_id, aren't earlier than each other and each get a row; an empty table gives none;
    further columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    texts = written(docs.groupBy("key").agg(F.min(F.coalesce("doc_id", F.lit(LAST))).alias("doc"), F.first("text").alias("text")), "texts")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, groups = max(64, int(total / (SPAN / 2) / ANCHORS_A_BUCKET)), max(64, total // BYTES_A_GROUP)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in in_parts(batch, "text")):
            data, at = utf8(batch.column(1))
            place, hashes, _, _ = anchors(data, at)
            bucket, rest = _bucketed(hashes, buckets)
            rows = np.empty(len(place), _ENTRY)
            rows["rest"], rows["key"] = rest, batch.column(0).to_numpy().view(U64)[np.searchsorted(at, place, "right") - 1]
            yield pa.RecordBatch.from_arrays(list(_packed(bucket, rows)), ["bucket", "rows"])

    def shared(part: pa.Table) -> pa.Table:
        """The anchors that several texts have, for each of these texts."""
        rows = _together(part.column("rows"), _ENTRY)
        order = np.argsort(rows["rest"], kind="stable")
        rest, key = rows["rest"][order].astype(U64), rows["key"][order]
        starts = np.flatnonzero(np.concatenate([[True], rest[1:] != rest[:-1]]))
        several = np.minimum.reduceat(key, starts) != np.maximum.reduceat(key, starts)
        chosen = np.repeat(several, np.diff(np.concatenate([starts, [len(rest)]])))
        rest, key = rest[chosen], key[chosen]
        asked = _asked(key, np.full(len(rest), part.column("bucket")[0].as_py(), U64), rest)
        group, blob = _packed(mixed(key) % U64(groups), asked)
        return pa.table({"group": group, "asked": blob})

    asked = written(texts.select("key", "text").mapInArrow(entries, "bucket int, rows binary").groupBy("bucket").applyInArrow(shared, "group int, asked binary"), "anchors")
    grouped = texts.mapInArrow(_Group(groups), "group int, key long, doc long, text string")

    def surroundings(_: tuple, texts_: pa.Table, wanted: pa.Table) -> pa.Table:
        want = np.unique(_together(wanted.column("asked"), np.dtype("<u8")))
        out: list[tuple] = []
        for batch in in_parts(texts_, "text") if len(want) else ():
            data, at = utf8(batch.column("text"))
            keys, ids = batch.column("key").to_numpy().view(U64), batch.column("doc").to_numpy()
            place, hashes, low, high = anchors(data, at)
            doc = np.searchsorted(at, place, "right") - 1
            bucket, rest = _bucketed(hashes, buckets)
            number = _asked(keys[doc], bucket, rest)
            spot = np.searchsorted(want, number)
            spot[spot == len(want)] = 0
            found = want[spot] == number
            place, doc, low, high = place[found], doc[found], low[found], high[found]
            rows = np.empty(len(place), _AROUND)
            rows["key"], rows["doc"], rows["at"], rows["first"], rows["size"] = keys[doc], ids[doc], low - at[doc], place - low, high - low + LENGTH
            order = np.argsort(bucket[found], kind="stable")
            which, rows, size = bucket[found][order], rows[order], (high - low + LENGTH)[order]
            flat = data[np.repeat(low[order], size) + _steps(size)]
            cuts = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]])) if len(which) else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum(size)])
            stops = [*cuts[1:].tolist(), len(which)]
            out += [(int(which[a]), rows[a:b].tobytes(), flat[ends[a] : ends[b]].tobytes()) for a, b in zip(cuts.tolist(), stops, strict=False)]
        columns = list(zip(*out, strict=True)) if out else [(), (), ()]
        return pa.table({"bucket": pa.array(columns[0], pa.int32()), "rows": pa.array(columns[1], pa.binary()), "bytes": pa.array(columns[2], pa.binary())})

    around = {"bucket": pa.int32(), "rows": pa.binary(), "bytes": pa.binary()}
    cut = grouped.groupBy("group").cogroup(asked.groupBy("group")).applyInArrow(_safe(surroundings, around), "bucket int, rows binary, bytes binary")

    def covers(part: pa.Table) -> pa.Table:
        rows = _covers(_together(part.column("rows"), _AROUND), _together(part.column("bytes"), np.dtype(np.uint8)))
        group, blob = _packed(mixed(rows["key"]) % U64(groups), rows)
        return pa.table({"group": group, "covers": blob})

    covered = written(cut.groupBy("bucket").applyInArrow(covers, "group int, covers binary"), "covers")
    discard(asked)

    def removed(_: tuple, texts_: pa.Table, found: pa.Table) -> pa.Table:
        rows = _together(found.column("covers"), _COVER)
        rows = rows[np.argsort(rows["key"], kind="stable")]
        out: dict[str, list] = {name: [] for name in names}
        for batch in in_parts(texts_, "text"):
            data, at = utf8(batch.column("text"))
            keys = batch.column("key").to_numpy().view(U64)
            first, last = np.searchsorted(rows["key"], keys), np.searchsorted(rows["key"], keys, "right")
            many = last - first
            mine = rows[np.repeat(first, many) + _steps(many)]
            row, bit = np.nonzero((mine["mask"][:, None] >> np.arange(SPAN, dtype=np.uint32)) & np.uint32(1))
            gone = _removed(data, at, np.repeat(at[:-1], many)[row] + mine["at"][row] + bit)
            totals = np.concatenate([[0], np.cumsum(gone, dtype=np.int64)])
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            heads = at[:-1][at[:-1] < len(gone)]
            edge[heads] = gone[heads]
            runs = np.concatenate([[0], np.cumsum(edge, dtype=np.int64)])
            raw, kept, cuts = data.tobytes(), data[~gone].tobytes(), (at - totals[at]).tolist()
            for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                left = kept[cuts[k] : cuts[k + 1]] if many[k] else raw[a:b]
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                if keep_text:
                    out["kept"].append(left)
            out["key_"] += keys.view(np.int64).tolist()
            out["doc_"] += batch.column("doc").to_pylist()
            out["n_bytes"] += np.diff(at).tolist()
            out["n_removed"] += np.diff(totals[at]).tolist()
            out["n_spans"] += np.diff(runs[at]).tolist()
        return pa.table({name: pa.array(v, names[name]) for name, v in out.items()})

    names = {"key_": pa.int64(), "doc_": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()} | ({"kept": pa.binary()} if keep_text else {})
    schema = "key_ long, doc_ long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    found = written(grouped.groupBy("group").cogroup(covered.groupBy("group")).applyInArrow(_safe(removed, names), schema), "removed")
    discard(covered, texts)
    joined = docs.select("doc_id", "key").join(found, F.col("key") == F.col("key_"))
    copy = (F.coalesce("doc_id", F.lit(LAST)) > F.col("doc_")) & (F.col("n_bytes") >= LENGTH)  # the text is an earlier document's
    nothing = F.sha2(F.lit(""), 256)
    columns = [F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"), F.when(copy, nothing).otherwise(F.col("kept_sha256")).alias("kept_sha256")]
    return joined.select("doc_id", "n_bytes", *columns, *[F.when(copy, F.lit("").cast("binary")).otherwise(F.col("kept")).alias("kept")] * keep_text)


class _Group:
    """Adds the group of each text's key."""

    def __init__(self, groups: int) -> None:
        self.groups = groups

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = (mixed(batch.column("key").to_numpy().view(U64)) % U64(self.groups)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(group), *(batch.column(c) for c in ("key", "doc", "text"))], ["group", "key", "doc", "text"])


def _safe(f, columns: dict):
    """f for groups with texts; no rows for others."""

    def run(key: tuple, texts: pa.Table, other: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({name: pa.array([], t) for name, t in columns.items()})
        return f(key, texts, other)

    return run


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_substrings(table(spark, sf_dir, "documents"))


#: Bytes as hex digits, two each.
_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)
, w AS (SELECT r, doc_id, k, substr(h, 2 * k + 1, {2 * LENGTH}) AS s FROM (SELECT r, doc_id, h, unnest(range(0, len(h) // 2 - {LENGTH - 1})) AS k FROM d) t)
, least AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s)
, hit AS (SELECT w.r, w.k FROM w JOIN least ON w.s = least.s WHERE least.m < w.doc_id)
, runs AS (SELECT r, k, CASE WHEN k <= lag(k) OVER (PARTITION BY r ORDER BY k) + {LENGTH} THEN 0 ELSE 1 END AS new FROM hit)
, gone AS (SELECT r, run, min(k) AS a, max(k) + {LENGTH} AS b FROM (SELECT r, k, sum(new) OVER (PARTITION BY r ORDER BY k) AS run FROM runs) t GROUP BY r, run)
, cuts AS (SELECT r, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a) AS n_removed, count(*) AS n_spans FROM gone GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
    sha256(unhex(CASE WHEN a IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(a) + 1),
        lambda i: substr(h, 2 * coalesce(b[i], 0) + 1, 2 * (coalesce(a[i + 1], len(h) // 2) - coalesce(b[i], 0)))), '') END)) AS kept_sha256
FROM d LEFT JOIN cuts ON d.r = cuts.r"""
QUERIES = {"op6_substrings": op6_substrings}
SQL = {"op6_substrings": _SQL}
