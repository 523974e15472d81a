"""Packing by linear grouping: large pieces are rounded up within groups of equal size, a linear program over
configurations of these few sizes is solved, actual pieces replace the rounded ones, and small pieces fit in best.
Sequences that the actual pieces leave with more room than a limit are taken apart again, and their pieces are fitted like
small ones; of several limits the one counts that needs the fewest sequences.

Lengths are whole numbers up to the capacity, so a plan needs only how many pieces there are of each length. The plan is
made on the driver, in memory and time that don't grow with the documents; it says for each length which ranks of pieces
go where. Pieces get their ranks from counts by task, without a sort.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lens.llm.common import plain, small_batches, table, written
from lens.llm.tokens import WordEncoder

CAPACITY = 2048
#: Pieces over this part of the capacity are large; they are rounded to so many sizes; sequences may be left with so much room.
LARGE, GROUPS, ROOM = 8, (24, 96), (CAPACITY, 64, 16, 4, 0)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


@dataclass
class Plan:
    """ranges: length, first rank, rank after the last, first sequence, pieces a sequence, offset."""

    capacity: int
    ranges: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    open: dict[int, list[tuple[int, int]]] = field(default_factory=dict)  # by free tokens: first sequence, how many
    frees: int = 0  # the keys of open, as bits
    used: dict[int, int] = field(default_factory=dict)  # by length

    def new(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def put(self, length: int, base: int, bins: int, each: int, offset: int) -> None:
        rank = self.used.get(length, 0)
        self.used[length] = rank + bins * each
        self.ranges.append((length, rank, rank + bins * each, base, each, offset))

    def keep(self, free: int, base: int, bins: int) -> None:
        if free and bins:
            self.open.setdefault(free, []).append((base, bins))
            self.frees |= 1 << free

    def best_fit(self, length: int, count: int) -> None:
        """Puts pieces of one length into the open sequences with the least room that will do, as many as go in; those of
        a kind at once."""
        while count:
            if above := self.frees >> length:
                free = length + (above & -above).bit_length() - 1
                base, bins = self.open[free].pop()
                if not self.open[free]:
                    del self.open[free]
                    self.frees ^= 1 << free
            else:
                free, each = self.capacity, self.capacity // length
                bins = -(-count // each)
                base = self.new(bins)
            each = free // length
            full = min(bins, count // each)
            if full:
                self.put(length, base, full, each, self.capacity - free)
                self.keep(free - each * length, base, full)
            count -= full * each
            base, bins = base + full, bins - full
            if bins and count and count < each:
                self.put(length, base, 1, count, self.capacity - free)
                self.keep(free - count * length, base, 1)
                base, bins, count = base + 1, bins - 1, 0
            self.keep(free, base, bins)


def _knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size, any number of times, are worth most together; one more piece in each round."""
    best, taken = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        new, last = best.copy(), np.full(capacity + 1, -1)
        for k, (value, size) in enumerate(zip(values.tolist(), sizes.tolist(), strict=True)):
            gain = best[: capacity + 1 - size] + value
            better = np.flatnonzero(gain > new[size:] + 1e-12)
            new[size + better], last[size + better] = gain[better], k
        if (last < 0).all():
            break
        best = new
        taken.append(last)
    counts, room = np.zeros(len(sizes), np.int64), capacity
    for last in reversed(taken):
        if (k := int(last[room])) >= 0:
            counts[k] += 1
            room -= int(sizes[k])
    return counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 600) -> list[tuple[np.ndarray, int]]:
    """Configurations of sizes, and how often each is used, rounded down: the linear program by column generation."""
    n = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    level = np.linalg.solve(basis, demand.astype(float))
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(n))
        column = _knapsack(np.maximum(price, 0), sizes, capacity)
        if price @ column <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, column.astype(float))
        ratios = np.where(step > 1e-9, level / np.maximum(step, 1e-9), np.inf)
        out = int(ratios.argmin())
        basis[:, out] = column
        level = np.maximum(np.linalg.solve(basis, demand.astype(float)), 0)
    return [(basis[:, k].round().astype(np.int64), int(level[k] + 1e-6)) for k in range(n)]


def _configured(rest: dict[int, int], capacity: int, groups: int) -> list[tuple[int, list[tuple[int, int]], int]]:
    """Sequences of large pieces by linear grouping: how many alike, the lengths in each and how many of it, and the room left."""
    large = sorted((x for x in rest if x > capacity // LARGE), reverse=True)
    total = sum(rest[x] for x in large)
    if not total:
        return []
    runs: list[list[list[int]]] = [[]]  # for each group, [length, how many], longest first
    share, room = -(-total // groups), -(-total // groups)
    for length in large:
        left = rest[length]
        while left:
            if not room:
                runs.append([])
                room = share
            got = min(left, room)
            runs[-1].append([length, got])
            left, room = left - got, room - got
    sizes, demand, out = np.array([g[0][0] for g in runs]), np.array([sum(c for _, c in g) for g in runs]), []
    for config, times in sorted(configurations(sizes, demand, capacity), key=lambda x: -float(x[0] @ sizes)):
        wanted = [(k, int(config[k])) for k in np.flatnonzero(config)]
        while times:
            times = min([times, *(sum(c for _, c in runs[k]) // each for k, each in wanted)])
            if not times:
                break
            same = min([times, *(runs[k][0][1] // each for k, each in wanted)])
            bins, parts = max(same, 1), []
            for k, each in wanted:
                for many in [each] if same else [1] * each:
                    parts.append((runs[k][0][0], many))
                    runs[k][0][1] -= bins * many
                    if not runs[k][0][1]:
                        runs[k].pop(0)
            out.append((bins, parts, capacity - sum(length * many for length, many in parts)))
            times -= bins
    return out


def make_plan(counts: dict[int, int], capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS) -> Plan:
    """Where the pieces of each length go; counts: how many there are of each."""
    rest, best = dict(counts), None
    full, least = rest.pop(capacity, 0), -(-sum(k * n for k, n in counts.items()) // capacity)
    for many in groups:
        configured = _configured(rest, capacity, many)
        for most in ROOM:
            plan = Plan(capacity)
            if full:
                plan.put(capacity, plan.new(full), full, 1, 0)
            for bins, parts, room in configured:
                if room <= most:
                    base, offset = plan.new(bins), 0
                    for length, each in parts:
                        plan.put(length, base, bins, each, offset)
                        offset += each * length
                    plan.keep(room, base, bins)
            for length in sorted(rest, reverse=True):
                plan.best_fit(length, rest[length] - plan.used.get(length, 0))
            if best is None or plan.sequences < best.sequences:
                best = plan
            if best.sequences == least:
                return best
    return best


def pieces_of(docs: DataFrame, tokenizer: str, end: int = 0, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """docs (doc_id, text) as pieces of up to `capacity` ids; task and nth number those of one length."""
    small_batches(docs.sparkSession)
    names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, task = WordEncoder(tokenizer), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            ids, at = encoder.ids(batch.column(1), end)
            sizes = np.diff(at)
            each = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), each)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
            length = np.minimum(capacity, sizes[doc] - piece * capacity)
            order = np.argsort(length, kind="stable")
            nth = np.empty(len(length), np.int64)
            starts = np.searchsorted(length[order], length[order])
            nth[order] = np.arange(len(length)) - starts + seen[length[order]]
            seen += np.bincount(length, minlength=capacity + 1)
            raw, begin = memoryview(ids.astype("<u4").tobytes()), at[:-1][doc] + piece * capacity
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
            columns = [batch.column(0).cast(pa.int64()).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(piece * capacity), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task), pa.int32()), pa.array(nth)]
            if keep_ids:
                stops = np.concatenate([[0], np.cumsum(length)])
                columns.append(pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names)

    return plain(docs, "doc_id", "text").mapInArrow(run, PIECES + ", ids array<int>" * keep_ids)


def pack(docs: DataFrame, tokenizer: str, end: int = 0, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """A row for each piece of each row of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the ids
    themselves if asked for.

    Null and empty texts are the id `end` alone; a null doc_id stays null; equal rows are packed each; an empty table
    gives none; further columns are ignored. Pieces are written to the shared folder once, so that ranks stay as they
    are whichever executors are lost.
    """
    pieces = written(pieces_of(docs, tokenizer, end, capacity, keep_ids), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = make_plan(counts, capacity)
    ranges = np.array(plan.ranges, np.int64).reshape(-1, 6)
    ranges = ranges[np.lexsort((ranges[:, 1], ranges[:, 0]))]
    shared = pieces.sparkSession.sparkContext.broadcast(ranges)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = by_task.select(F.col("length").alias("length_"), F.col("task").alias("task_"), F.coalesce(before, F.lit(0).cast("long")).alias("before"))
    ranked = pieces.join(offsets, (F.col("length") == F.col("length_")) & (F.col("task") == F.col("task_"))).withColumn("rank", F.col("nth") + F.col("before"))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        keys = (r[:, 0] << 48) | r[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            k = np.searchsorted(keys, (length << 48) | rank, "right") - 1
            nth, each = rank - r[k, 1], r[k, 4]
            columns = [batch.column(x) for x in kept] + [pa.array(r[k, 3] + nth // each), pa.array(r[k, 5] + nth % each * length)]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids array<int>, " * keep_ids + "sequence_id long, offset long"
    return ranked.select(*kept, "rank").mapInArrow(run, schema)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


QUERIES = {"op4_packing": op4_packing}
SQL: dict[str, str] = {}
