"""What the operators share: places on shared storage, Arrow batches as numpy arrays, hashes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by bytes as well as by rows: one text can be a thousand times another."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


_own: dict[str, str] = {}  # by application


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A folder of this machine is used only on a
    local master, where driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="lens-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        found = _own[app]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lens/{name}-{uuid.uuid4().hex}"


_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df as a table in the shared folder, read back. A lost executor costs only the tasks it ran. The
    shuffle files of the plan go once the table is there."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(_RELEASE, "false")
    spark.conf.set(_RELEASE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_RELEASE, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.lens_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that written() made and that nothing reads any more."""
    for df in tables:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.lens_path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: Sides of joins with so many rows are never sent to the driver and from there to all executors.
SENT = 50_000


def by_rows(df: DataFrame, rows: int) -> DataFrame:
    """df as a side of a join, shuffled where it has more than SENT rows. Spark goes by the bytes of its files, and a file of
    rows that repeat each other can be a thousandth of what they take in the driver's memory."""
    return df.hint("merge") if rows > SENT else df


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, nulls as empty, and where each row starts (one more at the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def in_parts(batch: pa.RecordBatch | pa.Table, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about `most` bytes of a column's text, for steps that need many bytes for each."""
    for rows in [batch] if isinstance(batch, pa.RecordBatch) else batch.to_batches():
        sizes = pc.fill_null(pc.binary_length(rows.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                yield rows.slice(a, b - a)


def byte_set(*parts: bytes | range) -> np.ndarray:
    found = np.zeros(256, bool)
    for part in parts:
        found[list(part)] = True
    return found


#: space, tab to carriage return
BLANK = byte_set(b" ", range(9, 14))


def spans(mask: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of True; runs end where rows end."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.empty(len(mask) + 1, bool)
    edge[1:-1] = mask[1:] != mask[:-1]
    edge[0] = edge[-1] = True
    cuts = at[(at > 0) & (at < len(mask))]
    edge[cuts] = True
    places = np.flatnonzero(edge)
    first, last = places[:-1], places[1:]
    keep = mask[first]
    return first[keep], last[keep]


def rows_of(places: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The row that each byte position is in."""
    return np.searchsorted(at, places, "right") - 1


_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _grown(n: int) -> None:
    if len(_powers[0]) <= n:
        size = n + n // 8 + 1
        inverse = U64(pow(int(_BASE), -1, 1 << 64))
        for k, factor in enumerate((_BASE, inverse)):
            run = np.full(size, factor, U64)
            run[0] = 1
            _powers[k] = np.multiply.accumulate(run)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all others."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def span_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: differences of running sums of table[byte] * base ** place, moved to place 0."""
    _grown(len(data))
    sums = np.empty(len(data) + 1, U64)
    sums[0] = 0
    np.cumsum(_TABLE[data] * _powers[0][: len(data)], out=sums[1:])
    return mixed((sums[last] - sums[first]) * _powers[1][first] + (last - first).astype(U64))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    table_ = np.arange(256, dtype=np.uint8)
    table_[65:91] += 32
    return table_[data]


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each place on; short by n - 1 at the end."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    total = words[:m].copy()
    for k in range(1, n):
        total *= _BASE
        total += words[k : k + m]
    return mixed(total)


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that others with clashing names don't matter."""
    return df.select(*[df[c] for c in columns])
