"""WARC archives, each record its own Zstandard frame, with a dictionary built from archived records in a leading skippable
frame (.warc.zst).

Archives are written by Spark's own text writer, so a file is complete or absent whichever executors are lost, and any
file system that Spark knows will do. What the writer puts between rows is an empty skippable frame, which is plain ASCII
and which every Zstandard reader passes over.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lens.llm.common import new_path, plain, small_batches, table

DICT_MAGIC = 0x184D2A5D
EMPTY_FRAME = "P*M\x18\0\0\0\0"
#: Dictionaries come from at most so many records, and so many characters of each.
SAMPLE_ROWS, SAMPLE_CHARS, DICT_BYTES = 400, 16384, 65536
#: About so many payload bytes go to one archive; the copies of one payload are spread over so many groups.
ARCHIVE_BYTES, SALTS = 64 << 20, 32
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_URN = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None, sha: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_URN, f'{page_id}/{sha}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has the payload's HTTP head without the payload."""
    sha, revisit = digest(payload), refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id, sha)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {(url or '').replace('\r', '%0D').replace('\n', '%0A')}", f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        fields.append(f"X-Page-Id: {page_id}")
    if revisit:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to, sha)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of each record of a decompressed archive."""
    stream = io.BufferedReader(stream, 1 << 16)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode().partition(": ")
            fields[name.lower()] = value
        block = stream.read(int(fields["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record isn't followed by two line ends")
        yield fields, block


class _Raw(io.RawIOBase):
    def __init__(self, source) -> None:
        self.source = source

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        return self.source.readinto(out)


def opened(archive: bytes):
    """An archive's bytes, decompressed with the dictionary that it brings."""
    known = None
    if len(archive) >= 8 and struct.unpack_from("<I", archive)[0] == DICT_MAGIC:
        (size,) = struct.unpack_from("<I", archive, 4)
        known = zstd.ZstdCompressionDict(archive[8 : 8 + size])
    return _Raw(zstd.ZstdDecompressor(dict_data=known).stream_reader(io.BytesIO(archive), read_across_frames=True))


def dictionary(pages: DataFrame, date: str) -> bytes:
    """From the records of SAMPLE_ROWS pages, those of least hash; their bytes as they are if there are too few to train on."""
    some = pages.select(F.xxhash64("page_id", "url").alias("rank"), "page_id", "url", F.substring("html", 1, SAMPLE_CHARS).alias("html"))
    least = some.select("rank").distinct().orderBy("rank").limit(SAMPLE_ROWS).agg(F.max("rank")).first()[0]  # so that only these pages' texts are sent
    chosen = some.where(F.col("rank") <= (0 if least is None else least)).dropDuplicates(["rank"]).orderBy("rank")
    got = [record(r["page_id"], r["url"], (r["html"] or "").encode(), None, date) for r in chosen.collect()]
    try:
        return zstd.train_dictionary(DICT_BYTES, got).as_bytes()
    except (zstd.ZstdError, ValueError):
        return b"".join(got)[-DICT_BYTES:]


def write_archives(pages: DataFrame, path: str, min_payload: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Archives of pages (page_id, url, html) as path/*.warc.zst.

    Of records with equal payloads of min_payload bytes or more, that with the largest page_id is a response and others
    revisit it; all rows that share the largest page_id are responses. Null html is an empty payload; pages without an id
    revisit one with an id if there is one, else are responses; an empty table gives no archive; further columns are
    ignored. Copies of one payload are counted before they are shuffled and spread over SALTS groups.
    """
    spark = pages.sparkSession
    small_batches(spark)
    pages = plain(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    known = dictionary(pages, date)
    shared = spark.sparkContext.broadcast(known)
    sha = F.unhex(F.sha1("html"))
    sums = pages.agg(F.sum(F.octet_length("html")).alias("bytes"), F.count("*").alias("rows")).first()
    if not sums["rows"]:
        return
    n = -(-((sums["bytes"] or 0) + 500 * sums["rows"]) // ARCHIVE_BYTES)
    n = max(n, 2 * spark.sparkContext.defaultParallelism)
    copies = pages.where(F.octet_length("html") >= min_payload).groupBy(sha.alias("sha_")).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    spread = copies.select("sha_", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt_")).repartition(n, "sha_", "salt_")
    dealt = pages.withColumn("sha", sha).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).repartition(n, "sha", "salt")
    joined = dealt.join(spread, (F.col("sha") == F.col("sha_")) & (F.col("salt") == F.col("salt_")), "left")
    rows = joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = zstd.ZstdCompressionDict(shared.value) if shared.value else None
        pack = zstd.ZstdCompressor(level=3, dict_data=data, write_content_size=True)
        first = True
        for batch in batches:
            columns = (batch.column(k).to_pylist() for k in range(4))
            frames = [pack.compress(record(p, u, h.encode(), r, date)) for p, u, h, r in zip(*columns, strict=True)]
            if first and frames and shared.value:
                frames.insert(0, struct.pack("<II", DICT_MAGIC, len(shared.value)) + shared.value)
            first = first and not frames
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])

    rows.mapInArrow(run, "frame binary").select(F.col("frame").cast("string")).write.option("lineSep", EMPTY_FRAME).text(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(at):
        name = status.getPath().getName()
        if name.endswith(".txt"):
            fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(at, name.removesuffix(".txt") + ".warc.zst"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives in path, in the columns of SCHEMA. Archives whose writer didn't come to its end are
    refused; an empty folder has no rows."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if unfinished := [x.getPath().getName() for x in fs.listStatus(at) if x.getPath().getName().endswith(".txt")]:
        raise ValueError(f"the archives in {path} weren't finished: {len(unfinished)} have no name yet")
    schema = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in SCHEMA.split(", ")])

    def one(fields: dict[str, str], block: bytes) -> tuple:
        head, _, payload = block.partition(b"\r\n\r\n")
        size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        claimed = fields["warc-payload-digest"].removeprefix("sha1:")
        number = lambda name: int(fields[name]) if name in fields else None
        if fields["warc-type"] == "response" and (len(payload) != size or digest(payload) != claimed):
            raise ValueError(f"{fields['warc-record-id']} doesn't hold its payload")
        return number("x-page-id"), size, claimed, fields["warc-type"], number("x-refers-to-page-id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                for fields, block in records(opened(content.as_py())):
                    rows.append(one(fields, block))
                    if len(rows) == 4000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema.names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema.names)

    small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path)
    return files.select("content").mapInArrow(run, SCHEMA)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    write_archives(pages, path := new_path(spark, "warc"))
    if pages.isEmpty():
        return spark.createDataFrame([], SCHEMA)
    return read_archives(spark, path)


_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages)
, d AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""
QUERIES = {"op5_warc": op5_warc}
SQL = {"op5_warc": _SQL}
