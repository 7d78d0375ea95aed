"""WARC archives: writing and reading records, and resolution of revisits.

Payloads never move by their digest.  Only headers (record, key, digest, length) are shuffled by
payload digest to choose the original of equal payloads; the list of revisits is joined back to the
records by record number, which no key makes uneven.  Every record is a gzip member of its own, so an
archive can be read from any record on.  Tasks join members until an archive is full (by bytes), and
Spark's text writer stores each archive as a file of one row; they are read with Spark's binary file
reader, so any store that Spark can reach will do.
"""

from __future__ import annotations

import gzip
import io
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import batch_rows, settings, stage_table

#: Fixed values of the WARC format.
VERSION, RESPONSE, REVISIT = "WARC/1.1", "response", "revisit"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
#: An empty gzip member ends each archive.  Its last byte is zero: the text writer adds that one as its separator.
ZERO = "\u0000"

RECORD = "record_id string, key string, type string, uri string, refers_to string, digest string, payload binary"


def revisits(headers: DataFrame, min_bytes: int = 100) -> DataFrame:
    """``record, original, original_key`` of the records that repeat the payload of another one.

    headers: ``record, key, digest, payload_bytes``.  Of records with an equal payload of at least
    ``min_bytes``, the original has the smallest key (a null key is largest; then the smallest
    ``record``).  Smaller payloads, and a table without copies, give no rows."""
    order = F.struct(F.col("key").isNull().alias("no_key"), "key", "record")
    long = headers.where(F.col("payload_bytes") >= min_bytes)
    originals = long.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    originals = stage_table(originals.select("digest", "first"), "warc-originals")
    return long.join(originals, "digest").where("record <> first.record").select(
        "record", F.col("first.record").alias("original"), F.col("first.key").alias("original_key"))


def _line(name: str, value: Column) -> Column:
    """A header line; line ends in a value are taken out, a null value has no line."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]+", " "), F.lit("\r\n")), F.lit(""))


def record_urn(run: str, record: Column) -> Column:
    """The id of a record: a UUID from the name of the run and the record's number, the same when a task is run again."""
    h = F.md5(F.concat(F.lit(run + ":"), record.cast("string")))
    cuts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)),
            F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.when(record.isNotNull(), F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">")))


def member(content: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(content) + packer.flush()


def write_archives(records: DataFrame, path: str, date: str | None = None, run: str | None = None,
                   file_bytes: int = 32 << 20) -> None:
    """Writes ``record, key, uri, digest, payload (string), original`` as WARC files under ``path``.

    ``original`` null: a response with the whole payload; else a revisit of that record without it.
    A null payload is an empty one; a null key or uri has no header.  ``date``: WARC-Date of all records (now);
    ``run``: a name from which record ids are made (a new one).  A file is closed when it has ``file_bytes``
    (compressed); a longer record stands in one file with what was open."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    run = run or uuid.uuid4().hex
    is_revisit = F.col("original").isNotNull()
    payload = F.coalesce("payload", F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length(payload).cast("string"), F.lit(END))
    block = F.when(is_revisit, http).otherwise(F.concat(http, payload))
    head = F.concat(
        F.lit(f"{VERSION}\r\n"), _line("WARC-Type", F.when(is_revisit, REVISIT).otherwise(RESPONSE)),
        _line("WARC-Record-ID", record_urn(run, F.col("record"))),
        _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", F.col("uri").cast("string")),
        _line("WARC-Page-Key", F.col("key").cast("string")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Refers-To", record_urn(run, F.col("original"))),
        _line("WARC-Profile", F.when(is_revisit, SAME_PAYLOAD)),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"))
    values = records.withColumn("payload", payload).withColumn("block", block).select(F.concat(head, "block", F.lit(END)).alias("value"))

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> pa.RecordBatch:
            return pa.record_batch([pa.array([b"".join([*members, member(b"")[:-1]])], pa.binary())], ["value"])

        members, size = [], 0
        for batch in batches:
            for value in batch.column(0):
                members.append(member(value.as_buffer()))
                size += len(members[-1])
                if size >= file_bytes:
                    yield close()
                    members, size = [], 0
        if members:
            yield close()

    with settings(records.sparkSession, {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}):
        (values.mapInArrow(archives, "value binary").select(F.col("value").cast("string"))
         .write.option("lineSep", ZERO).option("maxRecordsPerFile", 1).text(path))


def _bare(value: str | None) -> str | None:
    return value.removeprefix("<").removesuffix(">") if value else value


def parse(stream: io.BufferedIOBase) -> Iterator[tuple]:
    """Records of one archive, one at a time, as tuples of the fields of ``RECORD``."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"not a WARC record: {line[:80]!r}")
            continue  # the line ends after a record
        head = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            head[name.lower()] = value.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a WARC record ends early")
        yield (_bare(head.get("warc-record-id")), head.get("warc-page-key"), head.get("warc-type"), head.get("warc-target-uri"),
               _bare(head.get("warc-refers-to")), (head.get("warc-payload-digest") or "").removeprefix("sha256:") or None,
               block.partition(b"\r\n\r\n")[2])


def read_archives(spark: SparkSession, path: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """Records of the archives under ``path`` (gzip or plain), with the columns of ``RECORD``.

    Run it inside ``batch_rows(spark, 1)``: an Arrow batch then holds one archive."""
    names = [f.split()[0] for f in RECORD.split(", ")]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * 6 + [pa.binary()]
        for batch in batches:
            for content in batch.column(0):
                raw = io.BytesIO(content.as_buffer())
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if raw.read(2) == b"\x1f\x8b" else raw
                raw.seek(0)
                rows, size = [], 0
                for row in parse(stream):
                    rows.append(row)
                    size += len(row[-1])
                    if size >= batch_bytes:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(records, RECORD)


def resolve(records: DataFrame) -> DataFrame:
    """``key, payload_bytes, payload_digest, record_type, refers_to`` of each record read: a revisit gets
    length and digest of the original's payload, found by the record it refers to (null if that record
    is not there)."""
    own = records.select("record_id", "key", "type", "refers_to", F.length("payload").cast("long").alias("payload_bytes"),
                         F.sha2("payload", 256).alias("payload_digest"))
    own = stage_table(own, "warc-headers")
    responses = own.where(F.col("type") != REVISIT)
    originals = responses.select(F.col("record_id").alias("o_id"), F.col("key").alias("o_key"),
                                 F.col("payload_bytes").alias("o_bytes"), F.col("payload_digest").alias("o_digest"))
    found = own.where(F.col("type") == REVISIT).join(originals, F.col("refers_to") == F.col("o_id"), "left")
    return responses.select("key", "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
                            F.lit(None).cast("string").alias("refers_to")).unionByName(
        found.select("key", F.col("o_bytes").alias("payload_bytes"), F.col("o_digest").alias("payload_digest"),
                     F.col("type").alias("record_type"), F.col("o_key").alias("refers_to")))


def archive_table(pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html",
                  min_bytes: int = 100, file_bytes: int = 32 << 20) -> DataFrame:
    """Writes a record per row of ``pages`` (a stored table: row numbers are those of the scan) under
    ``path``, revisits for copies, and gives what :func:`resolve` finds in the archives read back."""
    text = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit(""))
    rows = pages.select(F.monotonically_increasing_id().alias("record"), F.col(f"`{key}`").alias("key"),
                        F.col(f"`{uri}`").alias("uri"), text.alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.encode("payload", "UTF-8"), 256))
    copies = revisits(rows.select("record", "key", "digest", F.octet_length("payload").alias("payload_bytes")), min_bytes)
    copies = copies.select(F.col("record").alias("copy"), "original")
    records = rows.join(copies, F.col("record") == F.col("copy"), "left")
    write_archives(records, path, file_bytes=file_bytes)
    with batch_rows(pages.sparkSession, 1):
        return resolve(read_archives(pages.sparkSession, path))
