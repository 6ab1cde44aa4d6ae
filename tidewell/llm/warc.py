"""WARC: records written through Spark's own writer, and a salvage reader.

The writer makes uncompressed WARC 1.1 files (header, blank line, block, two line ends), any file system that Spark knows will do. Of records with
equal payloads of at least LEAST_REVISIT bytes, that with the smallest id is a response and the others are revisits, which have
no block. Which digests occur more than once is found first, on digests alone; if they are few (their number is checked) they
are broadcast, else joined, so that payloads move only then.

The reader takes files as bytes. It checks each record (version line, header, length, the line ends after it, digest). A record whose digest alone is wrong, its frame
ending where the next begins, is quarantined as a whole, so that what its payload holds cannot pass for records. After any other failed check the reader searches for the next
version line (or gzip member that opens with one) and goes on there; as that may lie in a payload, a record is then taken only with a right digest or with all fields that WARC demands. What is
between is logged as a quarantined range of bytes. In a gzip archive a broken member costs itself alone. Every byte is searched once and unpacked once, so that
work is in proportion to the file.

Null payloads are empty. A null id is written as no id and comes back null; equal payloads whose ids are all null are all
responses, as is every row that shares the smallest id. Repeated rows give repeated records, each with its own record id. A very long payload is one record, in a file of its own;
reading needs memory for a file, and Spark's reader takes none beyond 2 GB, at which it fails. An empty table gives an empty
result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import shared_dir, table, written

VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_REVISIT = 100
FILE_BYTES = 16 << 20
#: Digests that occur more than once are broadcast up to this number, 100 bytes each.
BROADCAST_ROWS = 200_000
MOST_HEADER = 1 << 16
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
#: What every record has to state; records found after a search have it all or a right digest.
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
#: Bytes given to the decompressor at once, at first and at most.
LEAST_BITE, MOST_BITE = 1 << 12, 1 << 20


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    payload: bytes
    sure: bool = True  # a right digest or every mandatory field


@dataclass
class Salvaged:
    records: list[Record] = field(default_factory=list)
    gaps: list[tuple[int, int, str]] = field(default_factory=list)  # first byte, end, why


def _record(data: bytes, at: int) -> tuple[Record | None, int, str]:
    """The record at a place, where it ends (or where to go on at the earliest), and what is wrong with it."""
    if not VERSION_LINE.match(data, at):
        return None, at, "no version line"
    head = data.find(b"\r\n\r\n", at, at + MOST_HEADER)
    if head < 0:
        return None, at, "header without end"
    headers = {}
    for line in data[at + 10 : head].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            return None, at, "header line without colon"
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not re.fullmatch(r"\d{1,18}", length):
        return None, at, "no length"
    begin = head + 4
    end = begin + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return None, at, "no line ends where the block should end"
    payload = data[begin:end]
    kind, _, stated = headers.get("warc-block-digest", "").partition(":")
    if kind == "sha256" and stated != hashlib.sha256(payload).hexdigest():
        framed = end + 4 == len(data) or VERSION_LINE.match(data, end + 4)
        return None, end + 4 if framed else at, "wrong digest"
    return Record(at, headers, payload, kind == "sha256" or all(headers.get(x) for x in MANDATORY)), end + 4, ""


def _member(data: bytes, at: int) -> tuple[bytes | None, int]:
    """The gzip member at a place, unpacked, and where it ends."""
    unpack, out, bite = zlib.decompressobj(31), [], LEAST_BITE
    try:
        while not unpack.eof and at < len(data):
            part = data[at : at + bite]
            out.append(unpack.decompress(part))
            at += len(part) - len(unpack.unused_data)
            bite = min(2 * bite, MOST_BITE)
    except zlib.error:
        return None, at
    return (b"".join(out), at) if unpack.eof else (None, at)


def salvage(data: bytes) -> Salvaged:
    """All records that can be read; the rest as gaps. Offsets are in data as given; members may hold several records."""
    found, at, n = Salvaged(), 0, len(data)
    bad, why = None, ""

    def close(to: int) -> None:
        nonlocal bad
        if bad is not None and to > bad:
            found.gaps.append((bad, to, why))
        bad = None

    while at < n:
        if data[at : at + 3] == b"\x1f\x8b\x08":
            out, end = _member(data, at)
            inner = salvage(out) if out is not None and out[:5] == b"WARC/" else None
            if inner is not None and inner.records:
                close(at)
                found.records += [Record(at, r.headers, r.payload) for r in inner.records]
                if inner.gaps:
                    found.gaps.append((at, end, "in the member: " + inner.gaps[0][2]))
                at = end
                continue
            reason = "broken member" if out is None else "member without record"
        else:
            record, end, reason = _record(data, at)
            if record is not None and (bad is None or record.sure):
                close(at)
                found.records.append(record)
                at = end
                continue
            if record is not None:
                reason, end = "found by search, without digest or mandatory fields", at
            if bad is None:
                bad, why = at, reason
            if end > at:
                at = end
                close(at)
                continue
        if bad is None:
            bad, why = at, reason
        again = START.search(data, at + 1)
        at = again.start() if again else n
    close(n)
    return found


def _header(date: str, kind: Column, row: Column, target: Column, digest: Column, n_bytes: Column, refers: Column, block_digest: Column, length: Column) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    optional = lambda name, value: F.coalesce(line(name, value.cast("string")), F.lit(""))
    return F.concat(
        F.lit(VERSION.decode()), line("WARC-Type", kind), line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">"))), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", target), optional("WARC-Page-ID", row), optional("WARC-Profile", F.when(kind == "revisit", F.lit(PROFILE))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)), line("WARC-Payload-Length", n_bytes.cast("string")), optional("WARC-Refers-To-Page", refers),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), block_digest)), line("Content-Type", F.lit("text/html")), line("Content-Length", length.cast("string")), F.lit("\r\n"),
    )


def write_warc(pages: DataFrame, path: str, id_column: str = "page_id", payload_column: str = "html", url_column: str | None = None, file_bytes: int = FILE_BYTES, date: str | None = None) -> None:
    """A record for each row of pages, in files of about file_bytes under path; a file has one record if that alone is larger.

    date: as WARC has it, else now. Without a URL (null, or no url_column) the target is a name made of the id. Line ends in a URL are escaped."""
    date = date or time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
    payload, row = F.coalesce(F.col(f"`{payload_column}`"), F.lit("")), F.col(f"`{id_column}`").cast("long")
    url = F.replace(F.replace(F.col(f"`{url_column}`").cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")) if url_column else F.lit(None).cast("string")
    rows = pages.select(row.alias("id"), payload.alias("payload"), F.coalesce(F.nullif(url, F.lit("")), F.concat(F.lit("urn:page:"), F.coalesce(row.cast("string"), F.lit("none")))).alias("target"))
    n_bytes, digest = F.octet_length("payload").cast("long"), F.sha2(F.encode("payload", "UTF-8"), 256)
    light = written(rows.select("id", n_bytes.alias("n"), digest.alias("digest")), "digests")
    total = light.agg(F.count("*").alias("rows"), F.sum("n").alias("bytes"), F.max("n").alias("most")).first()
    usual = (total["bytes"] or 0) / max(1, total["rows"]) + 512
    twice = written(light.where(F.col("n") >= LEAST_REVISIT).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("many")).where("many > 1 AND first IS NOT NULL").select("digest", "first"), "repeated")
    few = twice.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = rows.select("id", "payload", "target", n_bytes.alias("n"), digest.alias("digest"))
    rows = rows.join(F.broadcast(twice) if few else twice, "digest", "left")
    revisit = F.coalesce(~F.col("id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    block = F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload"))
    length = F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("n"))
    block_digest = F.when(F.col("revisit"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("digest"))
    kind, refers = F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")), F.when(F.col("revisit"), F.col("first"))
    rows = rows.withColumn("revisit", revisit)
    value = F.concat(_header(date, kind, F.col("id"), F.col("target"), F.col("digest"), F.col("n"), refers, block_digest, length), block)
    edge = int(16 * usual)
    small = F.col("n") <= edge
    save = lambda part, each: part.select(value.alias("value")).write.mode("append").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", max(1, int(each))).text(path)
    save(rows.where(small), file_bytes / usual)
    if (total["most"] or 0) > edge:
        save(rows.where(~small), 16 * file_bytes / (total["most"] + 512))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record found under path (page_id, record_type, refers_to, payload_bytes, payload_digest) and for each gap.

    Gaps have record_type gap, and file, first_byte, end_byte and reason; payload_bytes and payload_digest are of the bytes read, of a
    revisit those it states."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "file", "first_byte", "end_byte", "reason"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        number = lambda x: int(x) if x is not None else None
        for batch in batches:
            for k in range(batch.num_rows):
                file = batch.column(0)[k].as_py()
                found, rows = salvage(batch.column(1)[k].as_buffer().to_pybytes()), []
                for r in found.records:
                    h = r.headers
                    revisit = h.get("warc-type") == "revisit"
                    size = number(h.get("warc-payload-length")) if revisit else len(r.payload)
                    digest = h.get("warc-payload-digest", "").removeprefix("sha256:") if revisit else hashlib.sha256(r.payload).hexdigest()
                    rows.append([number(h.get("warc-page-id")), h.get("warc-type"), number(h.get("warc-refers-to-page")), size, digest, file, r.offset, None, None])
                rows += [[None, "gap", None, None, None, file, lo, hi, why] for lo, hi, why in found.gaps]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], x) for x in kinds], names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, file string, first_byte long, end_byte long, reason string")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path, url_column="url")
    return read_warc(spark, path).where("record_type <> 'gap'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
