"""WARC archives: a writer and a sequential reader.

Every record is a gzip member of its own. The reader inflates member by member with an incremental
decompressor over blocks of the file, frames the block of a record by its Content-Length, and checks
block and payload digests, so it holds one record at a time.

Records with equal payloads: the one with the smallest page_id is a response, the others are revisits
of it that carry no payload. Payloads shorter than min_bytes are always responses.

Nulls: a null html is an empty payload; a null url is written as an empty target; a null page_id is
kept as null, never is the first of its payload beside a numbered one, and is a response where no
numbered row has that payload. Repeated rows are written once each; those that share the smallest
page_id of their payload are all responses. Record ids are unique by archive and place, so rows that share a
page_id don't share one. Empty tables give no archive and no row. Further columns are left aside.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, fresh, text_or_empty

# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_FIELD = "X-Page-Id"

DATE = "2020-01-01T00:00:00Z"
BLOCK = 1 << 16
SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html binary, archive string, at long"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(place: str) -> str:
    """The id of the record at a place that no other record has."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>"


def clean(url: str) -> str:
    """Control characters and white space would break the header's lines."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def make_record(place: str, page_id: int | None, url: str, payload: bytes, first: tuple[int, str] | None = None) -> bytes:
    """A record; with first (page_id, url) a revisit of that page."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first else http + payload
    fields = [
        VERSION,
        f"WARC-Type: {'revisit' if first else 'response'}",
        f"WARC-Record-ID: {record_id(place)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean(url)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if page_id is not None:
        fields.append(f"{PAGE_FIELD}: {page_id}")
    if first:
        fields += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To-Target-URI: {clean(first[1])}", f"WARC-Refers-To-Date: {DATE}", f"{PAGE_FIELD}-Refers-To: {first[0]}"]
    fields.append(f"Content-Length: {len(block)}")
    whole = "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(whole) + z.flush()


class Members:
    """The gzip members of a stream, one after another, inflated block by block."""

    def __init__(self, stream, block: int = BLOCK):
        self.stream, self.block, self.raw, self.read = stream, block, b"", 0

    def more(self) -> bool:
        if not self.raw:
            self.raw = self.stream.read(self.block)
            self.read += len(self.raw)
        return bool(self.raw)

    def __iter__(self) -> Iterator[tuple[int, Iterator[bytes]]]:
        while self.more():
            at = self.read - len(self.raw)
            parts = self.inflate(at)
            yield at, parts
            for _ in parts:  # what the caller left
                pass

    def inflate(self, at: int) -> Iterator[bytes]:
        z = zlib.decompressobj(31)
        while not z.eof:
            if not self.more():
                raise ValueError(f"the member at byte {at} is cut short")
            data = z.decompress(self.raw)
            self.raw = z.unused_data
            if data:
                yield data


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0]!r}")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        if line[:1] in " \t" and fields:  # a folded line
            last = next(reversed(fields))
            fields[last] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
    return fields


def read_record(parts: Iterator[bytes], at: int) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one member; framing and the block's digest are checked."""
    got = bytearray()
    end = -1
    for data in parts:
        got += data
        if (end := got.find(b"\r\n\r\n", max(0, len(got) - len(data) - 3))) >= 0:
            break
    if end < 0:
        raise ValueError(f"the record at byte {at} has no end of header")
    fields = parse_head(bytes(got[:end]))
    length = int(fields["content-length"])
    for data in parts:
        got += data
    body = bytes(got[end + 4 : end + 4 + length])
    if len(body) != length or bytes(got[end + 4 + length :]) != b"\r\n\r\n":
        raise ValueError(f"the record at byte {at} has {len(got) - end - 8} bytes in its block, its header says {length}")
    if (said := fields.get("warc-block-digest")) and said != f"sha1:{base32_sha1(body)}":
        raise ValueError(f"the block digest of the record at byte {at} is wrong")
    return fields, body


def read_archive(stream, block: int = BLOCK) -> Iterator[tuple[int, dict[str, str], int, bytes | None]]:
    """(byte, header fields, payload's length, payload or None for a revisit) of each record of a stream."""
    for at, parts in Members(stream, block):
        fields, body = read_record(parts, at)
        head, _, payload = body.partition(b"\r\n\r\n")
        http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
        length = int(http["content-length"])
        if fields["warc-type"] == "revisit":
            yield at, fields, length, None
            continue
        if len(payload) != length or fields["warc-payload-digest"] != f"sha1:{base32_sha1(payload)}":
            raise ValueError(f"the payload digest of the record at byte {at} is wrong")
        yield at, fields, length, payload


def with_firsts(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, html and __first (page_id, url): the row with the smallest page_id of the payload, null for payloads under min_bytes or of one row."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), text_or_empty("url").alias("url"), text_or_empty("html").alias("html"))
    large = rows.filter(F.octet_length("html") >= min_bytes) if min_bytes > 0 else rows
    large = large.withColumn("__key", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    numbered = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    firsts = large.groupBy("__key").agg(F.min(numbered).alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__key", "__first")
    out = large.join(firsts, "__key", "left").drop("__key")  # a hot payload: the join's partition is split at run time
    if min_bytes > 0:
        out = out.unionByName(rows.filter(F.octet_length("html") < min_bytes), allowMissingColumns=True)
    return out.select("page_id", "url", "html", F.col("__first.page_id").alias("__first"), F.col("__first.url").alias("__first_url"))


def write_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes one archive for each partition into the shared folder; returns (archive, records, bytes)."""
    spark = pages.sparkSession
    root = fresh(spark, "warc")
    files, path = file_system(root)
    files.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, n = None, "", 0
        fs, top = file_system(root)
        ctx = TaskContext.get()
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None:
                    name = f"{top}/part-{ctx.partitionId():06d}.warc.gz"
                    out = fs.open_output_stream(f"{name}.{ctx.taskAttemptId()}", compression=None)
                page_id, url, html, first, first_url = r
                out.write(make_record(f"{root}/{ctx.partitionId()}/{n}", page_id, url, html.encode(), (first, first_url) if first is not None and page_id != first else None))
                n += 1
        if out is not None:
            size = out.tell()
            out.close()
            fs.move(f"{name}.{ctx.taskAttemptId()}", name)  # whole or absent, also when a task runs twice
            yield pa.record_batch([pa.array([f"{root}/{name.rpartition('/')[2]}"]), pa.array([n]), pa.array([size])], names=["archive", "records", "bytes"])

    made = with_firsts(pages, min_bytes).mapInArrow(write, "archive string, records long, bytes long").collect()  # a row for each archive
    return spark.createDataFrame([tuple(r) for r in made], "archive string, records long, bytes long")


def read_archives(spark: SparkSession, archives: list[str], payloads: bool = True) -> DataFrame:
    """A row for each record of the archives, read one after another: SCHEMA; html is null for revisits."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive in b.column(0).to_pylist():
                fs, path = file_system(archive)
                with fs.open_input_stream(path, compression=None) as stream:
                    rows, size = [], 0
                    for at, f, length, payload in read_archive(stream):
                        page, refers = (int(x) if (x := f.get(k.lower())) else None for k in (PAGE_FIELD, f"{PAGE_FIELD}-Refers-To"))
                        rows.append((page, f["warc-target-uri"], length, f["warc-payload-digest"].removeprefix("sha1:"), f["warc-type"], refers, payload if payloads else None, archive, at))
                        size += length
                        if size > 4 << 20 or len(rows) >= 2000:
                            yield batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield batch(rows)

    names = spark.createDataFrame([(a,) for a in archives], "archive string")
    return names.repartition(max(1, len(archives))).mapInArrow(read, SCHEMA)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
