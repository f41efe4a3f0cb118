"""WARC archives as seekable Zstandard bundles."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import written
from siltstone.session import new_path

#: Payloads with copies, or repeated ids, that are sent to all tasks at most.
SENT = 500_000
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str, copy: int | None = None) -> bytes:
    """A WARC/1.1 record. A revisit has the HTTP head alone, with the length of the payload that it stands for; a copy's number makes its id its own."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}{'' if copy is None else f':{copy}'}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], dict[str, str], bytes]]:
    """(offset, length, WARC headers, HTTP headers, payload) of each record of a frame."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        end = stop + 4 + int(head["Content-Length"])
        block = data[stop + 4 : end]
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end where it says")
        http, _, payload = block.partition(b"\r\n\r\n")
        yield at, end + 4 - at, head, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload
        at = end + 4


class BundleWriter:
    """Writes records into frames of about frame_bytes, each compressed by itself, and at the end the seek table."""

    def __init__(self, out: BinaryIO, frame_bytes: int, level: int = 3):
        import zstandard

        self.out, self.frame_bytes, self.pack = out, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.raw: list[bytes] = []
        self.size = self.written = 0
        self.table: list[tuple[int, int]] = []

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, offset there) of the record."""
        if self.size >= self.frame_bytes or self.size + len(data) >= 1 << 32:
            self.flush()
        at = (len(self.table), self.size)
        self.raw.append(data)
        self.size += len(data)
        return at

    def flush(self) -> None:
        if self.raw:
            frame = self.pack.compress(b"".join(self.raw))
            self.out.write(frame)
            self.table.append((len(frame), self.size))
            self.written += len(frame)
            self.raw, self.size = [], 0

    def finish(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()


class BundleReader:
    """Reads any frame of a bundle after its seek table."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2)
        file.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        file.seek(size - 9 - 8 * n)
        body = file.read(8 * n)
        self.table = [struct.unpack_from("<II", body, 8 * k) for k in range(n)]
        self.starts = [0]
        for packed, _ in self.table:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, k: int) -> bytes:
        import zstandard

        self.file.seek(self.starts[k])
        return zstandard.ZstdDecompressor().decompress(self.file.read(self.table[k][0]), max_output_size=self.table[k][1])

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def store(uri: str):
    """(file system, path) of a folder that Spark names by a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 0, frame_bytes: int = 1 << 20, bundle_bytes: int = 16 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each row of pages(page_id, url, html) to bundles in folder; returns their index.

    Index: (page_id, bundle, frame, offset, length), a written table. Of records with equal payloads of
    at least `least` bytes, that with the smallest page_id is a response and the others revisit it;
    smaller ones are all responses. Equality is that of SHA-1 and length. A task writes under names of
    its own attempt, and the index, which Spark commits, names the bundles of those that ended well;
    what a lost task leaves is in no index. Null html is empty; a null url has no target header; rows
    with a null page_id revisit one that has an id; repeated rows are records each, as responses all
    if theirs is the smallest id, with a number of its own in each record's id, and a revisit of such a page
    names the page alone; an empty table gives no bundles; other columns are ignored.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"sha": F.sha1("html"), "n": F.octet_length("html")})
    groups = rows.groupBy("sha", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("rows")).filter((F.col("rows") > 1) & (F.col("n") >= least))
    shared = written(groups.drop("rows"), "payloads")
    ids = written(rows.groupBy("page_id").count().filter("count > 1").select("page_id", F.lit(True).alias("repeated")), "repeated")
    # few enough, by their count, to be sent to all tasks, so that no page is shuffled; more are met by a shuffle
    sent = lambda df: F.broadcast(df) if df.count() <= SENT else df
    named = rows.join(sent(shared), ["sha", "n"], "left")
    if not ids.isEmpty():
        named = named.withColumn("id", F.col("page_id")).join(sent(ids.withColumnRenamed("page_id", "of")), F.col("id").eqNullSafe(F.col("of")), "left")
        named = named.withColumn("copy", F.when(F.col("repeated"), F.monotonically_increasing_id()))
    else:
        named = named.withColumn("copy", F.lit(None).cast("long"))
    rows = named.select("page_id", "url", "html", "first", (F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"), "copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = store(folder)
        files.create_dir(path, recursive=True)
        context, made = TaskContext.get(), 0
        writer, name = None, ""
        for batch in batches:
            index: list[tuple] = []
            for page, url, html, first, revisit, copy in zip(*(batch.column(k) for k in range(6)), strict=True):
                if writer is None:
                    name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{made:04d}.warc.zst"
                    writer, made = BundleWriter(files.open_output_stream(f"{path}/{name}", compression=None), frame_bytes), made + 1
                page = page.as_py()
                data = record(page, url.as_py(), html.as_py().encode("utf-8", "replace"), first.as_py(), revisit.as_py(), date, copy.as_py())
                index.append((page, name, *writer.add(data), len(data)))
                if writer.written >= bundle_bytes:
                    writer.finish()
                    writer = None
            columns = list(zip(*index, strict=True)) if index else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["page_id", "bundle", "frame", "offset", "length"]
            )
        if writer is not None:
            writer.finish()

    index = written(rows.mapInArrow(run, "page_id long, bundle string, frame int, offset long, length long"), "index")
    return index.withColumn("bundle", F.concat(F.lit(folder + "/"), "bundle"))


def read_archives(index: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record in the index's bundles, read frame by frame.

    A response's payload is digested anew and must agree with its header.
    """
    bundles = index.select("bundle").distinct()
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def number(text: str | None) -> int | None:
        text = (text or "").removeprefix("<urn:page:").removesuffix(">").partition(":")[0]
        return None if text in ("", "None") else int(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                files, path = store(uri)
                with files.open_input_file(path) as file:
                    reader = BundleReader(file)
                    for k in range(len(reader.table)):
                        rows = []
                        for _, _, head, http, payload in records(reader.frame(k)):
                            said, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                            if kind == "response" and digest(payload) != said:
                                raise ValueError(f"{uri}: {head['WARC-Record-ID']} is damaged")
                            rows.append((number(head["WARC-Record-ID"]), len(payload) if kind == "response" else int(http["Content-Length"]), said, kind, number(head.get("WARC-Refers-To"))))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names)

    parts = min(10_000, max(1, bundles.count()))
    return bundles.repartition(parts).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def fetch(index: DataFrame, page_id: int) -> list[bytes]:
    """The records of one page, each from the one frame that holds it."""
    out = []
    for r in index.filter(F.col("page_id") == page_id).collect():
        files, path = store(r.bundle)
        with files.open_input_file(path) as file:
            out.append(BundleReader(file).record(r.frame, r.offset, r.length))
    return out


#: Five hexadecimal digits are four of base 32.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS n, sha1(h) AS x FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x, n) AS first FROM s)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
