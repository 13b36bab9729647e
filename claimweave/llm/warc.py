"""WARC archives: a deduplicating writer and a splittable reader.

Every record is a gzip member of its own. The reader deals out byte ranges: a task scans its range for the gzip
magic, takes a candidate for a member only if it decodes to a WARC version line, and owns the records that start
inside its range, reading past the range's end to finish the last one.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from claimweave.llm.common import Scratch, small_batches

LEAST_REVISIT = 100
SPLIT_BYTES = 8 << 20
FILE_BYTES = 256 << 20
_READ = 1 << 16
#: Fixed values of the WARC 1.1 format.
_MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"


def decided(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, digest, refers_to`` per row: refers_to is null for a response."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = rows.where(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")
    ).where("n > 1").drop("n")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(first, "digest", "left").select("page_id", "url", "payload", "digest", F.when(other, F.col("first")).alias("refers_to"))


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member. A revisit holds the HTTP head, whose Content-Length tells the payload's size, and no payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        "WARC-Type: " + ("response" if refers_to is None else "revisit"), f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}"
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response"]
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(_VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def write_archives(pages: DataFrame, folder: str, scratch: Scratch) -> DataFrame:
    """Archives of ``pages(page_id, url, html)`` in a shared folder -> ``(path, bytes)`` of the files that count.

    Of equal payloads of LEAST_REVISIT bytes or more, the rows with the smallest page_id are responses and the others
    revisits; smaller ones are all responses. A null html is an empty payload. A null page_id is never the smallest
    unless there is no other. Repeated rows are records of their own, of equal kind. An empty table gives no files.
    A task that runs again writes new files; the list, written once, names only those of the task that succeeded.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        out, done, size, path = None, [], 0, ""
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                if out is None:
                    path, size = f"{top}/{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(path, compression=None)
                member = _record(*row)
                out.write(member)
                size += len(member)
                if size >= FILE_BYTES:
                    out.close()
                    done.append((path, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size))
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{folder}{p.removeprefix(top)}" for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())],
            ["path", "bytes"]
        )

    return scratch.table(decided(pages).mapInArrow(run, "path string, bytes long"), "files")


class _Window:
    """Bytes of one file from a position on, read in pieces and forgotten behind it."""

    def __init__(self, file, at: int):
        self.file, self.at, self.buffer = file, at, b""
        file.seek(at)

    def more(self) -> bool:
        got = self.file.read(_READ)
        self.buffer += got
        return bool(got)

    def skip(self, n: int) -> None:
        self.at, self.buffer = self.at + n, self.buffer[n:]


def _starts_record(data: bytes) -> bool | None:
    """Whether data begins with a member that decodes to a WARC head; None if too short to tell."""
    try:
        got = zlib.decompressobj(31).decompress(data, len(_VERSION))
    except zlib.error:
        return False
    return got.startswith(b"WARC/1.") if len(got) >= len(_VERSION) else None


def records(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded record) of each record that starts in [start, end) of an open file."""
    w = _Window(file, start)
    while w.at < end:
        k = w.buffer.find(_MAGIC)
        if k < 0:
            w.skip(max(0, len(w.buffer) - len(_MAGIC) + 1))
            if not w.more():
                return
            continue
        w.skip(k)
        if w.at >= end:
            return
        while (is_record := _starts_record(w.buffer[:4096])) is None and len(w.buffer) < 4096:
            if not w.more():
                break
        if not is_record:
            w.skip(1)
            continue
        at, z, parts = w.at, zlib.decompressobj(31), []
        while True:
            parts.append(z.decompress(w.buffer))
            if z.eof:
                w.skip(len(w.buffer) - len(z.unused_data))
                break
            w.skip(len(w.buffer))
            if not w.more():
                raise ValueError(f"the record at {at} is cut off")
        yield at, b"".join(parts)


def parsed(record: bytes) -> dict:
    """Fields of one record, its payload among them (None for a revisit)."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    ident = lambda k: int(m[1]) if (m := re.search(r"urn:page:(-?\d+)", fields.get(k, ""))) else None
    kind = fields["WARC-Type"]
    digest = hashlib.sha256(payload).hexdigest() if kind == "response" else fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if digest != fields["WARC-Payload-Digest"].removeprefix("sha256:") or kind == "response" and len(payload) != size:
        raise ValueError("a payload differs from its digest")
    return {
        "page_id": ident("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest,
        "record_type": kind, "refers_to": ident("WARC-Refers-To"), "payload": payload if kind == "response" else None
    }


_FIELDS = {
    "page_id": "long", "url": "string", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long",
    "payload": "binary"
}


def read_archives(spark: SparkSession, files: DataFrame, columns: tuple[str, ...] = tuple(_FIELDS), split: int = SPLIT_BYTES) -> DataFrame:
    """Records of ``files(path, bytes)``: the named columns, one row per record. Payloads are decoded one at a time."""
    ranges = files.where("bytes > 0").select(
        "path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start")
    )
    schema = pa.schema([(c, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[_FIELDS[c]]) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                store, path = pafs.FileSystem.from_uri(uri)
                rows, held = [], 0
                with store.open_input_file(path) as file:
                    for _, record in records(file, start, start + split):
                        row = parsed(record)
                        rows.append({c: row[c] for c in columns})
                        held += len(record) if "payload" in columns else 200
                        if held > 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    dealt = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "start")
    return dealt.mapInArrow(run, ", ".join(f"{c} {_FIELDS[c]}" for c in columns))


def round_trip(pages: DataFrame, columns: tuple[str, ...] = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back."""
    scratch = Scratch(pages.sparkSession, "warc")
    return read_archives(pages.sparkSession, write_archives(pages, scratch.path("archives"), scratch), columns)


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS b, sha256(coalesce(html, '')) AS d FROM pages),
     f AS (SELECT d, min(page_id) AS first FROM p WHERE b >= 100 GROUP BY d)
SELECT page_id, b AS payload_bytes, p.d AS payload_digest,
       CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
