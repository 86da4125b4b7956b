"""WARC archives: written one gzip member per record, read in byte ranges.

Writing goes through Spark's own text writer, so that files are committed with their tasks and
may lie in any store. A row's member is written without its last byte, the highest of the
length field, which is zero for records below 16 MiB; the row separator, a zero byte, takes its
place. A longer record is written whole, and the separator becomes the zero padding that gzip
allows after a member.

Reading: a task takes a byte range of a file, looks for the gzip magic, decodes a candidate's first bytes
and takes it as a record if a WARC version line comes out. It owns the records that start in its range and
reads the last one to its end beyond it. A record that starts in a range is found in that range
alone, so ranges need no common index and may be run again at any time.
A stored (not compressed) block that itself holds an archive can't be told from a record.

Defined results: a null payload is empty; a null url is left out; of records with equal payloads, that with
the largest id holds it, a null id being smaller than any other; where all ids are null, or
rows repeat that largest id, each holds it; texts of any length are one record; an empty table
gives archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffscope.llm.common import Scratch

MAGIC = b"\x1f\x8b\x08"
SEPARATOR = "\x00"
DATE = "2026-01-01T00:00:00Z"
RANGE_BYTES = 8 << 20
STEP = 1 << 18
MOST_TASKS = 100_000


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(page_id, url, payload: bytes, kept_by) -> bytes:
    """One record as a gzip member; ``kept_by`` is the id whose record holds an equal payload."""
    revisit = kept_by is not None and kept_by != page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    if revisit:
        fields.append(("WARC-Refers-To", f"<urn:page:{kept_by}>"))
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()
    return member[:-1] if member.endswith(b"\0") else member


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            rows = batch.slice(at, 64).to_pylist()
            members = [_member(r["page_id"], r["url"], r["payload"], r["kept_by"]) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], ["member"])


def write(pages: DataFrame, folder: str) -> None:
    """Archives of ``pages`` (page_id, url, html) in ``folder``, equal payloads written once."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    # Only payloads that occur twice or more have anything to say to the rows.
    shared = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("kept_by"))
    rows = rows.join(shared.where("n > 1").drop("n"), "digest", "left")
    members = rows.select("page_id", "url", "payload", "kept_by").mapInArrow(_members, "member binary")
    members.select(F.col("member").cast("string")).write.option("lineSep", SEPARATOR).text(folder)


def open_shared(uri: str):
    """A seekable file of any store that pyarrow knows."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return open(uri.removeprefix("file://").removeprefix("file:"), "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def _decode(file: io.IOBase, start: int) -> tuple[bytes, int] | None:
    """The record whose member starts at ``start``, and where the member ends; None if none does."""
    decoder, parts, at, first = zlib.decompressobj(31), [], start, True
    file.seek(start)
    try:
        while not decoder.eof:
            chunk = file.read(4096 if first else STEP)
            if not chunk:
                return None
            at += len(chunk)
            parts.append(decoder.decompress(chunk))
            if first and not parts[0].startswith(b"WARC/"):
                return None
            first = False
    except zlib.error:
        return None
    return b"".join(parts), at - len(decoder.unused_data)


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in lines.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def records_in(file: io.IOBase, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, fields and block of the records that start at ``start`` or later and before ``end``."""
    at, held, base = start, b"", start
    while at < end:
        if not base <= at <= base + len(held) - len(MAGIC):
            file.seek(at)
            base, held = at, file.read(STEP)
            if len(held) < len(MAGIC):
                return
        found = held.find(MAGIC, at - base)
        if found < 0:
            at = base + len(held) - len(MAGIC) + 1
            continue
        at = base + found
        if at >= end:
            return
        decoded = _decode(file, at)
        if decoded is None:
            at += 1
            continue
        record, after = decoded
        head, _, rest = record.partition(b"\r\n\r\n")
        fields = _fields(head)
        yield at, fields, rest[: int(fields.get("content-length", len(rest)))]
        at = after


def _id(field: str | None) -> int | None:
    digits = (field or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _read_ranges(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), *([("payload", pa.binary())] if with_payload else []),
    ])
    for batch in batches:
        for part in batch.to_pylist():
            rows, held = [], 0
            with open_shared(part["path"]) as file:
                for _, fields, block in records_in(file, part["start"], part["stop"]):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    kind = fields.get("warc-type")
                    row = {
                        "page_id": _id(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"),
                        "record_type": kind, "refers_to": _id(fields.get("warc-refers-to")),
                    }
                    if kind == "revisit":  # what it says of the payload, which another record holds
                        row["payload_bytes"] = int(_fields(head).get("content-length", 0))
                        row["payload_digest"] = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                        row["payload"] = None
                    else:
                        row["payload_bytes"] = len(payload)
                        row["payload_digest"] = payload_digest(payload)
                        row["payload"] = payload
                    rows.append(row)
                    held += len(payload)
                    if len(rows) >= 1000 or held > STEP * 16:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES, with_payload: bool = True) -> DataFrame:
    """The records of the archives in ``folder``: page_id, url, payload_bytes, payload_digest, record_type, refers_to
    and, unless left out, payload (null for revisits). Sizes and digests of responses are
    those of the payload that was read."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length").where("length > 0")
    ranges = files.select(
        "path", F.explode(F.expr(f"sequence(0L, length - 1, {range_bytes}L)")).alias("start")
    ).withColumn("stop", F.col("start") + range_bytes)
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    # Rows are small and their work is not: a number of tasks that adaptive execution doesn't merge.
    tasks = max(1, min(ranges.count(), MOST_TASKS))
    return ranges.repartition(tasks, F.xxhash64("path", "start")).mapInArrow(
        lambda batches: _read_ranges(batches, with_payload), schema + (", payload binary" if with_payload else "")
    )


def round_trip(pages: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``pages`` written to archives in the shared folder, and the records read back."""
    folder = Scratch(pages.sparkSession, "warc").path("archives")
    write(pages, folder)
    return read(pages.sparkSession, folder, range_bytes, with_payload=False).drop("url")
