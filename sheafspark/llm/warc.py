"""Operator 1: WARC archives as seekable Zstandard bundles.

Records are grouped into frames of about FRAME_BYTES that decompress independently; a bundle ends with a seek table in
a skippable frame. The index maps each record to its bundle, frame and offset within the frame. A record whose payload
equals an earlier one (the smallest page_id among equal payloads of REVISIT_BYTES or more) is written as a revisit.

Bundles are files in a folder that all executors share, named uniquely by task attempt; the index, which Spark commits
once, names only those of attempts that counted, so a lost or repeated attempt leaves at most a file no one reads.

A null html is an empty payload, a null url is left out of the record, a null page_id is never a response's rival:
it revisits if any numbered page has its payload. Repeated rows with the smallest page_id are all responses. An empty
table gives no bundle and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafspark.llm.common import scratch, stored, table

FRAME_BYTES = 256 * 1024
BUNDLE_BYTES = 64 * 1024 * 1024
REVISIT_BYTES = 100
DATE = "2000-01-01T00:00:00Z"

#: Marks of the seekable format's skippable frame and of its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, record_id string, bundle string, frame int, offset long, length long"


def record_id(page_id: int | None) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit's block has the HTTP head only, its headers the full payload's digest and length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(page_id)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to)}>", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


class BundleWriter:
    """Appends records to one bundle; close() writes the seek table."""

    def __init__(self, out) -> None:
        import zstandard

        self.out, self.packer = out, zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.size = self.written = 0

    def add(self, raw: bytes) -> tuple[int, int]:
        """(frame, offset) of the record."""
        if self.size >= FRAME_BYTES:
            self.flush()
        at = len(self.frames), self.size
        self.held.append(raw)
        self.size += len(raw)
        return at

    def flush(self) -> None:
        if self.held:
            packed = self.packer.compress(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Random access to a bundle's frames by its seek table."""

    def __init__(self, file) -> None:
        self.file = file
        size = file.size()
        n, kind, mark = struct.unpack("<IBI", file.read_at(9, size - 9))
        if mark != SEEKABLE:
            raise ValueError("no seek table")
        width = 12 if kind & 0x80 else 8
        raw = file.read_at(n * width, size - 9 - n * width)
        self.starts, self.sizes = [0], []
        for i in range(n):
            packed, full = struct.unpack_from("<II", raw, i * width)
            self.starts.append(self.starts[-1] + packed)
            self.sizes.append(full)

    def frame(self, i: int) -> bytes:
        import zstandard

        packed = self.file.read_at(self.starts[i + 1] - self.starts[i], self.starts[i])
        return zstandard.ZstdDecompressor().decompress(packed, max_output_size=self.sizes[i])


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (null for a revisit), payload_bytes, payload_digest, refers_to (null for a response)."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    first = rows.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.min("payload_bytes").alias("b"), F.count("*").alias("n"))
    first = first.where("n > 1").select(F.col("payload_digest").alias("d"), "b", "first")
    # Joined on the length too, which the aggregate isn't partitioned by: both sides are dealt anew and a hot digest can be split.
    out = rows.join(first, (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b")), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    out = out.withColumn("refers_to", refers)
    return out.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", "refers_to")


def written(records: DataFrame, folder: str) -> DataFrame:
    """Writes records (as planned) to bundles in the folder, a URI all executors share; returns the stored index."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        writer, name, rows = None, "", []

        def emit() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["page_id", "record_id", "bundle", "frame", "offset", "length"])
            rows.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for page, url, payload, size, digest, refers in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    if writer is None:
                        name = f"{uuid.uuid4().hex}.warc.zst"
                        writer = BundleWriter(store.open_output_stream(f"{base}/{name}", compression=None))
                        info = b"software: sheafspark\r\nformat: WARC file version 1.1\r\n"
                        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                        writer.add(head.encode() + info + b"\r\n\r\n")
                    raw = record(page, url, payload or b"", size, digest, refers)
                    rows.append((page, record_id(page), name, *writer.add(raw), len(raw)))
                    if writer.written >= BUNDLE_BYTES:
                        writer.close()
                        writer = None
            if rows and writer is None:
                yield emit()
        if writer is not None:
            writer.close()
        if rows:
            yield emit()

    return stored(records.mapInArrow(run, INDEX))


def read(index: DataFrame, folder: str) -> DataFrame:
    """The records an index names, read from their frames; a response's payload is checked against its digest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        opened: dict[str, BundleReader] = {}
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for bundle, frame, places in zip(*(c.to_pylist() for c in batch.columns)):
                if bundle not in opened:
                    opened.clear()
                    opened[bundle] = BundleReader(store.open_input_file(f"{base}/{bundle}"))
                body = opened[bundle].frame(frame)
                out = []
                for place in places:
                    headers, payload = parsed(body[place["offset"] : place["offset"] + place["length"]])
                    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    size = int(headers["X-Payload-Length"])
                    if kind == "response":
                        size, found = len(payload), hashlib.sha256(payload).hexdigest()
                        if found != digest:
                            raise ValueError(f"{headers['WARC-Record-ID']}: payload digest {found}, header {digest}")
                    number = lambda k: int(headers[k]) if k in headers else None
                    out.append((number("X-Page-ID"), headers.get("WARC-Target-URI"), payload if kind == "response" else None, size, digest, kind, number("X-Refers-To-Page")))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names)

    frames = index.groupBy("bundle", "frame").agg(F.collect_list(F.struct("offset", "length")).alias("places"))
    return frames.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark) + "/bundles"
    index = written(planned(table(spark, sf_dir, "pages")), folder)
    return read(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""
