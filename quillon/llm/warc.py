"""WARC archives as seekable Zstandard bundles.

A bundle (``.warc.zst``) is a sequence of independent Zstandard frames, each holding whole WARC records, closed by the
seek table of the public seekable format: a skippable frame with every frame's compressed and plain size. The index maps
a record's identifier to its bundle, its frame and its offset in the plain frame, so one record costs one ranged read.
Tasks write bundles next to each other in a shared folder, each attempt under names of its own, and a file appears whole
(written aside, then moved). Only bundles that the committed index names are read: what an attempt that was lost, or ran
beside another, has left there is never seen.

Of records with equal payloads of at least ``min_bytes`` bytes, those with the smallest ``page_id`` are responses, the
others revisits that refer to it. The payload's digest is joined by page, not by payload: no text moves to the partition
of a frequent payload. Defined cases: a null html is empty; a null page_id is larger than any other; rows that share
page_id and payload are records of the same type; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm._store import shared_path

#: Fixed values of the seekable format: skippable frame, footer magic, bytes of the footer.
SKIPPABLE, SEEKABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1, 9
EOL = b"\r\n"
INDEX = "page_id long, bundle string, frame int, frame_start long, frame_bytes long, offset long, length long"
RECORD = "page_id long, record_type string, refers_to long, uri string, payload_digest string, payload_bytes long, payload binary"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit that keeps only the header of the exchange."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = "null" if page_id is None else page_id
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + EOL * 2 + block + EOL * 2


def parse_records(plain: bytes) -> Iterator[tuple]:
    """Rows of RECORD from a plain frame; a response's digest and size are those of the payload that was read."""
    at = 0
    number = lambda urn: None if urn is None or urn == "<urn:page:null>" else int(urn[10:-1])
    while at < len(plain):
        end = plain.index(EOL * 2, at)
        lines = plain[at:end].decode().split("\r\n")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        start, size = end + 4, int(head["Content-Length"])
        block = plain[start : start + size]
        http, _, payload = block.partition(EOL * 2)
        kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
        length = int(http.rpartition(b"Content-Length: ")[2])
        if kind == "response" and (sha1_base32(payload) != digest or len(payload) != length):
            raise ValueError(f"damaged record {head['WARC-Record-ID']}")
        yield (
            number(head["WARC-Record-ID"]), kind, number(head.get("WARC-Refers-To")), head["WARC-Target-URI"], digest, length,
            payload if kind == "response" else None,
        )
        at = start + size + 4


class _Bundle:
    """One bundle in the making: ``add`` records, ``close`` writes it and gives the index rows."""

    def __init__(self, folder: str, name: str, frame_bytes: int):
        self.store, path = fs.FileSystem.from_uri(folder)
        self.path, self.uri, self.frame_bytes = f"{path}/{name}", f"{folder}/{name}", frame_bytes
        self.aside = f"{path}/.{name}.{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.aside)
        self.plain, self.frames, self.index, self.waiting, self.at = bytearray(), [], [], [], 0

    def add(self, page_id: int | None, record: bytes) -> None:
        if self.plain and len(self.plain) + len(record) > self.frame_bytes:
            self._frame()
        self.waiting.append((page_id, len(self.plain), len(record)))
        self.plain += record

    def _frame(self) -> None:
        data = zstandard.ZstdCompressor(level=3).compress(bytes(self.plain))
        for page_id, offset, length in self.waiting:
            self.index.append((page_id, self.uri, len(self.frames), self.at, len(data), offset, length))
        self.out.write(data)
        self.frames.append((len(data), len(self.plain)))
        self.at += len(data)
        self.plain, self.waiting = bytearray(), []

    def close(self) -> list[tuple]:
        if self.plain:
            self._frame()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        self.store.move(self.aside, self.path)
        return self.index


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of each frame, from the footer at the end of the bundle."""
    count, _, magic = struct.unpack("<IBI", bundle[-FOOTER:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    rows, at = [], 0
    for size, plain in struct.iter_unpack("<II", bundle[-FOOTER - 8 * count : -FOOTER]):
        rows.append((at, size, plain))
        at += size
    return rows


def digests(pages: DataFrame) -> DataFrame:
    return pages.withColumn("html", F.coalesce("html", F.lit(""))).withColumn("digest", F.sha1(F.encode("html", "utf-8")))


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, refers_to``: refers_to is the page that holds the payload, null for responses."""
    pages = digests(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"))
    each = pages.where(F.octet_length("html") >= min_bytes).select("page_id", "digest").distinct()
    first = each.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = each.join(first, "digest").where("page_id > refers_to OR page_id IS NULL AND refers_to IS NOT NULL")
    a, b = pages.alias("a"), again.hint("shuffle_hash").alias("b")
    on = F.col("a.page_id").eqNullSafe(F.col("b.page_id")) & (F.col("a.digest") == F.col("b.digest"))
    return a.join(b, on, "left").select("a.page_id", "a.url", "a.html", "b.refers_to")


def write_bundles(pages: DataFrame, folder: str, min_bytes: int = 0, frame_bytes: int = 1 << 20, bundle_bytes: int = 16 << 20) -> DataFrame:
    """Write a record per page; the index of the records (INDEX). Reading the index again doesn't write again."""
    fs_, path = fs.FileSystem.from_uri(folder)
    fs_.create_dir(path, recursive=True)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, attempt, bundle, size, number = TaskContext.get().partitionId(), uuid.uuid4().hex, None, 0, 0
        for batch in batches:
            done: list[tuple] = []
            for page_id, url, html, refers_to in zip(*(batch.column(i) for i in range(4)), strict=True):
                payload = html.as_buffer().to_pybytes() if hasattr(html, "as_buffer") else html.as_py().encode()
                record = warc_record(page_id.as_py(), url.as_py(), payload, refers_to.as_py())
                if bundle is not None and size + len(record) > bundle_bytes:
                    done, bundle = done + bundle.close(), None
                if bundle is None:
                    bundle, size, number = _Bundle(folder, f"part-{part:06d}-{attempt}-{number:06d}.warc.zst", frame_bytes), 0, number + 1
                bundle.add(page_id.as_py(), record)
                size += len(record)
            if done:
                yield _index_batch(done)
        if bundle is not None:
            yield _index_batch(bundle.close())

    index = with_revisits(pages, min_bytes).mapInArrow(write, INDEX)
    at = posixpath.join(folder, "index")
    index.write.parquet(at)
    return pages.sparkSession.read.schema(INDEX).parquet(at)


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 4]
    names = ["page_id", "bundle", "frame", "frame_start", "frame_bytes", "offset", "length"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def read_bundles(spark: SparkSession, folder: str, keep_payload: bool = True) -> DataFrame:
    """Every record of every bundle that the folder's index names (RECORD), frame by frame along the seek tables."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as f:
                    bundle = f.read_buffer()
                for start, size, _ in seek_table(bundle.to_pybytes()):
                    plain = zstandard.ZstdDecompressor().decompress(bundle[start : start + size])
                    rows = list(parse_records(plain))
                    if not keep_payload:
                        rows = [(*r[:-1], None) for r in rows]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    index = spark.read.schema(INDEX).parquet(posixpath.join(folder, "index"))
    names = index.select("bundle").distinct()
    return names.repartition(max(1, -(-names.count() // 4))).mapInArrow(read, RECORD)  # names are few bytes, bundles many


def fetch_record(entry: dict) -> bytes:
    """One record by its index row: the frame is read by its range, the record cut out by its offset."""
    store, path = fs.FileSystem.from_uri(entry["bundle"])
    with store.open_input_file(path) as f:
        f.seek(entry["frame_start"])
        plain = zstandard.ZstdDecompressor().decompress(f.read(entry["frame_bytes"]))
    return plain[entry["offset"] : entry["offset"] + entry["length"]]


def new_folder(spark: SparkSession) -> str:
    return shared_path(spark, "warc")
