"""WARC archives as seekable Zstandard bundles (operator 5).

Every task writes its pages' records to bundles: records are grouped into frames that each
decompress alone, and a seek table (a skippable frame with each frame's two sizes) ends the file.
The index maps a record's id to its bundle, frame and offset inside the frame.  A bundle's name
holds the attempt that wrote it, and only the rows of attempts that succeeded reach the index, so a
lost executor leaves at most files that nothing refers to.

Records with equal payloads of at least ``REVISIT_BYTES`` refer to the one with the largest id.
Cases: null html is an empty payload; a null id is always a response; repeated rows are written
each, and if they hold the largest id all are responses; a null url has no target header; a very long
payload is a record like any other and may fill a frame and a bundle alone; an empty table gives an
empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import persist, scratch_path

REVISIT_BYTES = 1000
#: Bytes before compression after which a frame, and a bundle, is closed.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 24
# Fixed values of the seekable format: magic numbers of the skippable frame and of the footer.
SKIPPABLE_MAGIC, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1
INDEX_SCHEMA = "page_id long, bundle string, frame int, frame_offset long, frame_bytes long, record_offset long, record_bytes long"
RECORD_SCHEMA = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long"


class Record(NamedTuple):
    page_id: int | None
    kind: str
    url: str | None
    digest: str
    refers_to: int | None
    payload: bytes


def _line(text: str) -> str:
    return "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in text)


def to_bytes(r: Record) -> bytes:
    """A record in WARC/1.1 form; a revisit has the response's header block without its payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (r.payload if r.kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {r.kind}", f"WARC-Record-ID: <urn:page:{'' if r.page_id is None else r.page_id}>"]
    head += [f"WARC-Target-URI: {_line(r.url)}"] if r.url is not None else []
    head += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{r.digest}"]
    if r.kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{r.refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def from_bytes(data: bytes, at: int = 0) -> tuple[Record, int]:
    """The record that begins at a place, and where the next one does."""
    end = data.index(b"\r\n\r\n", at)
    head = data[at:end].decode().split("\r\n")
    if head[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    fields = dict(x.split(": ", 1) for x in head[1:])
    size = int(fields["Content-Length"])
    block = data[end + 4 : end + 4 + size]
    payload = block[block.index(b"\r\n\r\n") + 4 :]

    def page(name: str) -> int | None:
        x = fields.get(name, "<urn:page:>")[len("<urn:page:") : -1]
        return int(x) if x else None

    record = Record(page("WARC-Record-ID"), fields["WARC-Type"], fields.get("WARC-Target-URI"), fields["WARC-Payload-Digest"].removeprefix("sha1:"), page("WARC-Refers-To"), payload)
    return record, end + 4 + size + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame with (compressed, decompressed) sizes of the frames, and the footer."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEK_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def _open(uri: str, mode: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if mode == "w":
        system.create_dir(path.rpartition("/")[0], recursive=True)
        return system.open_output_stream(path, compression=None)
    return system.open_input_file(path)


class BundleWriter:
    """Writes one bundle; ``add`` gives a record's frame and its offset in it."""

    def __init__(self, uri: str, level: int = 3) -> None:
        from zstandard import ZstdCompressor

        self.uri, self.file, self.zstd = uri, _open(uri, "w"), ZstdCompressor(level=level, write_checksum=True)
        self.sizes, self.held, self.at, self.total, self.offset = [], [], 0, 0, 0
        self.frames: list[tuple[int, int]] = []

    def add(self, data: bytes) -> tuple[int, int]:
        place = (len(self.sizes), self.at)
        self.held.append(data)
        self.at += len(data)
        self.total += len(data)
        if self.at >= FRAME_BYTES:
            self._frame()
        return place

    def _frame(self) -> None:
        data = b"".join(self.held)
        out = self.zstd.compress(data)
        self.file.write(out)
        self.sizes.append((len(out), len(data)))
        self.frames.append((self.offset, len(out)))
        self.offset += len(out)
        self.held, self.at = [], 0

    def close(self) -> None:
        if self.held:
            self._frame()
        self.file.write(seek_table(self.sizes))
        self.file.close()


class BundleReader:
    """Reads a bundle's frames, any of them alone, by its seek table."""

    def __init__(self, uri: str) -> None:
        self.file = _open(uri, "r")
        size = self.file.size()
        self.file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEK_MAGIC or flags & 0x7C:
            raise ValueError(f"no seek table in {uri}")
        width = 12 if flags & 0x80 else 8
        self.file.seek(size - 9 - n * width)
        entries = self.file.read(n * width)
        self.frames, at = [], 0
        for k in range(n):
            packed, plain = struct.unpack_from("<II", entries, k * width)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, k: int) -> bytes:
        from zstandard import ZstdDecompressor

        at, packed, plain = self.frames[k]
        self.file.seek(at)
        return ZstdDecompressor().decompress(self.file.read(packed), max_output_size=plain)

    def record(self, k: int, offset: int) -> Record:
        return from_bytes(self.frame(k), offset)[0]

    def records(self) -> Iterator[Record]:
        for k in range(len(self.frames)):
            data, at = self.frame(k), 0
            while at < len(data):
                record, at = from_bytes(data, at)
                yield record


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/pages-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        writer, rows, count = None, [], 0

        def close() -> pa.RecordBatch:
            nonlocal writer
            writer.close()
            frames = writer.frames
            out = [(i, writer.uri, k, *frames[k], at, size) for i, k, at, size in rows]
            rows.clear()
            writer = None
            names = [x.split()[0] for x in INDEX_SCHEMA.split(", ")]
            kinds = [pa.int64(), pa.string(), pa.int32()] + [pa.int64()] * 4
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

        for batch in batches:
            payloads = batch.column(2).cast(pa.binary())
            for k, (i, url, digest, refers) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4)))):
                if writer is None:
                    writer = BundleWriter(f"{name}-{count:04d}.warc.zst")
                    count += 1
                data = to_bytes(Record(i, "response" if refers is None else "revisit", url, digest, refers, payloads[k].as_py()))
                rows.append((i, *writer.add(data), len(data)))
                if writer.total >= BUNDLE_BYTES:
                    yield close()
        if writer is not None:
            yield close()

    return run


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a record for every row of pages (page_id, url, html); returns the index."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    html = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"))
    own = own.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    large = own.filter((F.octet_length("html") >= REVISIT_BYTES) & F.col("page_id").isNotNull())
    shared = large.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1").select("digest", "last")
    rows = own.join(persist(shared, "payloads"), "digest", "left")
    rows = rows.select("page_id", "url", "html", "digest", F.when(F.col("page_id") < F.col("last"), F.col("last")).alias("refers_to"))
    return persist(rows.mapInArrow(_write(folder), INDEX_SCHEMA), "warc-index")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            rows = []
            for r in BundleReader(uri).records():
                own = r.kind == "response"
                if own and hashlib.sha1(r.payload).hexdigest() != r.digest:
                    raise ValueError(f"record {r.page_id} of {uri} is damaged")
                rows.append((r.page_id, r.kind, len(r.payload) if own else None, r.digest, r.refers_to))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def read_archives(index: DataFrame) -> DataFrame:
    """All records of the index's bundles; a revisit has its response's payload size and digest."""
    bundles = index.select("bundle").distinct()
    n = bundles.count()
    spread = bundles.repartition(max(1, min(n, 4096)), "bundle")
    records = persist(spread.mapInArrow(_read, RECORD_SCHEMA), "records")
    revisits = records.filter("record_type = 'revisit'").select("page_id", "record_type", "refers_to")
    responses = records.filter("record_type = 'response'")
    used = revisits.select(F.col("refers_to").alias("page_id")).distinct()
    full = responses.select("page_id", "payload_bytes", "payload_digest").join(used, "page_id", "left_semi")
    full = full.dropDuplicates(["page_id"]).withColumnRenamed("page_id", "refers_to")
    revisits = revisits.join(full, "refers_to").select(*records.columns)
    return responses.unionByName(revisits).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
