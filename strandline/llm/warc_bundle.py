"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a footer, the seek table of the Zstandard seekable format (a
skippable frame: compressed and plain size of each frame, number of frames, flags, magic), makes any frame reachable
without the ones before it. An index maps each record to archive, frame and the offset in the frame. Plain Zstandard
readers see an ordinary .warc.zst file.

Of the records with equal payloads of min_payload bytes or more, those with the largest page_id are `response`, the others
`revisit` it (identical-payload-digest profile: the HTTP head with the length of the full payload and its digest, no
body). A null html is an empty payload. Equal payloads are found by SHA-1 with a partial aggregate. Pages that are alone with
their payload pass by a bitmap and aren't shuffled; payloads that very many pages share are joined by broadcast. Repeated
rows with the largest page_id are all responses, and share their record's name, which is made from the page_id. A null
page_id is below all others; a null url is empty. Other columns are ignored.

Archives lie in a folder that all machines share. Each task attempt writes files of its own names and returns their index
rows; only the index of attempts that Spark committed is read, so lost executors leave no false records.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_join, lean, shared_dir, sieved

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, ARCHIVE_BYTES = 1 << 20, 1 << 27
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def one_line(text: str) -> str:
    """A header's value: line breaks and per cent signs are written as %XX."""
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def any_line(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {one_line(url or '')}", f"WARC-Payload-Digest: sha1:{sha1}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(data: memoryview, at: int) -> tuple[dict[str, str], memoryview, int]:
    """Headers and block of the record at an offset, and where the next begins."""
    end = bytes(data[at : at + 65536]).find(b"\r\n\r\n")
    if end < 0:
        end = bytes(data[at:]).find(b"\r\n\r\n")
    first, *rest = bytes(data[at : at + end]).decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    head = dict(x.split(": ", 1) for x in rest)
    size, body = int(head["Content-Length"]), at + end + 4
    return head, data[body : body + size], body + size + 4


class Bundle:
    """Writes records into frames; finish() adds the seek table."""

    def __init__(self, out, level: int = 3, frame_bytes: int = FRAME_BYTES) -> None:
        self.out, self.zip, self.frame_bytes = out, zstandard.ZstdCompressor(level=level), frame_bytes
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.size = self.at = 0

    def add(self, data: bytes) -> tuple[int, int, int]:
        """Number of the frame, its place in the file, and the record's offset in it."""
        if self.size and self.size + len(data) > self.frame_bytes:
            self.flush()
        where = len(self.frames), self.at, self.size
        self.held.append(data)
        self.size += len(data)
        return where

    def flush(self) -> None:
        if self.held:
            packed = self.zip.compress(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.at += len(packed)
            self.held, self.size = [], 0

    def finish(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


def seek_table(file) -> list[tuple[int, int, int]]:
    """Place, compressed and plain size of each frame, from the end of a file."""
    end = file.size()
    file.seek(end - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE or flags & 0x80:
        raise ValueError("no seek table without checksums at the file's end")
    file.seek(end - 9 - 8 * count)
    sizes = np.frombuffer(file.read(8 * count), "<u4").reshape(count, 2)
    places = np.concatenate([[0], np.cumsum(sizes[:, 0])])
    return [(int(p), int(a), int(b)) for p, (a, b) in zip(places, sizes, strict=False)]


def read_record(uri: str, frame_at: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record, by its index entry: reads and unpacks its frame only."""
    where, path = fs.FileSystem.from_uri(uri)
    with where.open_input_file(path) as f:
        place, packed, plain = next(x for x in seek_table(f) if x[0] == frame_at)
        f.seek(place)
        data = zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=plain)
    head, block, _ = parse(memoryview(data), offset)
    return head, bytes(block)


def _payloads(column: pa.Array) -> Iterator[bytes]:
    for x in column:
        yield b"" if not x.is_valid else x.as_buffer().to_pybytes()


INDEX = "page_id long, archive string, frame int, frame_at long, offset long"


def _write(folder: str, level: int, frame_bytes: int, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = fs.FileSystem.from_uri(folder)
        out = bundle = None
        rows: list[tuple] = []

        def done() -> pa.RecordBatch:
            bundle.finish()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["page_id", "archive", "frame", "frame_at", "offset"])

        for batch in batches:
            columns = (batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), _payloads(batch.column("html")), batch.column("refers_to").to_pylist())
            for page_id, url, payload, refers_to in zip(*columns, strict=True):
                if bundle is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    out = where.open_output_stream(f"{path.rstrip('/')}/{name}", compression=None)
                    bundle = Bundle(out, level, frame_bytes)
                data = record(page_id, url, payload, digest(payload), refers_to)
                rows.append((page_id, f"{folder.rstrip('/')}/{name}", *bundle.add(data)))
                if bundle.at + bundle.size >= archive_bytes:
                    yield done()
                    bundle, rows = None, []
        if bundle is not None:
            yield done()

    return run


def originals(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """sha1, key (a hash of it), the largest page_id and n, of the payloads that several pages have."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    found = pages.select(F.col("page_id").cast("long").alias("page_id"), F.length(payload).alias("bytes"), F.unhex(F.sha1(payload)).alias("sha1"))
    same = found.filter(F.col("bytes") >= min_payload).groupBy("sha1").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    return same.filter("n > 1 and first is not null").select("sha1", F.xxhash64("sha1").alias("key"), "first", "n")


def write(pages: DataFrame, min_payload: int = 0, level: int = 3, frame_bytes: int = FRAME_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives and returns their index: page_id, archive, frame, frame_at, offset. An action: it runs now."""
    spark = pages.sparkSession
    lean(spark)
    base = shared_dir(spark).rstrip("/")
    folder = f"{base if '://' in base or base.startswith('file:') else 'file://' + base}/warc-{uuid.uuid4().hex}"
    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path)
    html = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    sha1 = F.unhex(F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")))
    first = cut(originals(html, min_payload))
    # pages alone with their payload aren't shuffled; one that a third of all pages have is joined by broadcast
    alone, some = sieved(html.withColumn("sha1", sha1).withColumn("key", F.xxhash64("sha1")), first.select("key").distinct(), "key")
    both = hot_join(some.drop("key"), first.select("sha1", "first"), ["sha1"], first.select("sha1", "n"), "left")
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("first")))
    rows = both.select("page_id", "url", "html", F.when(again, F.col("first")).alias("refers_to"))
    rows = alone.select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to")).unionByName(rows)
    index = f"{base}/warc-index-{uuid.uuid4().hex}"
    rows.mapInArrow(_write(folder, level, frame_bytes, archive_bytes), INDEX).write.parquet(index)
    return spark.read.parquet(index)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unzip = zstandard.ZstdDecompressor()
    for batch in batches:
        for uri in batch.column("archive").to_pylist():
            where, path = fs.FileSystem.from_uri(uri)
            with where.open_input_file(path) as f:
                for place, packed, plain in seek_table(f):
                    f.seek(place)
                    data, at, rows = memoryview(unzip.decompress(f.read(packed), max_output_size=plain)), 0, []
                    while at < len(data):
                        head, block, at = parse(data, at)
                        rows.append(_row(head, block))
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def _number(value: str | None) -> int | None:
    return int(value[len("<urn:page:") : -1]) if value and value != "<urn:page:>" else None


def _row(head: dict[str, str], block: memoryview) -> tuple:
    cut = bytes(block[:4096]).find(b"\r\n\r\n") + 4
    size = int(bytes(block[:cut]).decode().split("Content-Length: ")[1].split("\r\n")[0])
    told = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "response":
        payload = bytes(block[cut:])
        if len(payload) != size or digest(payload) != told:
            raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
    return _number(head["WARC-Record-ID"]), any_line(head["WARC-Target-URI"]), size, told, head["WARC-Type"], _number(head.get("WARC-Refers-To"))


def read(index: DataFrame) -> DataFrame:
    """Every record of the archives that an index names: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to. Responses are checked against their digests."""
    return index.select("archive").distinct().repartition("archive").mapInArrow(_read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
