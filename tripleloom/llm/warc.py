"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent frames, each holding whole records, and a skippable frame with the seek table as footer.
The index tells frame and offset inside the frame of each record, so one record costs a footer, a frame and no scan.

Each task writes its pages frame by frame into bundles of its own; a bundle appears under its name only when whole. The
index comes from the attempt that Spark accepts, so bundles of a lost or repeated attempt are in no index and never read.
Only narrow rows are compared for copies; a payload moves at most once. Folders are opened with
pyarrow's file systems (local or mounted, S3, GCS, HDFS), the same from every executor.

Defined results: a null payload is empty; a null url has no target line; a null page_id is kept as null and refers to
nothing. Of equal payloads from `least` bytes on, the rows with the largest page_id are responses (all of them, if that
row is repeated), the others revisit it; with no page_id at all in such a group all are responses. An empty table gives
no bundles and no rows. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.session import checkpoint_dir

from .common import map_texts, materialise

# Fixed values of the formats.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URN = "urn:x-page:"
BREAK = b"\r\n"

LEAST, FRAME_BYTES, BUNDLE_BYTES = 1000, 256 << 10, 32 << 20
DATE = "2024-01-01T00:00:00Z"
BUNDLES_A_TASK = 2


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return pafs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://", 1))
    return pafs.LocalFileSystem(), folder


def _path(folder: str, bundle: str) -> str:
    return f"{folder.rstrip('/')}/{bundle}.warc.zst"


def record(page_id, url: str | None, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """One record; `refers_to` is None for a response. A revisit keeps the response's header, not its payload."""
    revisit = refers_to is not None
    http = BREAK.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % size, b"", b""])
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{RECORD_URN}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {' '.join(url.split())}")
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if revisit:
        lines += [f"WARC-Refers-To: <{RECORD_URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + BREAK + BREAK


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at an offset, and where the next one begins."""
    end = data.index(BREAK + BREAK, at)
    first, *lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no record at offset {at}")
    headers = dict(line.split(": ", 1) for line in lines)
    start, size = end + 4, int(headers["Content-Length"])
    if data[start + size : start + size + 4] != BREAK + BREAK:
        raise ValueError(f"record at offset {at} is cut short")
    return headers, data[start : start + size], start + size + 4


def payload_of(headers: dict[str, str], block: bytes) -> tuple[int, str, str | None, bytes | None]:
    """Payload size, digest (hex) and the id that a revisit refers to; the payload of a response, checked against its digest."""
    head, _, body = block.partition(BREAK + BREAK)
    size = int(dict(line.split(b": ", 1) for line in head.split(BREAK)[1:])[b"Content-Length"])
    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if headers["WARC-Type"] == "revisit":
        return size, digest, headers["WARC-Refers-To"][1:-1].removeprefix(RECORD_URN), None
    if len(body) != size or hashlib.sha1(body).hexdigest() != digest:
        raise ValueError(f"payload of {headers['WARC-Record-ID']} differs from its digest")
    return size, digest, None, body


class BundleWriter:
    """Streams records into one bundle; never holds more than a frame."""

    def __init__(self, folder: str, frame_bytes: int):
        self.fs, root = _open(folder)
        self.name = uuid.uuid4().hex
        self.final, self.temporary, self.frame_bytes = _path(root, self.name), f"{root.rstrip('/')}/.{self.name}", frame_bytes
        self.fs.create_dir(root, recursive=True)
        self.file = self.fs.open_output_stream(self.temporary)
        self.compressor = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.frame, self.table, self.bytes = bytearray(), [], 0

    def add(self, data: bytes) -> tuple[int, int, int]:
        """Frame, offset in it, and length of the record."""
        if self.frame and len(self.frame) + len(data) > self.frame_bytes:
            self._flush()
        place = len(self.table), len(self.frame), len(data)
        self.frame += data
        self.bytes += len(data)
        return place

    def _flush(self) -> None:
        packed = self.compressor.compress(bytes(self.frame))
        self.file.write(packed)
        self.table.append((len(packed), len(self.frame)))
        self.frame = bytearray()

    def close(self) -> None:
        if self.frame:
            self._flush()
        entries = b"".join(struct.pack("<II", *e) for e in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.file.write(struct.pack("<II", SKIPPABLE, len(entries)) + entries)
        self.file.close()
        self.fs.move(self.temporary, self.final)


class BundleReader:
    """Frames of a bundle by number, found through the seek table."""

    def __init__(self, folder: str, bundle: str):
        fs, root = _open(folder)
        self.file = fs.open_input_file(_path(root, bundle))
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"bundle {bundle} has no seek table")
        table = self.file.read_at(8 * count, size - 9 - 8 * count)
        self.frames, at = [], 0
        for packed, whole in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, whole))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, whole = self.frames[number]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=whole)


def marked(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """page_id, url, html (null for revisits), size, digest, refers_to (null for responses)."""
    content = F.coalesce(F.col(html), F.lit(""))
    whole = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), content.alias("html"), F.octet_length(content).cast("long").alias("size"), F.sha1(content).alias("digest"))
    narrow = whole.select("page_id", "digest", "size").distinct()
    # copies meet as narrow rows only
    target = narrow.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("target"))
    revisits = narrow.join(target, "digest").where("target IS NOT NULL AND NOT (page_id <=> target)").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "target")
    joined = whole.join(revisits, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    return joined.select("page_id", "url", F.when(F.col("target").isNull(), F.col("html")).alias("html"), "size", "digest", F.col("target").alias("refers_to"))


def write(pages: DataFrame, folder: str, bundle_bytes: int = BUNDLE_BYTES, frame_bytes: int = FRAME_BYTES, **columns) -> DataFrame:
    """Write the bundles; returns the index as a written table: page_id, bundle, frame, offset, length."""
    records = marked(pages, **columns)
    kind = records.schema["page_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            places = []
            for page, url, html, size, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "size", "digest", "refers_to"))):
                if writer and writer.bytes >= bundle_bytes:
                    writer.close()
                    writer = None
                writer = writer or BundleWriter(folder, frame_bytes)
                places.append((writer.name, *writer.add(record(page, url, (html or "").encode(), size, digest, refers_to))))
            if places:
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), *[pa.array(c, k) for c, k in zip(zip(*places), kinds)]], ["page_id", "bundle", "frame", "offset", "length"])
        if writer:
            writer.close()

    # the text column only bounds the batches
    return materialise(map_texts(records, "html", work, f"page_id {kind}, bundle string, frame int, offset long, length long"))


READ = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string"


def _row(headers: dict[str, str], block: bytes) -> tuple:
    size, digest, refers_to, body = payload_of(headers, block)
    return headers["WARC-Record-ID"][1:-1].removeprefix(RECORD_URN) or None, size, digest, headers["WARC-Type"], refers_to, headers.get("WARC-Target-URI"), body


def _batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.binary()][: 6 + with_payload]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"][: 6 + with_payload]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def read_back(index: DataFrame, folder: str, page_id_type: str = "long", with_payload: bool = False) -> DataFrame:
    """Every record of all bundles of the index, frame by frame; with_payload adds the bytes of responses."""
    bundles = materialise(index.select("bundle").distinct())
    # names are small, bundles are not: rows alone would put them all into one task
    bundles = bundles.repartition(max(1, -(-bundles.count() // BUNDLES_A_TASK)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column("bundle").to_pylist():
                reader = BundleReader(folder, number)
                for i in range(len(reader.frames)):
                    data, at, rows = reader.frame(i), 0, []
                    while at < len(data):
                        headers, block, at = parse(data, at)
                        rows.append(_row(headers, block))
                    yield _batch(rows, with_payload)

    found = bundles.mapInArrow(work, READ + ", payload binary" * with_payload)
    return found.withColumns({c: F.col(c).cast(page_id_type) for c in ("page_id", "refers_to")})


def fetch(index: DataFrame, folder: str, page_id_type: str = "long") -> DataFrame:
    """Records of chosen index rows with their payloads, by seek table and offset; only their frames are read."""
    chosen = index.select("bundle", "frame", "offset").repartition("bundle").sortWithinPartitions("bundle", "frame", "offset")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, data, at = None, b"", (None, None)
        for batch in batches:
            for number, frame, offset in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "offset"))):
                if number != at[0]:
                    reader = BundleReader(folder, number)
                if (number, frame) != at:
                    data, at = reader.frame(frame), (number, frame)
                headers, block, _ = parse(data, offset)
                yield _batch([_row(headers, block)], True)

    found = chosen.mapInArrow(work, READ + ", payload binary")
    return found.withColumns({c: F.col(c).cast(page_id_type) for c in ("page_id", "refers_to")})


def archive(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Write all pages and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    folder = folder or f"{checkpoint_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    index = write(pages, folder, **columns)
    return read_back(index, folder, index.schema["page_id"].dataType.simpleString())
