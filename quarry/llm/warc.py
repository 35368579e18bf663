"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames of about ``FRAME_BYTES``; each frame is an
independent Zstandard frame, and a bundle ends with the seek table of the
seekable format (a skippable frame that lists the sizes of all frames). The
index maps a record identifier to (bundle, frame, offset in the unpacked
frame), so one record costs one seek and one frame.

Of records with equal payloads the one with the smallest ``page_id`` is a
response, the others are revisits that refer to it. Files are written by the
tasks through ``pyarrow.fs`` under names of their own; only those that the
index lists count, so a repeated task leaves nothing wrong behind.

Defined cases: a null payload counts as empty, null ids are never referred to
(rows of one payload that all lack an id are all responses), repeated rows with
the smallest id are all responses, records of rows that repeat an id get a
suffix to their identifiers, an empty table makes no bundle, extra columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.text import full_text
from quarry.plans.staging import new_path, stage

FRAME_BYTES = 1 << 18
MIN_BYTES = 0
LEVEL = 3
#: Fixed values of the seekable format: the skippable frame's and the footer's magic numbers.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
#: Fixed value: the profile of revisits by payload digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:quarry:page:"
INDEX_SCHEMA = "page_id long, record_id string, bundle string, frame int, frame_offset long, frame_bytes long, record_offset long, record_bytes long"
RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def open_store(path: str):
    """The file system of a path and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, suffix: str = "", date: str = "1970-01-01T00:00:00Z") -> tuple[str, bytes]:
    """Record identifier and bytes of one WARC record; pages have no date of their own, so all records bear the same one."""
    name = f"{ID_PREFIX}{page_id}{suffix}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or '', safe='%/:=&?~#+!$,;@()*[]')}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header fields and block of each record of an unpacked frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        yield at, fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def page_of(name: str | None) -> int | None:
    bare = (name or "").strip("<>")
    return int(bare[len(ID_PREFIX) :].partition("#")[0]) if bare.startswith(ID_PREFIX) else None


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame that ends a bundle; frames: packed and unpacked sizes."""
    body = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(file, size: int) -> list[tuple[int, int, int]]:
    """Offset, packed and unpacked size of each frame of an open bundle."""
    file.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("the bundle has no seek table")
    file.seek(size - 9 - 8 * count)
    sizes = struct.unpack(f"<{2 * count}I", file.read(8 * count))
    out, at = [], 0
    for packed, full in zip(sizes[::2], sizes[1::2], strict=True):
        out.append((at, packed, full))
        at += packed
    return out


def with_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, url, payload, refers_to, repeated): who revisits whom, and whether other rows have the id too.

    Ids and digests alone are grouped, whatever the number of copies; the
    payloads then meet the decisions by (id, digest), which no copy makes hot.
    """
    payload = full_text(F.col("html"))
    keyed = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"))
    slim = stage(pages.select("page_id", F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("size")), "digests")
    first = slim.filter(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").select("digest", "refers_to")
    later = slim.join(first, "digest").filter("page_id is null or page_id > refers_to").select("page_id", "digest", "refers_to")
    several = slim.groupBy("page_id").agg(F.count("*").alias("n")).filter("page_id is not null and n > 1").select("page_id")
    again = slim.join(several, "page_id").select("page_id", "digest")
    marked = later.unionByName(again, allowMissingColumns=True).groupBy("page_id", "digest").agg(F.max("refers_to").alias("refers_to"), (F.count("*") > F.count("refers_to")).alias("repeated"))
    marked = marked.withColumnsRenamed({"page_id": "_page", "digest": "_digest"})
    met = keyed.join(marked, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    return met.select("page_id", "url", "payload", "refers_to", F.coalesce("repeated", F.lit(False)).alias("repeated"))


def write_bundles(records: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write one bundle for each partition and return the index, a row for each record."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=LEVEL)
        path, file, frames, at = f"{folder}/bundle-{uuid.uuid4().hex}.warc.zst", None, [], 0
        waiting: list[tuple] = []
        held: list[bytes] = []

        def flush() -> pa.RecordBatch:
            nonlocal at, waiting, held
            full = b"".join(held)
            packed = packer.compress(full)
            file.write(packed)
            rows = [(*x[:2], path, len(frames), at, len(packed), *x[2:]) for x in waiting]
            frames.append((len(packed), len(full)))
            at += len(packed)
            waiting, held = [], []
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["page_id", "record_id", "bundle", "frame", "frame_offset", "frame_bytes", "record_offset", "record_bytes"])

        size = 0
        for batch in batches:
            for page_id, url, payload, refers_to, repeated in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if file is None:
                    store, inner = open_store(path)
                    store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                    file = store.open_output_stream(inner, compression=None)  # frames are packed here
                name, record = make_record(page_id, url, payload.encode(), refers_to, f"#{uuid.uuid4()}" if repeated else "")
                waiting.append((page_id, name, size, len(record)))
                held.append(record)
                size += len(record)
                if size >= frame_bytes:
                    yield flush()
                    size = 0
        if held:
            yield flush()
        if file is not None:
            file.write(seek_table(frames))
            file.close()

    return stage(records.select("page_id", "url", "payload", "refers_to", "repeated").mapInArrow(write, INDEX_SCHEMA), "warc-index")


def read_frames(bundles: DataFrame) -> DataFrame:
    """From ``bundle`` paths the frames their seek tables list, dealt out to all tasks."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inner = open_store(path)
                with store.open_input_file(inner) as file:
                    found = read_seek_table(file, file.size())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["bundle", "frame_offset", "frame_bytes"])

    return bundles.select("bundle").mapInArrow(tables, "bundle string, frame_offset long, frame_bytes long")


def read_records(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles; a response's digest and size come from the payload that was read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for path, at, size in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                store, inner = open_store(path)
                with store.open_input_file(inner) as file:
                    file.seek(at)
                    data = unpacker.decompress(file.read(size))
                rows = []
                for _, fields, block in parse_records(data):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                    length = int(head.rsplit(b"Content-Length: ", 1)[1])
                    if kind == "response" and (len(payload) != length or base32_sha1(payload) != digest):
                        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not match its digest")
                    rows.append((page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], kind, page_of(fields.get("WARC-Refers-To")), length, digest))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"])

    frames = read_frames(bundles)
    n = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frames.repartition(n, "bundle", "frame_offset").mapInArrow(read, RECORD_SCHEMA)


def fetch_record(index_row) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record, by its index row: one seek, one frame."""
    import zstandard

    store, inner = open_store(index_row["bundle"])
    with store.open_input_file(inner) as file:
        at, packed, _ = read_seek_table(file, file.size())[index_row["frame"]]
        file.seek(at)
        data = zstandard.ZstdDecompressor().decompress(file.read(packed))
    start = index_row["record_offset"]
    _, fields, block = next(parse_records(data[start : start + index_row["record_bytes"]]))
    return fields, block


def archive(pages: DataFrame, folder: str | None = None, frame_bytes: int = FRAME_BYTES, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write ``pages`` as bundles below ``folder`` and return the index."""
    return write_bundles(with_revisits(pages, min_bytes), folder or new_path(pages.sparkSession, "warc", lasting=True), frame_bytes)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC bundles and read back."""
    index = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_records(index.select("bundle").distinct()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
