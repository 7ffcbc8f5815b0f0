"""Archives of web pages as WARC files, compressed with a dictionary of their own.

A file starts with a skippable frame (magic 0x184D2A5D) that holds a Zstandard
dictionary built from records of the file; then each record is a frame of its
own, so that a reader can start at any record. Tasks write files to the shared
folder under names of their own and move them into place when complete; only
files that a finished task reports are read.
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
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyre.session import fresh_path, materialize, ship, sized

MAGIC = 0x184D2A5D
DICTIONARY_BYTES = 32 << 10
#: Records, bytes of them, and bytes of one that a file's dictionary is built from at most; a bounded sample of the file.
SAMPLE_RECORDS, SAMPLE_BYTES, SAMPLE_RECORD = 400, 1 << 20, 65_536
FILE_BYTES = 64 << 20
_ZERO_DATE = "1970-01-01T00:00:00Z"


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None) -> bytes:
    """One WARC/1.1 record. A revisit has the digest of the payload but not its bytes."""
    body = b"" if kind == "revisit" else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_ZERO_DATE}",
        "WARC-Target-URI: " + "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or ""),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1" or not body.endswith(b"\r\n\r\n"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = body[:-4]
    if len(body) != int(fields["Content-Length"]):
        raise ValueError(f"record of {len(body)} bytes, {fields['Content-Length']} announced")
    return fields, body


def _dictionary(samples: list[bytes]) -> bytes:
    """A Zstandard dictionary of the samples, or if they are too few or too short to train one, of their bytes as they are."""
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 4)
    if len(samples) >= 8 and size >= 2048:
        try:
            return zstandard.train_dictionary(size, samples, k=512, d=8, f=18, accel=2, level=3).as_bytes()
        except zstandard.ZstdError:
            pass  # too alike: their bytes serve
    return b"".join(samples)[:DICTIONARY_BYTES]


class Writer:
    """Writes records to a stream, the first ones when the dictionary is built or at close.

    The dictionary is built from the beginnings (SAMPLE_RECORD bytes) of the
    first records; records themselves are written whole.
    """

    def __init__(self, sink, level: int = 3):
        self.sink, self.level, self.early, self.held, self.compress, self.written = sink, level, [], 0, None, 0

    def _begin(self) -> None:
        d = _dictionary([x[:SAMPLE_RECORD] for x in self.early])
        self.sink.write(struct.pack("<II", MAGIC, len(d)) + d)
        self.compress = zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(d))
        self.written += len(d)
        for x in self.early:
            self._put(x)
        self.early = []

    def _put(self, raw: bytes) -> None:
        frame = self.compress.compress(raw)
        self.sink.write(frame)
        self.written += len(frame)

    def add(self, raw: bytes) -> None:
        if self.compress:
            self._put(raw)
            return
        self.early.append(raw)
        self.held += min(len(raw), SAMPLE_RECORD)
        if len(self.early) >= SAMPLE_RECORDS or self.held >= SAMPLE_BYTES:
            self._begin()

    def close(self) -> None:
        if not self.compress:
            self._begin()


def read_records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, one frame at a time."""
    magic, n = struct.unpack("<II", source.read(8))
    if magic != MAGIC:
        raise ValueError("no dictionary frame at the start")
    d = source.read(n)
    decompress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d))
    rest = b""
    while True:
        frame = decompress.decompressobj()
        out = []
        if not rest:
            rest = source.read(1 << 20)
            if not rest:
                return
        while not frame.eof:
            if not rest:
                rest = source.read(1 << 20)
                if not rest:
                    raise ValueError("the archive ends within a record")
            out.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
        yield parse(b"".join(out))


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI; s3a and s3n are the names that Hadoop gives s3."""
    if path.startswith(("s3a://", "s3n://")):
        path = "s3" + path[3:]
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _uri(path: str) -> str:
    """file:/a and file:///a alike."""
    return "file:///" + path[5:].lstrip("/") if path.startswith("file:") else path


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, level: int = 3, folder: str | None = None) -> DataFrame:
    """Write pages to archives in folder (default: a new one in the shared folder); returns one row (file, records) for each.

    A page is a record; its payload is the text in UTF-8 (null: empty). Of
    records with equal payloads of least_bytes or more, that with the smallest
    id is a response and the others revisit it; shorter ones are all responses.
    Rows that share that smallest id are responses all; rows without an id are
    responses and nothing refers to them. An empty table gives no files.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = _uri(folder or fresh_path(spark, "warc"))
    key, payload = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{payload_col}`"), F.lit(""))
    digests = pages.where(F.octet_length(payload) >= least_bytes).select(key.alias("id"), F.unhex(F.sha1(payload.cast("binary"))).alias("digest"))
    repeated = digests.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    revisits = digests.join(repeated, "digest").where("id > first").select("id", "digest", "first").distinct()
    revisits = materialize(revisits, "revisits")
    rows = pages.select(key.alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"), F.unhex(F.sha1(payload.cast("binary"))).alias("digest"))
    rows = rows.join(sized(revisits), ["id", "digest"], "left").select("id", "url", "payload", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open_folder(folder)
        fs.create_dir(root, recursive=True)
        sink = writer = name = None
        files, counts, n = [], [], 0

        def finish() -> None:
            writer.close()
            sink.close()
            fs.move(f"{root}/{name}.part", f"{root}/{name}")
            files.append(f"{folder}/{name}")
            counts.append(n)

        for batch in batches:
            for page_id, url, body, first in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2).cast(pa.large_binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if writer is None:
                    name, n = f"{uuid.uuid4().hex}.warc.zst", 0
                    sink = fs.open_output_stream(f"{root}/{name}.part", compression=None)
                    writer = Writer(sink, level)
                writer.add(record("response" if first is None else "revisit", page_id, url, body, sha1_base32(body), first))
                n += 1
                if writer.written >= FILE_BYTES:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        if files:
            yield pa.RecordBatch.from_arrays([pa.array(files), pa.array(counts, pa.int64())], names=["file", "records"])

    return materialize(rows.mapInArrow(write, "file string, records long"), "manifest")


def read_archives(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The records of the archives that files lists: page_id, url, record_type, payload_digest, payload_bytes (of the full payload), refers_to, payload (null for a revisit)."""
    ship(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                fs, path = _open_folder(file)
                with fs.open_input_stream(path, compression=None) as source:
                    held, size = [], 0
                    for fields, body in read_records(source):
                        held.append(_row(fields, body))
                        size += len(body)
                        if size > 4 << 20 or len(held) >= 2000:
                            yield _batch(held)
                            held, size = [], 0
                    if held:
                        yield _batch(held)

    # each file is a unit of work
    n = max(1, min(files.count(), 10_000))
    return files.select("file").repartition(n).mapInArrow(read, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")


def _row(fields: dict[str, str], body: bytes) -> tuple:
    number = lambda x: int(x[10:-1]) if x and x[10:-1] else None  # noqa: E731  <urn:page:7>
    kind = fields["WARC-Type"]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and sha1_base32(body) != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    return number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], kind, digest, int(fields["X-Payload-Length"]), number(fields.get("WARC-Refers-To")), None if kind == "revisit" else body


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
