"""WARC output (operator 8): seekable Zstandard bundles with payload de-duplication.

Records are grouped into independent Zstandard frames; each bundle ends in the public seekable-format footer (a
skippable frame with the sizes of all frames), and an index maps every record to its bundle, frame and offset
inside the frame, so one record costs one frame.  Of records with equal payloads the one with the largest id is
a ``response`` and the others are ``revisit`` records that name it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm import store

BUNDLE_BYTES, FRAME_BYTES, LEVEL = 32 << 20, 256 << 10, 3
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the seekable format and of WARC.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record; a revisit (``payload`` None) has the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if payload is None else http + payload
    target = "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {target}"] if target else []
    head += [f"WARC-Payload-Digest: sha1:{digest}"]
    head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"] if payload is None else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(headers, block)`` of concatenated records."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        start = end + 4
        size = int(headers["Content-Length"])
        yield headers, data[start : start + size]
        at = start + size + 4


class Bundle:
    """Collects records into frames and ends them with a seek table."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        import zstandard

        self._zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self._frame_bytes = frame_bytes
        self._frames: list[bytes] = []
        self._sizes: list[tuple[int, int]] = []
        self._open: list[bytes] = []
        self._held = 0
        self.raw = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Append a record; returns its frame and its offset inside the frame."""
        if self._held and self._held + len(data) > self._frame_bytes:
            self._close()
        place = len(self._frames), self._held
        self._open.append(data)
        self._held += len(data)
        self.raw += len(data)
        return place

    def _close(self) -> None:
        frame = self._zstd.compress(b"".join(self._open))
        self._frames.append(frame)
        self._sizes.append((len(frame), self._held))
        self._open, self._held = [], 0

    def bytes(self) -> bytes:
        if self._open:
            self._close()
        table = b"".join(struct.pack("<II", *s) for s in self._sizes) + struct.pack("<IBI", len(self._sizes), 0, _SEEKABLE)
        return b"".join(self._frames) + struct.pack("<II", _SKIPPABLE, len(table)) + table


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """``(offset, compressed size, size)`` of each frame, from the footer."""
    frames, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    at, out, start = len(data) - 9 - width * frames, [], 0
    for k in range(frames):
        packed, size = struct.unpack_from("<II", data, at + k * width)
        out.append((start, packed, size))
        start += packed
    return out


def read_frame(data: bytes, frame: int) -> bytes:
    import zstandard

    start, packed, size = seek_table(data)[frame]
    return zstandard.ZstdDecompressor().decompress(data[start : start + packed], max_output_size=size)


def read_record(data: bytes, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record of a bundle by its place in the index: only its frame is decompressed."""
    return next(parse_records(read_frame(data, frame)[offset:]))


_INDEX = "page_id long, bundle string, frame int, offset long, length long"
_KINDS = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())


def _write_batches(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        bundle, rows = Bundle(), []

        def close() -> pa.RecordBatch:
            # a name of this attempt: the index that is committed points at the files of its own attempt
            uri = f"{folder}/bundle-{part:06d}-{seq:04d}-{uuid.uuid4().hex[:8]}.warc.zst"
            store.publish(uri, bundle.bytes())
            columns = list(zip(*((p, uri, *rest) for p, *rest in rows), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)], names=[c.split()[0] for c in _INDEX.split(", ")])

        for batch in batches:
            for page_id, url, html, refers in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                digest = payload_digest(payload)
                data = record(page_id, url, payload if refers is None else None, digest, len(payload), refers)
                rows.append((page_id, *bundle.add(data), len(data)))
                if bundle.raw >= BUNDLE_BYTES:
                    yield close()
                    bundle, rows, seq = Bundle(), [], seq + 1
        if rows:
            yield close()

    return run


def write_warc(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record a row and return the index ``page_id, bundle, frame, offset, length``.

    Payloads of at least ``min_bytes`` are written once, with the largest id; smaller ones are always written.
    Null html is an empty payload; rows of the largest id that repeat it are responses, too; rows without an id
    are responses.  An empty table writes nothing; other columns are ignored.
    """
    folder = folder or store.scratch(pages.sparkSession, "warc")
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    # only payloads that repeat matter: a thin table, made from ids and digests, that Spark broadcasts while it is small
    groups = rows.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    largest = store.materialise(groups.where("n > 1").select("digest", "top"), "warc-repeats", thin=True)
    told = rows.join(largest, "digest", "left").select("page_id", "url", "html", F.when(F.col("page_id") < F.col("top"), F.col("top")).alias("refers_to"))
    return store.materialise(told.mapInArrow(_write_batches(folder), _INDEX), "warc-index")


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            data = store.fetch(uri)
            for frame in range(len(seek_table(data))):
                out = []
                for headers, block in parse_records(read_frame(data, frame)):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(next(x for x in head.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = headers["WARC-Type"]
                    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
                        raise ValueError(f"a damaged record in {uri}")
                    name, other = headers["WARC-Record-ID"], headers.get("WARC-Refers-To", "")
                    number = lambda x: int(x[len("<urn:page:") : -1]) if x.startswith("<urn:page:") else None
                    out.append((number(name), size, digest, kind, number(other)))
                columns = zip(*out, strict=True)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _READ.split(", ")])


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_warc(index: DataFrame) -> DataFrame:
    """All records of an index's bundles, read frame by frame; payloads are checked against their digests."""
    n = store.partitions(index.sparkSession)
    # by partition id: a few names are little data, but each stands for a bundle to decode
    dealt = index.select("bundle").distinct().repartitionById(n, F.pmod(F.xxhash64("bundle"), F.lit(n)).cast("int"))
    return dealt.mapInArrow(_read_batches, _READ)
