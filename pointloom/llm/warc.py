"""WARC archives in Zstandard, one frame for each record, written and read.

An archive starts with a skippable frame that holds the dictionary for the frames
that follow (itself possibly compressed); each record is a frame of its own, so any
record can be decoded alone. The dictionary is fitted on the first records of the
archive (``SAMPLE_BYTES`` of them at most).

Payloads that several pages share are stored once: the page with the smallest id has
a ``response`` record, the others ``revisit`` records that name it and hold the HTTP
header only. Which pages those are comes from one grouping of digests; the table of
repeated digests is broadcast only where it is small and joined otherwise.

The reader loads the dictionary, walks the frames by their block headers and checks,
for every record, the version line, the required headers, the declared lengths, the
end mark and the payload's digest; what doesn't hold raises ``ValueError``.

Defined results: null payloads count as empty and empty payloads repeat like any
other; a null id is written as ``null`` and comes back as null, and refers to
nothing when it alone has its payload; a null url leaves the target out; an empty table
gives no archives and an empty result; other columns are not read. Ids are integers. A record of a foreign archive
that doesn't tell its size may unpack to 1 GiB at most; a larger one is a bad record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .common import HOT_PARTS, arrow_limits

#: Magic number of the skippable frame with the dictionary, and of compressed frames.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: Uncompressed bytes after which an archive is closed, sample bytes and size of its dictionary.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 16 << 20, 1 << 20, 32 << 10
#: Rows up to which the table of repeated payloads is broadcast.
BROADCAST_ROWS = 100_000
#: The date that records carry, as pages have none.
DATE = "2000-01-01T00:00:00Z"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
_URN = "urn:pointloom:page:"


@dataclass
class Record:
    page_id: int | None
    url: str | None
    payload: bytes  # empty in a revisit
    payload_bytes: int
    payload_digest: str
    record_type: str
    refers_to: int | None


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def to_bytes(r: Record) -> bytes:
    """The record as it stands in an archive."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r.payload_bytes}\r\n\r\n".encode()
    block = http + r.payload
    head = ["WARC/1.1", f"WARC-Type: {r.record_type}", f"WARC-Record-ID: <{_URN}{'null' if r.page_id is None else r.page_id}>", f"WARC-Date: {DATE}"]
    if r.url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", r.url))
    if r.record_type == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_URN}{r.refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{r.payload_digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes, at: int) -> tuple[str, dict[str, str], int]:
    end = raw.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("header block without end")
    first, *lines = raw[at:end].decode("utf-8").split("\r\n")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name:
            raise ValueError(f"malformed header line {line[:80]!r}")
        fields[name.strip().lower()] = value.strip()
    return first, fields, end + 4


def from_bytes(raw: bytes) -> Record:
    """Parse and validate one record."""
    version, fields, at = _headers(raw, 0)
    if version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"not a record: {version[:40]!r}")
    for name in REQUIRED:
        if name.lower() not in fields:
            raise ValueError(f"no {name}")
    length = int(fields["content-length"])
    if len(raw) != at + length + 4 or raw[-4:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not fit the frame")
    if fields.get("warc-block-digest", "").removeprefix("sha1:") not in ("", base32_sha1(raw[at : at + length])):
        raise ValueError("block digest differs")
    status, http, start = _headers(raw, at)
    if not status.startswith("HTTP/"):
        raise ValueError("no HTTP status line")
    payload, kind, digest = raw[start : at + length], fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    n = int(http.get("content-length", len(payload)))
    if kind == "response" and (n != len(payload) or digest not in ("", base32_sha1(payload))):
        raise ValueError("payload differs from its declared length or digest")

    def page(name: str) -> int | None:
        x = fields.get(name, "").strip("<>").removeprefix(_URN)
        return int(x) if x not in ("", "null", "None") else None

    return Record(page("warc-record-id"), fields.get("warc-target-uri"), payload, n, digest or base32_sha1(payload), kind,
        page("warc-refers-to") if kind == "revisit" else None)


def write_archive(records: list[bytes], level: int = 3) -> bytes:
    """One archive: the dictionary's skippable frame, then a frame for each record."""
    samples, n = [], 0
    for r in records:
        if n >= SAMPLE_BYTES:
            break
        samples.append(r[: SAMPLE_BYTES // 16])  # a long record adds its beginning to the fit of the dictionary only
        n += len(samples[-1])
    content = b""
    if len(samples) >= 16:
        try:
            content = zstandard.train_dictionary(min(DICTIONARY_BYTES, n // 4), samples, level=level).as_bytes()
        except zstandard.ZstdError:  # too little or too uniform to train on
            content = b""
    content = content or (samples[0][:DICTIONARY_BYTES] if samples else b"")
    packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(content) if content else None,
        write_checksum=True, write_content_size=True)
    return struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content + b"".join(map(packer.compress, records))


def frame_end(buf: memoryview, at: int) -> int:
    """Where the compressed frame at ``at`` ends, by its header and block headers."""
    if at + 5 > len(buf) or struct.unpack_from("<I", buf, at)[0] != FRAME_MAGIC:
        raise ValueError("no frame where one is due")
    flags = buf[at + 4]
    single = flags >> 5 & 1
    pos = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        if pos + 3 > len(buf):
            raise ValueError("frame is cut short")
        head = int.from_bytes(buf[pos : pos + 3], "little")
        kind, n = head >> 1 & 3, head >> 3
        if kind == 3:
            raise ValueError("reserved block type")
        pos += 3 + (1 if kind == 1 else n)
        if head & 1:
            pos += 4 * (flags >> 2 & 1)
            if pos > len(buf):
                raise ValueError("frame is cut short")
            return pos


def read_archive(content: bytes, problems: list[str] | None = None) -> Iterator[Record]:
    """The records of an archive, each validated.

    What is wrong raises ValueError. With a list of ``problems`` it is told there instead: a bad record is left out, and
    where a frame's end can't be found, so is the rest of the archive.
    """
    try:
        for at, raw in frames(content):
            try:
                if isinstance(raw, ValueError):
                    raise raw
                yield from_bytes(raw)
            except ValueError as e:
                if problems is None:
                    raise
                problems.append(f"record at {at}: {e}")
    except ValueError as e:
        if problems is None:
            raise
        problems.append(str(e))


def frames(content: bytes) -> Iterator[tuple[int, bytes | ValueError]]:
    """Where each frame starts and what it holds, or why it can't be unpacked."""
    buf, at, words = memoryview(content), 0, b""
    if len(buf) >= 8 and struct.unpack_from("<I", buf)[0] == DICTIONARY_MAGIC:
        at = 8 + struct.unpack_from("<I", buf, 4)[0]
        if at > len(buf):
            raise ValueError("dictionary is cut short")
        words = bytes(buf[8:at])
        if words[:4] == struct.pack("<I", FRAME_MAGIC):
            words = zstandard.ZstdDecompressor().decompress(words, max_output_size=1 << 28)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    while at < len(buf):
        if at + 8 <= len(buf) and struct.unpack_from("<I", buf, at)[0] & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + struct.unpack_from("<I", buf, at + 4)[0]  # other skippable frames carry no record
            continue
        end = frame_end(buf, at)
        try:
            raw = reader.decompress(buf[at:end], max_output_size=zstandard.frame_content_size(buf[at:end]) or 1 << 30)
        except zstandard.ZstdError as e:
            raw = ValueError(f"frame at {at}: {e}")
        yield at, raw
        at = end


def with_first(rows: DataFrame, repeated: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` with the ``first`` id of their digest, null where no other row has it; ``repeated``: digest, first, n.

    Up to ``most`` digests are broadcast. Of more, only those are that many rows share (an empty page, an error page), so that no task of the
    shuffle join gets the bodies of such a class.
    """
    if repeated.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(repeated.drop("n")), "digest", "left")
    total = repeated.agg(F.sum("n")).first()[0]
    hot = F.broadcast(repeated.where(F.col("n") > total / HOT_PARTS))  # at most HOT_PARTS
    cold = repeated.where(F.col("n") <= total / HOT_PARTS).drop("n")
    return rows.join(hot.drop("n"), "digest").unionByName(rows.join(hot.select("digest"), "digest", "left_anti").join(cold, "digest", "left"))


def archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(name, content) rows: archives of all pages, as many as the data needs."""
    spark = pages.sparkSession
    arrow_limits(spark)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    digest = rows.select("id", F.sha1("payload").alias("digest"))
    repeated = materialise(digest.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1"), "repeated-payloads")
    typed = with_first(rows.withColumn("digest", F.sha1("payload")), repeated).select("id", "url", "payload", "first")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, kept, size = TaskContext.get().partitionId(), 0, [], 0

        def close():
            nonlocal k, kept, size
            out = pa.RecordBatch.from_pydict({"name": [f"pages-{part:06d}-{k:04d}.warc.zst"],
                "content": pa.array([write_archive(kept)], pa.binary())})
            k, kept, size = k + 1, [], 0
            return out

        for b in batches:
            for i, url, payload, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                again = first is not None and i != first
                kept.append(to_bytes(Record(i, url, b"" if again else payload, len(payload), base32_sha1(payload),
                    "revisit" if again else "response", first if again else None)))
                size += len(kept[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
        if kept:
            yield close()

    return typed.mapInArrow(run, "name string, content binary")


def records(found: DataFrame, content_col: str = "content", payload: bool = False, problems: bool = False) -> DataFrame:
    """The records of archives, one row each; ``found`` may be ``archives`` or Spark's binaryFile source over .warc.zst files.

    A bad record fails the job, or with ``problems`` is a row of its own that says why in the column ``problem`` (null else).
    """
    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
        ("refers_to", pa.int64())] + [("url", pa.string()), ("payload", pa.binary())] * payload
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * payload + ", problem string" * problems
    names = [n for n, _ in fields] + ["problem"] * problems

    def packed(rows: list[Record], told: list[str]) -> pa.RecordBatch:
        cols = [pa.array([getattr(x, n) for x in rows] + [None] * len(told), t) for n, t in fields]
        return pa.RecordBatch.from_arrays(cols + [pa.array([None] * len(rows) + told, pa.string())] * problems, names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows, told = [], [] if problems else None
                for r in read_archive(content.as_py(), told):
                    rows.append(r)
                    if len(rows) == 2000:
                        yield packed(rows, [])
                        rows = []
                if rows or told:
                    yield packed(rows, told or [])

    return found.select(content_col).mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write every page into archives in the shared folder, then read them back."""
    return records(materialise(archives(pages), "warc"))
