"""WARC archives in Zstandard frames: writer with deduplicated payloads, and reader.

An archive begins with a skippable frame that holds the dictionary its task
trained; one frame a record follows.  The reader loads that dictionary, walks the
block headers to find where each frame ends, decodes frame by frame and validates
the version line, the mandatory fields, all lengths and both digests.

Of records with equal payloads (compared by SHA-256, at least `least_bytes` long)
the one with the largest page_id is a response; the others revisit it and carry
its HTTP header without the payload.

Archives are written to a folder that all executors share, under names that hold
the partition and the attempt of their task.  The list of archives is what the
committed tasks report; the reader opens only those and holds their size and count
of records against the list.  What a lost attempt left behind is never read.

Defined cases: null html is an empty payload; a null url leaves the target URI
out; a null page_id is written as such and revisits a known one; rows that repeat
a page_id and its payload are all responses if they hold the largest id, and rows of
one page_id with several payloads are records of their own (a record's id names the
page and the payload's digest); an empty table writes no archive and gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import join_hot, new_folder, stored

#: Fixed values of the formats: magic numbers, little-endian, and the revisit profile.
SKIPPABLE, DICTIONARY, FRAME = 0x184D2A5D, 0xEC30A437, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records (before compression) after which an archive is closed.
ARCHIVE_BYTES = 16 << 20
#: Dictionary size, and the bytes of records it is trained on, at most.
DICT_BYTES, TRAIN_BYTES = 16 << 10, 512 << 10
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive that breaks its format."""


def sha1_32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def page_uri(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{digest}>"


def page_of(uri: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(null|-?\d+):[A-Z2-7]{32}>", uri)
    if not found:
        raise WarcError(f"no page in {uri!r}")
    return None if found[1] == "null" else int(found[1])


def build(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None = None, date: str = DATE) -> bytes:
    """One record: head, block and the two line ends behind it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block, digest = http + payload if kind == "response" else http, sha1_32(payload)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {page_uri(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}" if m[0] != "%" else "%", url))
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {page_uri(refers_to, digest)}"]
    head += [
        f"WARC-Block-Digest: sha1:{sha1_32(block)}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    kind: str
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes
    page_id: int | None = None
    refers_to: int | None = None
    payload_bytes: int = 0
    payload_digest: str = field(default="")


def _fields(lines: list[str]) -> dict[str, str]:
    out = {}
    for x in lines:
        name, colon, value = x.partition(":")
        if not colon or not name:
            raise WarcError(f"no header field: {x[:80]!r}")
        out[name.lower()] = value.strip()
    return out


def _length(value: str) -> int:
    if not re.fullmatch(r"\d+", value, re.ASCII):
        raise WarcError(f"no length: {value[:40]!r}")
    return int(value)


def read_record(raw: bytes) -> Record:
    """Parse and validate the bytes of one record."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise WarcError(f"no WARC version: {lines[0][:40]!r}")
    h = _fields(lines[1:])
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-block-digest", "warc-payload-digest"):
        if need not in h:
            raise WarcError(f"{need} is missing")
    n = _length(h["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {n}, but {len(rest)} bytes follow the head")
    block = rest[:n]
    if h["warc-block-digest"] != f"sha1:{sha1_32(block)}":
        raise WarcError("block digest differs")
    if h["warc-type"] not in ("response", "revisit"):
        raise WarcError(f"unknown type {h['warc-type'][:40]!r}")
    http, gap, payload = block.partition(b"\r\n\r\n")
    lines = http.decode().split("\r\n")
    if not gap or not lines[0].startswith("HTTP/"):
        raise WarcError("block is no HTTP response")
    own = _fields(lines[1:])
    size, digest = _length(own.get("content-length", "")), h["warc-payload-digest"].removeprefix("sha1:")
    out = Record(h["warc-type"], h, own, payload, page_of(h["warc-record-id"]), None, size, digest)
    if out.kind == "response":
        if len(payload) != size or sha1_32(payload) != digest:
            raise WarcError("payload length or digest differs")
    else:
        if payload or h.get("warc-profile") != PROFILE or "warc-refers-to" not in h:
            raise WarcError("revisit with a payload, or without profile or reference")
        out.refers_to = page_of(h["warc-refers-to"])
    return out


def train(samples: list[bytes], most: int = DICT_BYTES) -> bytes | None:
    """A dictionary in Zstandard's own format, or None where the samples are too few to train one."""
    try:
        return zstandard.train_dictionary(most, samples).as_bytes()
    except zstandard.ZstdError:
        return None


def write_archive(records: list[bytes], dictionary: bytes | None) -> bytes:
    """Leading skippable frame with the dictionary (if any), then a frame for each record."""
    own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    press = zstandard.ZstdCompressor(level=3, dict_data=own, write_content_size=True, write_checksum=True)
    head = [struct.pack("<II", SKIPPABLE, len(dictionary)), dictionary] if dictionary else []
    return b"".join([*head, *map(press.compress, records)])


def frame_end(raw: memoryview, at: int) -> int:
    """Where the Zstandard frame at `at` ends, by its header and block headers."""
    try:
        (magic,) = struct.unpack_from("<I", raw, at)
        if magic != FRAME:
            raise WarcError(f"no frame at {at}")
        flags = raw[at + 4]
        single, checksum = flags >> 5 & 1, flags >> 2 & 1
        size = (0, 2, 4, 8)[flags >> 6] or single
        at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + size
        last = False
        while not last:
            block = raw[at] | raw[at + 1] << 8 | raw[at + 2] << 16
            last = bool(block & 1)
            kind = block >> 1 & 3
            if kind == 3:
                raise WarcError("reserved block type")
            at += 3 + (1 if kind == 1 else block >> 3)
        at += 4 * checksum
    except (struct.error, IndexError):
        raise WarcError("archive ends inside a frame") from None
    if at > len(raw):
        raise WarcError("archive ends inside a frame")
    return at


def read_archive(raw: bytes) -> Iterator[Record]:
    """The records of an archive, each decoded from its own frame and validated."""
    view, at, own = memoryview(raw), 0, None
    if len(raw) >= 8 and struct.unpack_from("<I", raw)[0] == SKIPPABLE:
        n = struct.unpack_from("<I", raw, 4)[0]
        at = 8 + n
        if at > len(raw):
            raise WarcError("archive ends inside its dictionary")
        content = raw[8:at]
        magic = struct.unpack_from("<I", content)[0] if n >= 4 else 0
        if magic == FRAME:  # the dictionary may be compressed itself
            content = zstandard.ZstdDecompressor().decompress(content)
            magic = struct.unpack_from("<I", content)[0] if len(content) >= 4 else 0
        if magic != DICTIONARY:
            raise WarcError("the leading frame holds no dictionary")
        own = zstandard.ZstdCompressionDict(content)
    unpress = zstandard.ZstdDecompressor(dict_data=own)
    while at < len(raw):
        end = frame_end(view, at)
        try:
            yield read_record(unpress.decompress(view[at:end]))
        except zstandard.ZstdError as e:
            raise WarcError(f"frame at {at}: {e}") from None
        at = end


def _filesystem(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def decided(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, kind and refers_to for every row of pages (page_id, url, html)."""
    own = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("same", F.sha2("payload", 256))
    groups = own.where(F.length("payload") >= least_bytes).groupBy("same").agg(F.max("page_id").alias("keep"), F.count("*").alias("n"))
    joined = join_hot(own, stored(groups.where("n > 1"), "groups"), "same", "n", "left")
    revisit = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    return joined.select(
        "page_id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("keep")).alias("refers_to")
    )


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the rows of `decided` as .warc.zst files into folder; ARCHIVES, one row each, as the committed tasks reported them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = _filesystem(folder)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        number, rows, size, dictionary, known = 0, [], 0, None, False

        def close() -> pa.RecordBatch:
            nonlocal number, rows, size, dictionary, known
            if not known:
                samples, used = [], 0
                for r in rows:
                    if used + len(r) > TRAIN_BYTES:
                        break
                    samples.append(r)
                    used += len(r)
                dictionary, known = train(samples), True
            raw = write_archive(rows, dictionary)
            name = f"part-{part:06d}-{attempt}-{number:05d}.warc.zst"
            with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(raw)
            done = pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([len(rows)], pa.int64()), "bytes": pa.array([len(raw)], pa.int64())})
            number, rows, size = number + 1, [], 0
            return done

        for b in batches:
            for k in range(0, b.num_rows, 64):
                for row in zip(*(c.to_pylist() for c in b.slice(k, 64).columns), strict=True):
                    rows.append(build(*row))
                    size += len(rows[-1])
                    if size >= archive_bytes:
                        yield close()
        if rows:
            yield close()

    fs, base = _filesystem(folder)
    fs.create_dir(base, recursive=True)
    return stored(records.mapInArrow(run, ARCHIVES), "archives")


ARCHIVES = "file string, records long, bytes long"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(archives: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """READ for every record of the listed archives in folder (payload null if not asked for, or of a revisit)."""
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        for b in batches:
            for name, records, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with fs.open_input_stream(f"{base}/{name}", compression=None) as file:
                    raw = file.read()
                rows, seen = [], 0
                if len(raw) != size:
                    raise WarcError(f"{name} has {len(raw)} bytes, {size} were written")
                for r in read_archive(raw):
                    payload = r.payload if with_payload and r.kind == "response" else None
                    rows.append((r.page_id, r.headers.get("warc-target-uri"), r.payload_bytes, r.payload_digest, r.kind, r.refers_to, payload))
                    seen += 1
                    if len(rows) == 500:
                        yield batch(rows)
                        rows = []
                if seen != records:
                    raise WarcError(f"{name} has {seen} records, {records} were written")
                if rows:
                    yield batch(rows)

    # a task an archive; the list was stored, so a task that runs again has the same names
    return archives.select("file", "records", "bytes").repartition(max(1, archives.count())).mapInArrow(run, READ)


def round_trip(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, read from archives written for pages."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    archives = write_archives(decided(pages, least_bytes), folder)
    return read_archives(archives, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
