"""WARC archives: writing with revisit records, and a reader that salvages damaged files.

The writer puts each record in a gzip member of its own. Every task writes its own files, under
names that no other attempt uses, and returns them; only returned files are read, so a repeated
task leaves nothing twice. Payloads of at least ``MIN_PAYLOAD`` bytes that occur again become
revisit records that name the first page and keep the HTTP header with the payload's length.

The reader walks from record to record. A member that does not inflate or fails its check sum, a
version line, header, length or digest that is wrong starts a gap: the reader searches for the
next gzip magic or version line from which a whole valid record can be read, goes on there, and
logs the bytes between as quarantined. It holds one record at a time.

Defined results: a null payload is an empty one; null urls have no target; null page ids are
written without a number and read back as null, and never are a first page when another has one;
rows with the same page id and payload as the first are responses; empty tables give no archive.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm import common
from framelens.session import shared_folder

VERSION = b"WARC/1.1"
MIN_PAYLOAD = 100
FILE_BYTES = 64 << 20
HEADER_STEP = 1 << 16  # bytes looked at first for the end of a header
DATE = "2024-01-01T00:00:00Z"
_CANDIDATE = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def record(kind: str, page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: header, HTTP block, end."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~-._")))
    if kind == "revisit":
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"),
                   ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
               ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in fields)])
    return head + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Damaged(ValueError):
    """The bytes at a place are not a whole valid record."""


@dataclass
class Found:
    """A record with its place, or a quarantined gap (``headers`` is None)."""

    start: int
    end: int
    headers: dict[str, str] | None = None
    block: bytes = b""
    reason: str = ""


class Window:
    """Bytes of a file by place, through a buffer."""

    def __init__(self, file, size: int, step: int = 1 << 20):
        self.file, self.size, self.step = file, size, step
        self.base, self.held = 0, b""

    def at(self, place: int, n: int) -> bytes:
        n = min(n, self.size - place)
        if n <= 0:
            return b""
        if place < self.base or place + n > self.base + len(self.held):
            self.base, self.held = place, self.file.read_at(max(n, min(self.step, self.size - place)), place)
        return self.held[place - self.base : place - self.base + n]


def parse(data: bytes, place: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header, block and end of the record at ``place``; raises ``Damaged``."""
    stop = data.find(b"\r\n\r\n", place)
    if stop < 0:
        raise Damaged("no end of header")
    first, *lines = data[place:stop].split(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.[01]", first):
        raise Damaged("no version line")
    headers = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without colon")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise Damaged("no length")
    start, end = stop + 4, stop + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("record cut short or longer than its length")
    block = data[start:end]
    wanted = headers.get("warc-block-digest", "")
    if wanted.startswith("sha256:") and wanted[7:] != hashlib.sha256(block).hexdigest():
        raise Damaged("block digest differs")
    return headers, block, end + 4


def _read(window: Window, place: int) -> list[Found]:
    """The record, or the records of the gzip member, at a place."""
    if window.at(place, 3) == b"\x1f\x8b\x08":
        inflate, parts, at = zlib.decompressobj(31), [], place
        try:
            while not inflate.eof:
                chunk = window.at(at, 1 << 14)
                if not chunk:
                    raise Damaged("member cut short")
                parts.append(inflate.decompress(chunk))
                at += len(chunk)
        except zlib.error as error:
            raise Damaged(f"member: {error}") from error
        end, data, inner, out = at - len(inflate.unused_data), b"".join(parts), 0, []
        while inner < len(data) or not out:
            headers, block, inner = parse(data, inner)
            out.append(Found(place, end, headers, block))
        return out
    head, stop = _head(window, place)
    match = re.search(rb"\r\ncontent-length:[ \t]*(\d+)[ \t]*\r\n", head[: stop + 2], re.IGNORECASE)
    if match is None:
        raise Damaged("no record")
    headers, block, end = parse(window.at(place, stop + 8 + int(match[1])))
    return [Found(place, place + end, headers, block)]


def _head(window: Window, place: int) -> tuple[bytes, int]:
    """Bytes from a place on, and where the header in them ends; the look widens while they are a header."""
    n = HEADER_STEP
    while True:
        head = window.at(place, n)
        stop = head.find(b"\r\n\r\n")
        if not head.startswith(b"WARC/1.") or stop < 0 and (len(head) < n or any(b":" not in line for line in head.split(b"\r\n")[1:-1])):
            raise Damaged("no record")
        if stop >= 0:
            return head, stop
        n *= 2


def salvage(window: Window) -> Iterator[Found]:
    """All records of a file in order, with the gaps between them."""
    place, gap, reason = 0, None, ""
    while place < window.size:
        try:
            records = _read(window, place)
        except Damaged as error:
            if gap is None:
                gap, reason = place, str(error)
            place = _candidate(window, place + 1)
            continue
        if gap is not None:
            yield Found(gap, place, reason=reason)
            gap = None
        yield from records
        place = records[-1].end
    if gap is not None:
        yield Found(gap, window.size, reason=reason)


def _candidate(window: Window, place: int) -> int:
    """The next place where a member or a version line may start."""
    while place < window.size:
        chunk = window.at(place, 1 << 16)
        match = _CANDIDATE.search(chunk)
        if match:
            return place + match.start()
        if place + len(chunk) >= window.size:
            return window.size
        place += len(chunk) - 9  # a mark may lie across the end
    return window.size


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``page_id``, ``url``, ``payload`` (binary) as archives; a row per file: ``path``, ``records``."""
    size = F.coalesce(F.length("payload"), F.lit(0))
    digest = F.sha2(F.coalesce(F.col("payload"), F.lit(b"")), 256)
    keyed = pages.select("page_id", "url", "payload", digest.alias("digest"), size.alias("size"))
    first = keyed.where(F.col("size") >= MIN_PAYLOAD).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first, n = common.stored_counted(first.where("n > 1").select("digest", "first"))
    rows = common.join_checked(keyed, first, ["digest"], "left", n)
    rows = rows.select("page_id", "url", "payload", "digest", "first")

    def write(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, name, written, records, done = None, "", 0, 0, []
        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in range(5))
            for page, url, payload, digest, first in zip(*columns):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, written, records = fs.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                again = first is not None and page != first
                data = member(record("revisit" if again else "response", page, url, payload or b"", digest, first if again else None))
                out.write(data)
                written, records = written + len(data), records + 1
                if written >= file_bytes:
                    out.close()
                    done.append((f"{folder.rstrip('/')}/{name}", records))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder.rstrip('/')}/{name}", records))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["path", "records"])

    return common.stored(rows.mapInArrow(write, "path string, records long"))


_ROW = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gap", pa.string()), ("record_type", pa.string()),
                  ("record_id", pa.string()), ("refers_to", pa.string()), ("target", pa.string()), ("payload_digest", pa.string()),
                  ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def _row(path: str, found: Found) -> tuple:
    if found.headers is None:
        return path, found.start, found.end, found.reason, None, None, None, None, None, None, None
    h = found.headers
    http, _, payload = found.block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
    kind = h.get("warc-type")
    size = int(length[1]) if length else len(payload)
    return (path, found.start, found.end, None, kind, h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"),
            h.get("warc-payload-digest"), size, None if kind == "revisit" else payload)


def read_archives(paths: DataFrame) -> DataFrame:
    """All records and gaps of the files in column ``path``; a gap has its reason in ``gap``."""

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = pafs.FileSystem.from_uri(path)
                rows, held = [], 0
                with fs.open_input_file(name) as f:
                    for found in salvage(Window(f, f.size())):
                        rows.append(_row(path, found))
                        held += len(found.block)
                        if held >= 4 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(_ROW.names, r)) for r in rows], _ROW)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(_ROW.names, r)) for r in rows], _ROW)

    return paths.select("path").mapInArrow(read, "path string, start long, end long, gap string, record_type string, record_id string, "
                                           "refers_to string, target string, payload_digest string, payload_bytes long, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Stored places, types and digests of the records of all pages, written to the shared folder and read back.

    Every record written must come back: another number of records, or a gap, fails the job.
    """
    files = write_archives(pages, shared_folder(pages.sparkSession))
    wrote = files.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    found = common.stored(read_archives(files.repartition("path")).drop("payload"))
    counts = found.agg(F.count_if(F.col("gap").isNull()).alias("records"), F.count("gap").alias("gaps")).first()
    if (counts.records, counts.gaps) != (wrote, 0):
        raise RuntimeError(f"{wrote} records were written, {counts.records} records and {counts.gaps} gaps were read")
    return found
