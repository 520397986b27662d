"""Web archives: a WARC 1.1 writer with revisit records, and a salvage reader.

Writer: equal payloads are found by grouping (digest, length), combined before
the shuffle; the smallest id of a group is its response and the others are
revisits that refer to it.  Every task writes its records, one gzip member
each, to files of its own under the given shared folder: a file gets its final
name when it is complete and counts only once Spark has committed the task's
manifest row, so a lost executor or a second attempt leaves no half record.

Reader: works through segments (path, first byte, end) that begin at a record.
A record counts when its header parses, its length and closing line breaks
hold and its digests match.  Members are unpacked as a stream: a member that is
cut off or fails its checksum still gives the valid records before the damage,
and after a bad record the reader looks for the next version line in the
unpacked bytes.  Where a member's end is unknown, or a plain record fails, it
searches the file for the next member or version line that begins a valid
record and goes on from there.  Damaged members and skipped bytes are reported
as quarantined gaps, and ``read_pages`` fails on them unless told otherwise.  A
task holds one record and a few blocks of one file.

Cases: NULL html is an empty payload; NULL urls have no target header; of
equal payloads without any id all are responses, and a NULL id never becomes
the response of a group that has one; rows that repeat an id and payload are
written as often as they occur; a page of any length is one record, which its
task holds whole; an empty table gives an empty archive; other columns are not
read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import save, shipped

DATE = "2025-01-01T00:00:00Z"
#: Compressed bytes after which a segment of a file, and a file, is closed.
SEGMENT_BYTES, FILE_BYTES = 32 << 20, 1 << 30
LEVEL = 6
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BLOCK = 1 << 20
_GZIP, _VERSION = b"\x1f\x8b\x08", b"WARC/1."
_START = re.compile(re.escape(_GZIP) + b"|" + re.escape(_VERSION))
_LINE = re.compile(rb"([!#$%&'*+\-.^_`|~0-9A-Za-z]+):[ \t]*(.*)")


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a Hadoop-style name."""
    if "://" not in uri:
        uri = re.sub(r"^file:", "", uri)
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(re.sub("^s3a:", "s3:", uri))


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---------------------------------------------------------------- writing

def record(kind: str, record_id: str, block: bytes, **headers: str | None) -> bytes:
    lines = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": DATE, **headers,
             "WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Length": str(len(block))}
    head = "".join(f"{k}: {v}\r\n" for k, v in lines.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_id_uri(page_id: int | None) -> str:
    return f"urn:x-page:{'none' if page_id is None else page_id}"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit of the page ``refers_to``; its HTTP header gives the full payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    headers = {"WARC-Target-URI": target, "Content-Type": "application/http; msgtype=response",
               "WARC-Payload-Digest": f"sha1:{digest(payload)}"}
    if refers_to is None:
        return record("response", page_id_uri(page_id), http + payload, **headers)
    headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<{page_id_uri(refers_to)}>"}
    return record("revisit", page_id_uri(page_id), http, **headers)


def member(data: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Archive:
    """One open file of a task."""

    def __init__(self, folder: str, part: int):
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        name = f"part-{part:05d}-{uuid.uuid4().hex}.warc.gz"
        self.fs, self.path, self.uri = fs, f"{path}/{name}", f"{folder}/{name}"
        self.out = fs.open_output_stream(f"{self.path}.open")
        self.size, self.start, self.segments = 0, 0, []
        self.add(record("warcinfo", f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, name)}", b"format: WARC File Format 1.1\r\n",
                        **{"Content-Type": "application/warc-fields"}))

    def add(self, data: bytes) -> None:
        packed = member(data)
        self.out.write(packed)
        self.size += len(packed)
        if self.size - self.start >= SEGMENT_BYTES:
            self._mark()

    def _mark(self) -> None:
        if self.size > self.start:
            self.segments.append((self.uri, self.start, self.size))
            self.start = self.size

    def close(self) -> list[tuple[str, int, int]]:
        self._mark()
        self.out.close()
        self.fs.move(f"{self.path}.open", self.path)
        return self.segments


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Write a record per row under ``folder``; the segments ``path, start, end`` of what was written."""
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                     F.coalesce(html_col, F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("key", F.struct(F.sha2("payload", 256).alias("sha"), F.octet_length("payload").alias("n")))
    groups = p.groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = groups.where((F.col("n") > 1) & (F.col("key.n") >= min_revisit_bytes)).select("key", "first")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = p.join(groups, "key", "left").select("page_id", "url", "payload", refers.alias("refers_to"))
    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def write(batches):
        from pyspark import TaskContext

        archive, done = None, []
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to"))):
                archive = archive or _Archive(folder, TaskContext.get().partitionId())
                archive.add(page_record(*(x.as_py() for x in row)))
                if archive.size >= FILE_BYTES:
                    done, archive = done + archive.close(), None
        done += archive.close() if archive else []
        yield pa.record_batch([list(c) for c in zip(*done)] if done else [[], [], []], schema=schema)

    return save(shipped(rows).mapInArrow(write, "path string, start long, end long"), "warc-manifest")


def whole_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Segments for archives written elsewhere: each file is one."""
    rows = []
    for path in paths:
        fs, name = filesystem(path)
        rows.append((path, 0, fs.get_file_info(name).size))
    return spark.createDataFrame(rows, "path string, start long, end long")


# ---------------------------------------------------------------- reading

class Damaged(Exception):
    """A check that failed; the message is the reason logged for the gap."""


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes

    def payload(self) -> bytes | None:
        """The HTTP body of a response, the whole block of other records, nothing for revisits."""
        if self.headers["warc-type"] == "revisit":
            return None
        if not self.headers.get("content-type", "").startswith("application/http"):
            return self.block
        head, gap, body = self.block.partition(b"\r\n\r\n")
        if not gap:
            raise Damaged("http header")
        return body

    def full_length(self) -> int:
        """Bytes of the full payload; a revisit's HTTP header tells them."""
        body = self.payload()
        if body is not None:
            return len(body)
        m = re.search(rb"(?im)^content-length:[ \t]*(\d+)", self.block)
        return int(m[1]) if m else 0


class _Bytes:
    """Random access to one segment, in blocks; the last few are held."""

    def __init__(self, file, start: int, end: int):
        self.file, self.start, self.end, self.held = file, start, end, {}

    def get(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes at ``at``, fewer only at the end of the segment."""
        n = min(n, self.end - at)
        parts = []
        while n > 0:
            k, skip = divmod(at - self.start, _BLOCK)
            if k not in self.held:
                if len(self.held) >= 4:
                    del self.held[next(iter(self.held))]
                first = self.start + k * _BLOCK
                self.held[k] = self.file.read_at(min(_BLOCK, self.end - first), first)
            piece = self.held[k][skip:skip + n]
            if not piece:
                break
            parts.append(piece)
            at, n = at + len(piece), n - len(piece)
        return b"".join(parts)


class _Member:
    """The content of the gzip member at ``at``, unpacked as it is asked for; what lies before the current record is let go."""

    def __init__(self, src: _Bytes, at: int):
        self.src, self.pos, self.unpack = src, at, zlib.decompressobj(31)
        self.base, self.held, self.over = 0, bytearray(), False
        self.reason: str | None = None

    @property
    def end(self) -> int | None:
        """Where the member ends; None if its data do not tell."""
        return self.pos - len(self.unpack.unused_data) if self.unpack.eof else None

    def _feed(self, data: bytes) -> None:
        """Unpack a piece of the member; of a piece with an error all that comes before it."""
        before = self.unpack.copy()
        try:
            self.held += self.unpack.decompress(data)
        except zlib.error:
            self.unpack = before
            if len(data) == 1:
                self.over, self.reason = True, self.reason or "member checksum or data"
                return
            half = len(data) // 2
            self._feed(data[:half])
            if not self.over:
                self._feed(data[half:])

    def _more(self) -> None:
        data = self.src.get(self.pos, 1 << 14)
        self.pos += len(data)
        if data:
            self._feed(data)
            self.over |= self.unpack.eof
        else:
            self.over, self.reason = True, self.reason or "member cut off"

    def get(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes of the content at ``at``, fewer only at its end or where it cannot be unpacked."""
        while not self.over and self.base + len(self.held) < at + n:
            self._more()
        return bytes(self.held[at - self.base:at - self.base + n])

    def _find(self, what: bytes, at: int) -> int | None:
        while True:
            found = self.held.find(what, at - self.base)
            if found >= 0:
                return self.base + found
            if self.over:
                return None
            at = max(at, self.base + len(self.held) - len(what) + 1)
            self._let_go(at)
            self._more()

    def _let_go(self, at: int) -> None:
        del self.held[:at - self.base]
        self.base = at

    def records(self) -> Iterator[Record]:
        """Valid records; after a failed check, those from the next version line on.  ``reason`` then has the first failure."""
        at, failed, found = 0, None, False
        while self.get(at, 1):
            try:
                record, at = parse(self.get, at)
            except Damaged as e:
                failed = failed or str(e)
                at = self._find(_VERSION, at + 1)
                if at is None:
                    break
            else:
                found = True
                yield record
            self._let_go(at)
        self.reason = self.reason or failed or (None if found else "empty member")


def parse(get, at: int) -> tuple[Record, int]:
    """The plain record at ``at`` of ``get(at, n)``, and its end."""
    head, size = b"", 1 << 12
    while b"\r\n\r\n" not in head:
        more = get(at, size)
        if not more.startswith(_VERSION) or len(more) == len(head) or size > 1 << 22:
            raise Damaged("version line" if not more.startswith(_VERSION) else "header cut off")
        head, size = more, size * 4
    head = head[:head.index(b"\r\n\r\n")]
    headers = {}
    for line in head.split(b"\r\n")[1:]:
        m = _LINE.fullmatch(line)
        if not m:
            raise Damaged("header line")
        headers[m[1].decode().lower()] = m[2].decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not length.isdecimal() or not {"warc-type", "warc-record-id"} <= headers.keys():
        raise Damaged("header fields")
    first, n = at + len(head) + 4, int(length)
    if get(first + n, 4) != b"\r\n\r\n":
        raise Damaged("record length")
    found = Record(headers, get(first, n))
    _check("block digest", headers.get("warc-block-digest"), found.block)
    body = found.payload()
    if body is not None:
        _check("payload digest", headers.get("warc-payload-digest"), body)
    return found, first + n + 4


def _check(what: str, named: str | None, data: bytes) -> None:
    if named and named.lower().startswith("sha1:") and named[5:].upper() != digest(data):
        raise Damaged(what)


def _next(src: _Bytes, at: int) -> int:
    """The first place from ``at`` on where a member or plain record begins with a valid record, or the end."""
    while at < src.end:
        data = src.get(at, _BLOCK)
        m = _START.search(data)
        if not m:
            at += max(1, len(data) - len(_VERSION) + 1)
            continue
        at += m.start()
        try:
            parse(_Member(src, at).get if m[0] == _GZIP else src.get, 0 if m[0] == _GZIP else at)
            return at
        except Damaged:
            at += 1
    return src.end


def salvage(src: _Bytes) -> Iterator[tuple[int, int | None, str | None, Record | None]]:
    """``(offset, length, reason, record)``: valid records, and gaps, which have a reason and no record.

    The bytes of a member belong to its last record, or to a gap if the member
    is damaged; its other records have no length.
    """
    at = src.start
    while at < src.end:
        if src.get(at, len(_GZIP)) == _GZIP:
            member, last = _Member(src, at), None
            for record in member.records():
                if last:
                    yield at, None, None, last
                last = record
            reason, end = member.reason, member.end
            if last:
                yield at, end - at if not reason else None, None, last
        else:
            try:
                record, end = parse(src.get, at)
                reason = None
                yield at, end - at, None, record
            except Damaged as e:
                reason, end = str(e), None
        if reason:
            end = end or _next(src, at + 1)
            yield at, end - at, reason, None
        at = end


_READ = [("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("gap", pa.string()),
         ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()),
         ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
         ("payload", pa.binary())]


def read_archives(segments: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for each record, and for each quarantined gap (``gap`` names the failed check; its other fields are NULL).

    ``payload_bytes`` and ``payload_digest`` are those of the full payload,
    also for revisits.  ``with_payload`` off leaves the payloads in the tasks.
    """
    schema = pa.schema(_READ)

    def rows(path: str, start: int, end: int):
        fs, name = filesystem(path)
        with fs.open_input_file(name) as file:
            for offset, length, gap, r in salvage(_Bytes(file, start, end)):
                if gap:
                    yield path, offset, length, gap, *[None] * 7
                    continue
                h, body = r.headers, r.payload()
                bare = lambda k: h[k].strip("<>") if k in h else None
                named = h.get("warc-payload-digest", "").removeprefix("sha1:")
                yield (path, offset, length, None, h["warc-type"], bare("warc-record-id"), h.get("warc-target-uri"),
                       bare("warc-refers-to"), r.full_length(), named if body is None else digest(body),
                       body if with_payload else None)

    def read(batches):
        out, held = [], 0
        for batch in batches:
            for segment in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end"))):
                for row in rows(*segment):
                    out.append(row)
                    held += 200 + len(row[-1] or b"")
                    if held >= 8 << 20:
                        yield pa.record_batch([list(c) for c in zip(*out)], schema=schema)
                        out, held = [], 0
        if out:
            yield pa.record_batch([list(c) for c in zip(*out)], schema=schema)

    n = max(1, min(segments.count(), 100_000))
    types = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}
    return shipped(segments.repartition(n)).mapInArrow(read, ", ".join(f"{c} {types[t]}" for c, t in _READ))


def gaps(segments: DataFrame) -> DataFrame:
    """The quarantined bytes: ``path, offset, length, gap`` (the failed check)."""
    return read_archives(segments, with_payload=False).where(F.col("gap").isNotNull()).select("path", "offset", "length", "gap")


def read_pages(segments: DataFrame, skip_gaps: bool = False) -> DataFrame:
    """The page records read back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    A damaged segment is an error, as its pages would be missing; with
    ``skip_gaps`` the pages that were salvaged are returned (see ``gaps``).
    """
    number = lambda c: F.regexp_extract(c, r"^urn:x-page:(-?\d+)$", 1).try_cast("long")
    page = F.col("record_id").startswith("urn:x-page:")
    if not skip_gaps:
        told = F.concat_ws(" ", F.lit("damaged archive:"), "path", "offset", "length", "gap")
        page = F.when(F.col("gap").isNotNull(), F.raise_error(told).cast("boolean")).otherwise(page)
    rows = read_archives(segments, with_payload=False).where(page)
    return rows.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       number("refers_to").alias("refers_to"))
