"""WARC archives: a writer of deduplicated records and a reader that salvages what is left of damaged files.

Writing: equal payloads (of at least ``min_size`` bytes) are one response, the
record of the smallest page id, and revisits that refer to it.  Each task
writes archives of its own under names used once, gzip member by member, and
returns what it wrote; only archives that a finished task returned are read,
so a task that is run again leaves nothing behind in the result.

Reading: a record must decompress, begin with a version line, hold as many
bytes as it says, end with two line ends and match its digests.  If it does
not, the reader looks for the next place where a valid member or version line
begins, goes on there, and reports the bytes between as a gap, with a reason.
A member of several records is searched in the same way, as far as it can be
decompressed; its gaps have the offset of the member, and the reason tells
their place in its content.

Defined cases: null html is an empty payload, a null url leaves the header
out, a null page id is larger than any other and stays null.  Rows that repeat
the id of the response and its payload are responses as well.  Empty tables
give no archive and no record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, parallelism, scratch_path, utf8

VERSION = b"WARC/1."
MEMBER = b"\x1f\x8b\x08"
END = b"\r\n\r\n"
# Bytes of compressed records after which a task begins another archive.
ARCHIVE = 32 << 20
CHUNK = 1 << 20
DATE = "2020-01-01T00:00:00Z"
ID = "urn:x-page:"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- writing ------------------------------------------------------------------------------------


def record_bytes(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit has the HTTP header of its payload but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    name = "" if page_id is None else str(page_id)
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{ID}{name}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)))
    if kind == "revisit":
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields.append(("WARC-Refers-To", f"<{ID}{'' if refers_to is None else refers_to}>"))
    fields += [
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields)
    return head.encode() + b"\r\n" + block + END


def write_archives(pages: DataFrame, folder: str, min_size: int = 0, compress: bool = True) -> DataFrame:
    """Write (page_id, url, html) below ``folder``; returns (archive, records, bytes) of what was written."""
    raw = utf8(F.col("html"))
    rows = pages.select("page_id", "url", raw.alias("payload"), F.sha1(raw).alias("digest"))
    large = F.octet_length("payload") >= min_size
    firsts = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = firsts.select(F.col("digest").alias("shared"), "first")
    revisit = large & F.col("shared").isNotNull() & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    marked = rows.join(firsts, F.col("digest") == F.col("shared"), "left").select(
        "page_id", "url", "payload", F.unhex("digest").alias("digest"), F.when(revisit, F.col("first")).alias("first"), revisit.alias("revisit")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, path, records, size = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["archive", "records", "bytes"])

        for batch in batches:
            for page_id, url, payload, digest, first, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path, records, size = f"{folder}/{uuid.uuid4().hex}.warc{'.gz' if compress else ''}", 0, 0
                    out = store.open_output_stream(f"{root}/{path.rsplit('/', 1)[1]}", compression=None)
                name = base64.b32encode(digest).decode()
                data = record_bytes("revisit" if again else "response", page_id, url, payload, name, first)
                data = gzip.compress(data, 6, mtime=0) if compress else data
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= ARCHIVE:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return marked.mapInArrow(run, "archive string, records long, bytes long")


# --- reading ------------------------------------------------------------------------------------


class Damaged(Exception):
    """Why the bytes at a place are no valid record; ``end`` is where the next one may begin, if that is known."""

    def __init__(self, reason: str, end: int | None = None):
        super().__init__(reason)
        self.end = end


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header fields (names in small letters), block and end of the record at ``at``."""
    if not data.startswith(VERSION, at):
        raise Damaged("no version line")
    head_end = data.find(END, at)
    if head_end < 0:
        raise Damaged("header without end")
    fields = {}
    for line in data[at:head_end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without colon")
        fields[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    missing = [n for n in ("warc-type", "warc-record-id", "warc-date") if n not in fields]
    if missing:
        raise Damaged(f"no {missing[0]}")
    if not fields.get("content-length", "").isdigit():
        raise Damaged("no content length")
    begin = head_end + len(END)
    end = begin + int(fields["content-length"])
    block = data[begin:end]
    if data[end : end + len(END)] != END:
        raise Damaged("content does not end where it should")
    wanted = fields.get("warc-block-digest", "")
    if wanted.startswith("sha1:") and wanted[5:] != base32_sha1(block):
        raise Damaged("block digest differs")
    wanted = fields.get("warc-payload-digest", "")
    if fields.get("warc-type") == "response" and wanted.startswith("sha1:") and wanted[5:] != base32_sha1(http_payload(block)[1]):
        raise Damaged("payload digest differs")
    return fields, block, end + len(END)


def http_payload(block: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP header fields and body; a block that is no HTTP message is all body."""
    if not block.startswith(b"HTTP/"):
        return {}, block
    head, _, body = block.partition(END)
    lines = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {k.strip().decode("latin-1").lower(): v.strip().decode("latin-1") for k, _, v in lines}, body


def salvage_bytes(data: bytes) -> tuple[list[tuple[dict[str, str] | None, bytes, str | None]], int, str | None]:
    """Records of the content of a member and gaps (None, b"", reason with its place), the end of the last record, the first reason."""
    found, place, whole, gap, reason, first = [], 0, 0, None, "", None
    lost = lambda end: (None, b"", f"{reason}: {end - gap} bytes at {gap} of the member's content")
    while place < len(data):
        try:
            fields, block, end = parse_record(data, place)
        except Damaged as e:
            if gap is None:
                gap, reason = place, str(e)
                first = first or reason
            place = data.find(VERSION, place + 1)
            if place < 0:
                break
            continue
        if gap is not None:
            found.append(lost(place))
            gap = None
        found.append((fields, block, None))
        place = whole = end
    if gap is not None:
        found.append(lost(len(data)))
    return found, whole, first


class Archive:
    """An archive as a file that can be sought; holds a chunk or a record in memory, not the file."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def bytes_at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(min(n, max(0, self.size - at)))

    def member(self, at: int) -> tuple[bytes, int, str | None]:
        """What the gzip member at ``at`` holds, the end of what could be read, and what is wrong with it."""
        unpack, parts, place = zlib.decompressobj(31), [], at
        while not unpack.eof:
            chunk = self.bytes_at(place, 1 << 16)
            if not chunk:
                return b"".join(parts), place, "member is cut off"
            before = unpack.copy()
            try:
                parts.append(unpack.decompress(chunk))
            except zlib.error:
                for k in range(len(chunk)):  # what comes before the damage
                    try:
                        parts.append(before.decompress(chunk[k : k + 1]))
                    except zlib.error:
                        return b"".join(parts), place + k, "member does not decompress"
            place += len(chunk)
        return b"".join(parts), place - len(unpack.unused_data), None

    def compressed_end(self, at: int, n: int) -> int:
        """Where in the file the first ``n`` bytes of the member at ``at`` are complete."""
        unpack, got, place = zlib.decompressobj(31), 0, at
        while True:
            chunk, before = self.bytes_at(place, 1 << 16), unpack.copy()
            try:
                size = len(unpack.decompress(chunk))
            except zlib.error:
                size = n
            if got + size >= n:
                break
            got, place = got + size, place + len(chunk)
        for k in range(len(chunk)):
            got += len(before.decompress(chunk[k : k + 1]))
            if got >= n:
                return place + k + 1
        return place + len(chunk)

    def plain(self, at: int) -> tuple[dict[str, str], bytes, int]:
        """The uncompressed record at ``at``: the header first, then as much as it asks for."""
        size = 1 << 16
        while True:
            data = self.bytes_at(at, size)
            head = data.find(END)
            if head >= 0 or at + size >= self.size or size > 1 << 24:
                break
            size *= 4
        for line in data[: max(head, 0)].split(b"\r\n"):
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                need = head + 2 * len(END) + int(value)
                if need > self.size - at:
                    raise Damaged("record is cut off")
                data = self.bytes_at(at, max(need, len(data)))
        fields, block, end = parse_record(data)
        return fields, block, at + end

    def records_at(self, at: int) -> tuple[list[tuple[dict[str, str] | None, bytes, str | None]], int, str | None]:
        """Records and inner gaps (None, b"", reason) at ``at``, where they end, and what is wrong with what follows."""
        start = self.bytes_at(at, len(VERSION))
        if start.startswith(MEMBER):
            data, end, broken = self.member(at)
            found, whole, reason = salvage_bytes(data)
            if not whole:
                raise Damaged(broken or reason or "member holds no record", None if broken else end)
            if not broken:
                return found, end, None
            while found[-1][0] is None:  # what comes after the last record is the gap that follows
                found.pop()
            return found, self.compressed_end(at, whole), broken
        if start.startswith(VERSION):
            fields, block, end = self.plain(at)
            return [(fields, block, None)], end, None
        raise Damaged("neither a member nor a version line")

    def next_start(self, at: int) -> int:
        """Where the next member or version line may begin; the size if nowhere."""
        while at < self.size:
            data = self.bytes_at(at, CHUNK)
            hits = [k for k in (data.find(MEMBER), data.find(VERSION)) if k >= 0]
            if hits:
                return at + min(hits)
            if len(data) < CHUNK:
                break
            at += CHUNK - len(VERSION) + 1
        return self.size

    def salvage(self) -> Iterator[tuple[int, int, dict[str, str] | None, bytes, str | None]]:
        """(offset, length, fields, block, None) of each record and (offset, length, None, b"", reason) of each gap."""
        at, gap, reason = 0, None, ""
        while at < self.size:
            try:
                found, end, broken = self.records_at(at)
            except Damaged as e:
                if gap is None:
                    gap, reason = at, str(e)
                at = e.end if e.end is not None else self.next_start(at + 1)
                continue
            if gap is not None:
                yield gap, at - gap, None, b"", reason
                gap = None
            for fields, block, lost in found:
                yield at, end - at, fields, block, lost
            at = end
            if broken and at < self.size:
                gap, reason = at, broken
                at = self.next_start(at)
        if gap is not None:
            yield gap, self.size - gap, None, b"", reason


RECORD = (
    "archive string, offset long, length long, gap string, record_type string, record_id string, target_uri string, "
    "refers_to string, payload_digest string, payload_bytes long, payload binary"
)


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and gaps (``gap``: the reason) of the files in column ``archive``.

    A revisit's payload_digest and payload_bytes are those of the payload it stands for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inner = fs.FileSystem.from_uri(path)
                with store.open_input_file(inner) as file:
                    rows, held = [], 0
                    for offset, length, fields, block, reason in Archive(file, file.size()).salvage():
                        if fields is None:
                            rows.append((path, offset, length, reason, *[None] * 7))
                            continue
                        http, body = http_payload(block)
                        kind, n = fields.get("warc-type"), http.get("content-length", "")
                        again = kind == "revisit"
                        rows.append(
                            (
                                path, offset, length, None, kind, fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"),
                                fields.get("warc-payload-digest", "").removeprefix("sha1:") if again else base32_sha1(body),
                                int(n) if again and n.isdigit() else len(body), body if payloads else None,
                            )
                        )
                        held += len(body) if payloads else 0
                        if len(rows) >= 5000 or held > 8 << 20:
                            yield _rows(rows)
                            rows, held = [], 0
                    if rows:
                        yield _rows(rows)

    return archives.select("archive").repartition(parallelism(archives)).mapInArrow(run, RECORD)


_TYPES = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]
_NAMES = [c.split()[0] for c in RECORD.split(", ")]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def report(pages: DataFrame, min_size: int = 0) -> DataFrame:
    """Write the pages, read the archives back: one row per page, as the archives tell it."""
    folder = scratch_path(pages.sparkSession, "warc")
    folder = folder if "://" in folder or folder.startswith("/") else f"file:{folder}"
    written = materialize(write_archives(pages.select("page_id", "url", "html"), folder, min_size), "archives")
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '{ID}([0-9-]*)', 1) AS bigint)")
    return read_archives(written, payloads=False).where("gap IS NULL").select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )
