"""Web archives: legacy ARC files, their conversion to WARC, and reading both.

An archive is a row of a DataFrame: its name and its bytes.  Those written here are
gzip members of one record each, as in `.arc.gz` and `.warc.gz` files; plain archives,
and members of several records, are read too.  `archive_files` reads such files from
any store that Spark reads; archives that Spark writes are Parquet rows, so a lost task
writes its own again and no executor's disk matters.

The converter reads each ARC's version block, takes the header lines that follow by
that version's columns and the bodies by their declared lengths, and makes up what
WARC needs besides: record ids, timestamps, record types and digests.  A body that is an
HTTP response, its head ended by CRLF or by bare LF, becomes a `response`; any other, of `dns:`
or `ftp:` say, is its own payload and becomes a `resource` of the ARC line's type.

What can't be read, an archive's rest from a record of wrong length on or a broken gzip member, is left out, and
`archive_faults` tells of each with the archive's name.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Bytes of members after which an archive is closed.
ARCHIVE_BYTES = 1 << 20
#: Payloads under this size are never revisits.
LEAST_REVISIT = 100
LEVEL = 3
#: Repeated payloads that are sent to every task, 40 bytes each; with more of them each archive gets its own records' answers.
BROADCAST_REPEATS = 1 << 19
#: What a date of fewer than 14 digits is filled up with.
DATE_REST = "00000101000000"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Columns of the header lines, by ARC version.
ARC_COLUMNS = {
    1: ("url", "ip", "date", "content_type", "length"),
    2: ("url", "ip", "date", "content_type", "result_code", "checksum", "location", "offset", "filename", "length"),
}
ARC_LINES = {1: b"URL IP-address Archive-date Content-type Archive-length", 2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}


class ArcRecord(NamedTuple):
    url: str
    ip: str
    date: str
    content_type: str
    status: int | None
    body: bytes


def member(data: bytes) -> bytes:
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, content) of each gzip member; zeros may fill up the rest."""
    at, step = 0, 1 << 15
    while at < len(data):
        if data[at] == 0 and not data[at:].strip(b"\0"):
            return
        unpack, start, parts = zlib.decompressobj(31), at, []
        while not unpack.eof:
            piece = data[at : at + step]
            if not piece:
                raise ValueError("an archive member is cut short")
            parts.append(unpack.decompress(piece))
            at += len(piece) - len(unpack.unused_data)
        yield start, at, b"".join(parts)


def _contents(data: bytes) -> Iterator[tuple[bytes, bytes | None]]:
    """(content, packed) of an archive: its gzip members, or the whole of a plain one, which nothing packs."""
    if data[:2] == b"\x1f\x8b":
        yield from ((content, data[start:end]) for start, end, content in members(data))
    else:
        yield data, None


def safely(parts: Iterator, faults: list[str] | None) -> Iterator:
    """`parts` up to the first that can't be read; why it can't goes to `faults`, or is raised if there is no such list."""
    try:
        yield from parts
    except (ValueError, IndexError, KeyError, zlib.error) as e:
        if faults is None:
            raise
        faults.append(str(e) or type(e).__name__)


def arc_records(data: bytes, faults: list[str] | None = None) -> Iterator[tuple[int, bytes, bytes]]:
    """(version, record, the record in a gzip member of its own) of an ARC archive, without its version block.

    With a list for `faults`, what follows a record that can't be read is left out up to the next gzip member.
    """
    version = [0]
    for content, packed in safely(_contents(data), faults):
        yield from safely(_arc_records(content, packed, version), faults)


def _arc_records(content: bytes, packed: bytes | None, known: list[int]) -> Iterator[tuple[int, bytes, bytes]]:
    at = _after_blanks(content, 0)
    while at < len(content):
        version = known[0]
        cut = content.find(b"\n", at)
        length = content[at:cut].rsplit(b" ", 1)[-1] if cut > 0 else b""  # the last column of both versions
        if not length.isdigit():
            raise ValueError("an ARC record's header line has no length")
        end = cut + 1 + int(length)
        if end > len(content):
            raise ValueError("an ARC record is shorter than its declared length")
        after = _after_blanks(content, end)
        record = content[at:end]
        if version:
            alone = packed is not None and content[:at].strip(b"\r\n") == b"" and after == len(content)
            yield version, record, packed if alone else member(record)
        else:
            known[0] = arc_version(record)
        at = after


def warc_records(data: bytes, faults: list[str] | None = None) -> Iterator[bytes]:
    """The records of a WARC archive; `faults` as in `arc_records`."""
    for content, _ in safely(_contents(data), faults):
        yield from safely(_warc_records(content), faults)


def _warc_records(content: bytes) -> Iterator[bytes]:
    at = _after_blanks(content, 0)
    while at < len(content):
        cut = content.find(b"\r\n\r\n", at)
        length = content[at : max(cut, at)].lower().partition(b"\r\ncontent-length:")[2].partition(b"\r\n")[0].strip()
        if not length.isdigit():
            raise ValueError("a WARC record's head has no length")
        end = cut + 4 + int(length)
        if end > len(content):
            raise ValueError("a WARC record is shorter than its declared length")
        yield content[at:end]
        at = _after_blanks(content, end)


def _after_blanks(content: bytes, at: int) -> int:
    while content[at : at + 1] in (b"\r", b"\n"):
        at += 1
    return at


def arc_head(version: int, name: str, date: str) -> bytes:
    block = f"{version} 0 logloom\n".encode() if version == 1 else f"{version} 0 0 logloom\n".encode()
    block += ARC_LINES[version] + b"\n\n"
    fields = [f"filedesc://{name}", "0.0.0.0", date, "text/plain"] + (["200", "-", "-", "0", name] if version == 2 else []) + [str(len(block))]
    return " ".join(fields).encode() + b"\n" + block


def arc_record(version: int, url: str, date: str, body: bytes, status: int = 200, name: str = "-", offset: int = 0, kind: str = "text/html") -> bytes:
    fields = [url, "0.0.0.0", date, kind] + ([str(status), "-", "-", str(offset), name] if version == 2 else []) + [str(len(body))]
    return " ".join(fields).encode() + b"\n" + body + b"\n"


def arc_version(head: bytes) -> int:
    """The version that the version block of an ARC file declares."""
    block = head.split(b"\n", 2)[1]
    version = int(block.split(b" ", 1)[0])
    if version not in ARC_COLUMNS:
        raise ValueError(f"ARC version {version} is unknown")
    return version


def parse_arc_record(version: int, record: bytes) -> ArcRecord:
    """A record by the columns of its version; the body has the declared length."""
    record = record.lstrip(b"\n")
    line, _, rest = record.partition(b"\n")
    columns = ARC_COLUMNS[version]
    fields = dict(zip(columns, line.decode(errors="replace").rsplit(" ", len(columns) - 1), strict=True))
    length = int(fields["length"])
    if len(rest) < length:
        raise ValueError("an ARC record is shorter than its declared length")
    body = rest[:length]
    status = fields.get("result_code")
    return ArcRecord(fields["url"], fields["ip"], fields["date"], fields["content_type"], int(status) if status and status.isdigit() else http_status(body), body)


def http_status(body: bytes) -> int | None:
    first = body.split(b"\n", 1)[0].strip().split(b" ")
    return int(first[1]) if first[0].startswith(b"HTTP/") and len(first) > 1 and first[1].isdigit() else None


def http_head(body: bytes) -> int:
    """The length of an HTTP response's head, with the blank line that ends it; 0 for a body that is no HTTP response."""
    if not body.startswith(b"HTTP/"):
        return 0
    ends = [at + len(mark) for mark in (b"\r\n\r\n", b"\n\n", b"\n\r\n") if (at := body.find(mark)) >= 0]
    return min(ends) if ends else len(body)


def http_parts(body: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and payload of an HTTP response; any other body is payload as a whole."""
    cut = http_head(body)
    fields = (line.decode(errors="replace").partition(":") for line in body[:cut].split(b"\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in fields if name.strip()}, body[cut:]


def http_response(payload: bytes, page_id: int | None) -> bytes:
    mark = b"" if page_id is None else f"X-Page-Id: {page_id}\r\n".encode()
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n" + mark + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def uri(url: str | None) -> str:
    """The url as one word of ASCII, as header lines need it."""
    return quote(url or "about:blank", safe="".join(map(chr, range(0x21, 0x7F))))


def write_arc(pages: DataFrame, date: str = "20240101000000") -> DataFrame:
    """(name, data): `pages` (page_id, url, html) as ARC archives, by turns of version 1 and 2."""

    def run(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0

        def close(name: str, parts: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(parts)], pa.binary())], names=["name", "data"])

        parts, size, name, version = [], 0, "", 1
        for b in batches:
            for page_id, url, html in zip(*(b.column(k) for k in range(3)), strict=True):
                if not parts:
                    name, version = f"part-{part:05d}-{number:05d}.arc.gz", 1 + number % 2
                    parts = [member(arc_head(version, name, date))]
                    size, number = len(parts[0]), number + 1
                body = http_response((html.as_py() or "").encode(), page_id.as_py())
                parts.append(member(arc_record(version, uri(url.as_py()), date, body, name=name, offset=size)))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield close(name, parts)
                    parts = []
        if parts:
            yield close(name, parts)

    return pages.select("page_id", "url", "html").mapInArrow(run, "name string, data binary")


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, data) of archive files."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("name"), F.col("content").alias("data"))


def read_arc(archives: DataFrame, with_records: bool = True) -> DataFrame:
    """A row per record of ARC archives: name, number (of the record in its archive), page_id (of the record's X-Page-Id, else
    null), digest, payload_bytes and, if asked for, version and record, a gzip member."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = []
                for number, (version, record, packed) in enumerate(arc_records(data.as_py(), [])):
                    fields, payload = http_parts(parse_arc_record(version, record).body)
                    rows.append((name, number, whole_number(fields.get("x-page-id")), hashlib.sha256(payload).digest(), len(payload), version, packed))
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()][: len(names)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

    schema = "name string, number long, page_id long, digest binary, payload_bytes long" + (", version int, record binary" if with_records else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return archives.select("name", "data").mapInArrow(run, schema)


def archive_faults(archives: DataFrame, kind: str = "arc") -> DataFrame:
    """(name, fault): a row for each place at which an archive (`arc` or `warc`) can't be read."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                faults: list[str] = []
                for _ in (arc_records if kind == "arc" else warc_records)(data.as_py(), faults):
                    pass
                if faults:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(faults)), pa.array(faults)], names=["name", "fault"])

    return archives.select("name", "data").mapInArrow(run, "name string, fault string")


def whole_number(text: str | None) -> int | None:
    return int(text) if text and text.removeprefix("-").isdigit() and abs(int(text)) < 1 << 63 else None


def record_id(page_id: int | None, digest: bytes) -> str:
    """A UUID of version 8: the page's id, whether it has one, and the first 57 bits of the payload's digest."""
    value = ((page_id or 0) & (1 << 64) - 1) << 58 | (page_id is None) << 57 | int.from_bytes(digest[:8], "big") >> 7
    return f"<urn:uuid:{uuid.UUID(int=value >> 74 << 80 | 8 << 76 | (value >> 62 & 0xFFF) << 64 | 2 << 62 | value & (1 << 62) - 1)}>"


def page_of_id(text: str | None) -> int | None:
    """The page of a `record_id`; null for other writers' ids."""
    try:
        value = uuid.UUID((text or "").strip().removeprefix("<urn:uuid:").removesuffix(">"))
    except ValueError:
        return None
    n = value.int
    whole = n >> 80 << 74 | (n >> 64 & 0xFFF) << 62 | n & (1 << 62) - 1
    page = whole >> 58
    return None if value.version != 8 or whole >> 57 & 1 else page - (page >> 63 << 64)


def warc_date(date: str) -> str:
    """The ARC date, 4 to 14 digits, as WARC writes it; the start of 1970 for one that is no date."""
    d = date + DATE_REST[len(date) :]
    try:
        return datetime.strptime(d, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ") if d.isdigit() else "1970-01-01T00:00:00Z"
    except ValueError:
        return "1970-01-01T00:00:00Z"


def warc_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_warc_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a WARC record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode(errors="replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
    return fields, rest[: int(fields["content-length"])]


def converted(arc: ArcRecord, digest: bytes, page_id: int | None, refers_to: int | None) -> bytes:
    """The WARC record of an ARC record; with `refers_to` a revisit of that page's record."""
    cut = http_head(arc.body)
    http = cut > 0
    block = arc.body if refers_to is None else arc.body[:cut]
    fields = [("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", warc_date(arc.date)), ("WARC-Target-URI", arc.url), ("WARC-IP-Address", arc.ip)]
    fields += [("WARC-Payload-Digest", f"sha256:{digest.hex()}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http; msgtype=response" if http else arc.content_type), ("X-Payload-Length", str(len(arc.body) - cut))]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))]
    return warc_record("revisit" if refers_to is not None else "response" if http else "resource", fields, block)


def arc_to_warc(archives: DataFrame, least_revisit: int = LEAST_REVISIT, broadcast_repeats: int = BROADCAST_REPEATS) -> DataFrame:
    """(name, data): WARC archives of the records of ARC archives.

    Of records with equal payloads of at least `least_revisit` bytes, that with the
    smallest page_id is a response and the others are revisits of it; a record without
    an id is never the one referred to.  Which is which is found from digests and ids alone.
    """
    light = read_arc(archives, with_records=False).where(F.col("payload_bytes") >= least_revisit)
    first = light.groupBy("digest").agg(F.min("page_id").alias("first_page"), F.count("*").alias("_n")).where("_n > 1 and first_page is not null").drop("_n")
    first = written(first, "repeated-payloads")
    if first.count() <= broadcast_repeats:
        records = read_arc(archives).join(F.broadcast(first), "digest", "left").select("page_id", "digest", "version", "record", "first_page")
    else:
        records = _answered(archives, light, first)

    def run(batches):
        from pyspark import TaskContext

        part, number, parts, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            for page_id, digest, version, record, first_page in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                arc = parse_arc_record(version, zlib.decompress(record, 31))
                parts.append(member(converted(arc, digest, page_id, None if first_page == page_id else first_page)))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{number:05d}.warc.gz"]), pa.array([b"".join(parts)], pa.binary())], names=["name", "data"])
                    parts, size, number = [], 0, number + 1
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{number:05d}.warc.gz"]), pa.array([b"".join(parts)], pa.binary())], names=["name", "data"])

    return records.mapInArrow(run, "name string, data binary")


def _answered(archives: DataFrame, light: DataFrame, first: DataFrame, salts: int = 64) -> DataFrame:
    """The records with their first page, without a join that carries records: the answers are found by digest and a salt, as one
    payload may be a third of all, and each archive looks up those of its own records."""
    salted = light.select("name", "number", "digest", F.pmod(F.xxhash64("name", "number"), F.lit(salts)).alias("salt"))
    found = salted.join(first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["digest", "salt"])
    answers = found.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("number", "first_page"))).alias("answers"))

    def run(batches):
        for b in batches:
            for data, answers in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                known, rows = dict(answers or ()), []
                for number, (version, record, packed) in enumerate(arc_records(data.as_py(), [])):
                    fields, payload = http_parts(parse_arc_record(version, record).body)
                    rows.append((whole_number(fields.get("x-page-id")), hashlib.sha256(payload).digest(), version, packed, known.get(number)))
                if rows:
                    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "digest", "version", "record", "first_page"])

    return archives.join(answers, "name", "left").select("data", "answers").mapInArrow(run, "page_id long, digest binary, version int, record binary, first_page long")


def read_warc(archives: DataFrame) -> DataFrame:
    """A row per record of WARC archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url, date, html
    (null for a revisit).  A response whose payload isn't that of its SHA-256 digest is an error; of other writers'
    records, digests of other kinds aren't checked, and what a revisit doesn't tell is null.  Other types of records
    than responses, resources and revisits are left out, and so is what can't be read (`archive_faults`)."""

    def run(batches):
        for b in batches:
            for data in b.column(0):
                rows = []
                for record in warc_records(data.as_py(), []):
                    fields, block = parse_warc_record(record)
                    kind = fields.get("warc-type")
                    if kind not in ("response", "resource", "revisit"):
                        continue
                    http, payload = http_parts(block)
                    told, own = fields.get("warc-payload-digest", ""), None if kind == "revisit" else hashlib.sha256(payload).hexdigest()
                    digest = told.removeprefix("sha256:") if told.startswith("sha256:") else own
                    if own is not None and own != digest:
                        raise ValueError(f"{fields.get('warc-record-id')}: the payload isn't that of its digest")
                    length = whole_number(fields.get("x-payload-length"))
                    length = length if length is not None else len(payload) if own is not None else None
                    refers = page_of_id(fields.get("warc-refers-to")) if kind == "revisit" else None
                    rows.append((whole_number(http.get("x-page-id")), length, digest, kind, refers, fields.get("warc-target-uri"), fields.get("warc-date"), payload.decode(errors="replace") if own is not None else None))
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, date string, html string"
    names = [c.split()[0] for c in schema.split(", ")]
    return archives.select("data").mapInArrow(run, schema)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write `pages` as ARC, convert to WARC, read that back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload, a null url `about:blank`.  Repeated rows are a
    record each, with the same answer.  Other columns are not looked at; an empty
    table gives an empty result.
    """
    arc = written(write_arc(pages), "arc")
    warc = written(arc_to_warc(arc), "warc")
    return read_warc(warc).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
