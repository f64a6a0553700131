"""Legacy archive conversion: ARC files of versions 1 and 2 to WARC 1.1, and reading WARC back.

An ARC file begins with a version block whose header line names the file (`filedesc://...`) and whose body gives the version and the list of fields.
Version 1 has the header lines `URL IP-address Archive-date Content-type Archive-length`; version 2 adds `Result-code Checksum Location Offset Filename`
before the length. Each record is a header line, as many bytes as it declares, and a newline. The converter reads the lines by the fields of their file's
version, takes bodies by declared length, and makes WARC records: a warcinfo record for the version block, response records for HTTP bodies, resource
records for others (dns), and revisit records where an equal payload has its response elsewhere. Record ids are UUIDs of the record's address, date and
digest; dates, types and digests follow from the ARC fields.

Files are written through Spark's text writer, so that its commit protocol guards against lost executors: a row is a whole file of about FILE_BYTES of
records, each record a gzip member. The last member is an empty one, whose closing zero byte is the writer's line separator.

Edge cases. A null payload is an empty one. A null or empty URL becomes `urn:page:` and the id, and spaces and control characters in a URL are
percent-encoded. Header lines that cannot be read, or lengths beyond the file's end, stop the job with the offset. Repeated rows give repeated records; of
equal payloads all rows with the largest page_id are responses. A null page_id is kept as null, and its equal payloads are revisits of the largest id.
An empty table gives no rows. Extra columns do not take part.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, small

FILE_BYTES = 16 << 20
#: So many bytes are given to the decompressor at once.
STEP = 8 << 10
#: Fields of the header line by version.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
#: A gzip member of nothing; like any it ends with its length, four zero bytes.
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def inflated(data: bytes) -> bytes:
    """All members of a gzip file; plain data as it is. Members are fed in small steps, as what is fed beyond a member's end is copied."""
    if data[:2] != b"\x1f\x8b":
        return data
    out, at, view = [], 0, memoryview(data)
    while data[at : at + 2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        while not z.eof and at < len(data):
            out.append(z.decompress(view[at : at + STEP]))
            at += min(STEP, len(data) - at) - len(z.unused_data)
        out.append(z.flush())
    return b"".join(out)


# ---- ARC


def arc_version_block(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 lorekeep\n{' '.join(FIELDS[version])}\n\n".encode()
    return arc_line(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", len(body), name=name) + body + b"\n"


def arc_line(version: int, url: str, ip: str, date: str, kind: str, length: int, *, code: str = "200", checksum: str = "-", offset: int = 0, name: str = "-") -> bytes:
    more = [code, checksum, "-", str(offset), name] if version == 2 else []
    return (" ".join([url, ip, date, kind, *more, str(length)]) + "\n").encode()


def safe_url(url: str | None, page_id) -> str:
    return "".join(quote(c) if c <= " " or c == "\x7f" or c.isspace() else c for c in url or "") or f"urn:page:{page_id}"


def http_block(page_id, payload: bytes) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {'' if page_id is None else page_id}\r\n\r\n"
    return head.encode() + payload


def write_arc(rows: Iterable[tuple], version: int, date: str = "20250101000000") -> Iterator[bytes]:
    """ARC files (gzip members) of rows (page_id, url, payload), each of about FILE_BYTES of records."""
    parts, size, n = [], 0, 0
    for page_id, url, payload in rows:
        name = f"pages-v{version}-{n:05}.arc"
        if not parts:
            parts.append(member(arc_version_block(name, version, date)))
        block = http_block(page_id, payload)
        line = arc_line(version, safe_url(url, page_id), "0.0.0.0", date, "text/html", len(block), checksum=hashlib.sha1(payload).hexdigest(), offset=size, name=name)
        parts.append(member(line + block + b"\n"))
        size += len(line) + len(block)
        if size >= FILE_BYTES:
            yield b"".join(parts)
            parts, size, n = [], 0, n + 1
    if parts:
        yield b"".join(parts)


def read_arc(data: bytes) -> Iterator[dict]:
    """The records of an ARC file: fields by name, and body. The first is the version block."""
    data, at, fields = inflated(data), 0, FIELDS[1]
    while at < len(data):
        end = data.find(b"\n", at)
        if end == at:  # a blank line between records
            at += 1
            continue
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r").split(" ")
        if line[0].startswith("filedesc://"):  # its own line has as many fields as its version
            fields = FIELDS[2] if len(line) == len(FIELDS[2]) else FIELDS[1]
        if end < 0 or len(line) < len(fields) or not line[-1].isdigit():
            raise ValueError(f"no ARC header line at byte {at}")
        # a content type may hold spaces: what is over goes to it
        over = len(line) - len(fields)
        line = [*line[:3], " ".join(line[3 : 4 + over]), *line[4 + over :]]
        record = dict(zip(fields, line, strict=True))
        start, stop = end + 1, end + 1 + int(record["Archive-length"])
        if stop > len(data):
            raise ValueError(f"the ARC record at byte {at} declares more bytes than there are")
        record["body"] = data[start:stop]
        if line[0].startswith("filedesc://"):
            said = record["body"].split(b"\n", 2)
            if len(said) > 1 and said[1].strip():
                fields = said[1].decode("utf-8", "replace").split()
        yield record
        at = stop + 1 if data[stop : stop + 1] == b"\n" else stop


# ---- WARC


def base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def warc_date(date: str) -> str:
    """Of an ARC date: 14 digits, or fewer, which are filled up."""
    digits = (date + "00000101000000"[len(date) :])[:14] if date.isdigit() else "19700101000000"
    return datetime.strptime(digits, "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(url: str, date: str, digest: str, key: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest} {key}')}>"


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """Header with its blank line, and entity."""
    cut = body.find(b"\r\n\r\n")
    return (body[: cut + 4], body[cut + 4 :]) if body.startswith(b"HTTP/") and cut >= 0 else (b"", body)


def http_field(head: bytes, name: bytes) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        if k.strip().lower() == name:
            return v.strip().decode("utf-8", "replace") or None
    return None


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def convert(record: dict, refers: tuple[str, str] | None = None) -> bytes:
    """The WARC record of an ARC record. refers: record id and URL of the response with the same payload, for a revisit."""
    url, date, body = record["URL"], warc_date(record["Archive-date"]), record["body"]
    head, payload = split_http(body)
    kind, content = ("response", "application/http; msgtype=response") if head else ("resource", record["Content-type"])
    if url.startswith("filedesc://"):
        kind, content, payload = "warcinfo", "application/warc-fields", body
        body = payload = f"software: lorekeep\r\nformat: WARC File Format 1.1\r\nconverted-from: {url.removeprefix('filedesc://')}\r\n".encode()
    digest = base32(hashlib.sha1(payload).digest())
    key = http_field(head, b"x-page-id") or ""
    headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id(url, date, digest, key)), ("WARC-Date", date)]
    headers += [("WARC-Filename", url.removeprefix("filedesc://"))] if kind == "warcinfo" else [("WARC-Target-URI", url), ("WARC-IP-Address", record["IP-address"])]
    if refers and kind == "response":
        headers[0] = ("WARC-Type", "revisit")
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", refers[0]), ("WARC-Refers-To-Target-URI", refers[1])]
        body = head
    headers += [("WARC-Payload-Digest", digest)] if kind != "warcinfo" else []
    return warc_record([*headers, ("WARC-Block-Digest", base32(hashlib.sha1(body).digest())), ("Content-Type", content)], body)


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (by lower-case name) and block of each record of a WARC file."""
    data, at = inflated(data), 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        stop = start + int(headers["content-length"])
        if stop > len(data):
            raise ValueError(f"the WARC record at byte {at} declares more bytes than there are")
        yield headers, data[start:stop]
        at = stop + 4


# ---- Spark


def write_files(files: DataFrame, path: str) -> None:
    """files: column content, a file of gzip members each."""
    whole = F.concat(F.col("content"), F.lit(EMPTY_MEMBER[:-1])).cast("string")
    files.select(whole.alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", "\0").text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of the archives below a path."""
    return spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path).select("path", "content")


def pages_to_arc(pages: DataFrame, path: str) -> None:
    """Write pages (page_id, url, html) as ARC files, of both versions: even ids version 1, others version 2."""

    def run(batches):
        for batch in batches:
            ids, urls, bodies = batch.columns
            rows = [(i.as_py(), u.as_py(), b.as_py() or b"") for i, u, b in zip(ids, urls, bodies, strict=True)]
            for version in (1, 2):
                for file in write_arc((r for r in rows if ((r[0] or 0) % 2 == 0) == (version == 1)), version):
                    yield pa.RecordBatch.from_arrays([pa.array([file], pa.binary())], names=["content"])

    write_files(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")).mapInArrow(run, "content binary"), path)


def arc_records(files: DataFrame) -> DataFrame:
    """The records of ARC files (column content), version blocks included: url, ip, date, kind, body, and of HTTP bodies page_id, payload_bytes, digest; record_id and warc_type are what conversion gives."""

    def run(batches):
        names = ["url", "ip", "date", "kind", "body", "page_id", "payload_bytes", "digest", "record_id"]
        for batch in batches:
            for file in batch.column(0):
                rows, size = [], 0
                for r in read_arc(file.as_py()):
                    head, payload = split_http(r["body"])
                    digest, page = hashlib.sha1(payload), http_field(head, b"x-page-id")
                    name = record_id(r["URL"], warc_date(r["Archive-date"]), base32(digest.digest()), page or "")
                    rows.append((r["URL"], r["IP-address"], r["Archive-date"], r["Content-type"], r["body"], int(page) if page and page.lstrip("-").isdigit() else None, len(payload), digest.hexdigest(), name))
                    size += len(r["body"])
                    if size >= 4 << 20:
                        yield _batch(rows, names)
                        rows, size = [], 0
                yield _batch(rows, names)

    return files.select("content").mapInArrow(run, "url string, ip string, date string, kind string, body binary, page_id long, payload_bytes long, digest string, record_id string")


def _batch(rows, names):
    types = {"body": pa.binary(), "page_id": pa.int64(), "payload_bytes": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types.get(n, pa.string())) for i, n in enumerate(names)], names=names)


def convert_archives(spark: SparkSession, arc: str, warc: str, least: int = 1000) -> None:
    """ARC files below arc to WARC files below warc. Of HTTP records with equal payloads of at least `least` bytes, those of the largest page_id are responses and the others revisits."""
    records = arc_records(read_files(spark, arc))
    http = (F.col("payload_bytes") >= least) & ~F.col("url").startswith("filedesc://") & (F.substring("body", 1, 5) == F.lit(b"HTTP/"))
    # digests that repeat, with the record that stays; the others need no look-up
    keys = records.where(http).groupBy("digest", "payload_bytes").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "record_id", "url")).alias("first"))
    kept = cut(keys.where("n > 1").select(F.col("digest").alias("d"), F.col("payload_bytes").alias("b"), "first"))
    x = records.join(small(kept), (F.when(http, F.col("digest")) == F.col("d")) & (F.col("payload_bytes") == F.col("b")), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    x = x.select("url", "ip", "date", "kind", "body", F.when(revisit, F.col("first.record_id")).alias("to_id"), F.when(revisit, F.col("first.url")).alias("to_url"))

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for url, ip, date, kind, body, to_id, to_url in zip(*batch.columns, strict=True):
                r = {"URL": url.as_py(), "IP-address": ip.as_py(), "Archive-date": date.as_py(), "Content-type": kind.as_py(), "body": body.as_py()}
                record = convert(r, (to_id.as_py(), to_url.as_py()) if to_id.as_py() else None)
                parts.append(member(record))
                size += len(record)
                if size >= FILE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["content"])
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["content"])

    write_files(x.mapInArrow(run, "content binary"), warc)


def warc_pages(spark: SparkSession, path: str) -> DataFrame:
    """What WARC files say of their HTTP records: page_id, url, payload_bytes, payload_digest (hex), record_type, record_id, refers_to_id, and ok: blocks and digests agree."""

    def run(batches):
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "record_id", "refers_to_id", "ok"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()]
        for batch in batches:
            for file in batch.column(0):
                rows = []
                for h, block in read_warc(file.as_py()):
                    if h["warc-type"] not in ("response", "revisit"):
                        continue
                    head, payload = split_http(block)
                    page, length = http_field(head, b"x-page-id"), http_field(head, b"content-length")
                    digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                    whole = h["warc-type"] == "revisit" or (hashlib.sha1(payload).hexdigest() == digest and len(payload) == int(length))
                    whole = whole and base32(hashlib.sha1(block).digest()) == h["warc-block-digest"]
                    rows.append((int(page) if page else None, h["warc-target-uri"], int(length), digest, h["warc-type"], h["warc-record-id"], h.get("warc-refers-to"), whole))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return read_files(spark, path).select("content").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, record_id string, refers_to_id string, ok boolean")
