"""Legacy archives: ARC files, versions 1 and 2, read by their version-specific header lines and declared lengths, and
converted to WARC records with identifiers, timestamps, types and digests of the same content.

The version block becomes a warcinfo record, HTTP messages become responses, whose payload is what follows the HTTP head,
and anything else (name look-ups, files) a resource. Archives are binary rows of about one to a few megabytes on the way.
Written files hold one gzip member for each record, so records can be sought; the text sink writes them, whose line
separator is the zero byte that ends every member. They are read back whole, file by file, by declared lengths, so payloads
may hold anything.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, table, written

# The field lines of both versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Payloads smaller than this are never revisits.
LEAST_REVISIT = 100
#: About so many bytes of payload go to one archive file.
FILE_BYTES = 4 << 20
DATE = "20240101000000"
HTTP = "application/http; msgtype=response"
_IP = r"(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9A-Fa-f]*:[0-9A-Fa-f:.]*|-)"
#: Header lines: old URLs and content types may hold spaces.
_LINES = {
    1: re.compile(rf"(?P<url>.*) {_IP} (?P<date>[0-9]{{8,14}}) (?P<kind>.*) (?P<length>[0-9]+)"),
    2: re.compile(rf"(?P<url>.*) {_IP} (?P<date>[0-9]{{8,14}}) (?P<kind>.*) (?P<code>\S+) (?P<sum>\S+) (?P<to>\S+) (?P<at>\S+) (?P<file>\S+) (?P<length>[0-9]+)"),
}


def url_field(url: str | None, page: int | None) -> str:
    """A URL without white space, as header lines need it; a made-up one for null."""
    if not url:
        return f"urn:page:{page}"
    return "".join(c if c > " " and c != "\x7f" and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def http_block(payload: bytes) -> bytes:
    """An HTTP message with this body, as archives hold it."""
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head, with the empty line that ends it, and body of an HTTP message; without such a line all is head."""
    ends = [(block.find(x), len(x)) for x in (b"\r\n\r\n", b"\n\n")]
    at = min((i + n for i, n in ends if i >= 0), default=len(block))
    return block[:at], block[at:]


def arc_file(name: str, version: int, records: list[tuple[str, bytes]]) -> bytes:
    """An ARC file: the version block, then (url, block) records."""
    head = f"{version} 0 origin\n{ARC_FIELDS[version]}\n\n".encode()
    fixed = "text/plain" if version == 1 else f"text/plain 200 - - 0 {name}"
    parts = [f"filedesc://{name} 0.0.0.0 {DATE} {fixed} {len(head)}\n".encode(), head, b"\n"]
    at = sum(map(len, parts))
    for url, block in records:
        middle = "text/html" if version == 1 else f"text/html 200 {hashlib.md5(block).hexdigest()} - {at} {name}"
        line = f"{url} 0.0.0.0 {DATE} {middle} {len(block)}\n".encode()
        parts += [line, block, b"\n"]
        at += len(line) + len(block) + 1
    return b"".join(parts)


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """url, ip, date, kind (and in version 2 code, sum, to, at, file) and block of each record, that of the version block first.

    Raises ValueError on a bad version block, line or length.
    """
    line, at = _line(data, 0)
    if not line.startswith("filedesc://"):
        raise ValueError("an ARC file starts with a filedesc line")
    length = int(line.rsplit(" ", 1)[1])
    first = data[at : at + length].split(b"\n")[0].split(b" ")[0]
    version = int(first) if first.isdigit() else 0
    if version not in ARC_FIELDS:
        raise ValueError(f"ARC version {version} is unknown")
    url, ip, date, *rest = line.split(" ")
    yield {"url": url, "ip": ip, "date": date, "kind": rest[0], "version": str(version)}, data[at : at + length]
    at += length
    while True:
        while data[at : at + 1] == b"\n":
            at += 1
        if at >= len(data):
            return
        line, at = _line(data, at)
        m = _LINES[version].fullmatch(line)
        if not m:
            raise ValueError(f"no header line of version {version}: {line[:80]!r}")
        fields = m.groupdict()
        length = int(fields.pop("length"))
        if at + length > len(data):
            raise ValueError("a record is shorter than its declared length")
        yield fields, data[at : at + length]
        at += length
        if data[at : at + 1] not in (b"\n", b""):
            raise ValueError("a record is longer than its declared length")


def _line(data: bytes, at: int) -> tuple[str, int]:
    end = data.find(b"\n", at)
    if end < 0:
        raise ValueError("a header line has no end")
    return data[at:end].rstrip(b"\r").decode("utf-8", "replace"), end + 1


def warc_date(arc_date: str) -> str:
    """YYYYMMDD[hhmm[ss]] as ISO 8601 in UTC."""
    return datetime.strptime(arc_date[:14].ljust(14, "0"), "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(url: str, date: str, digest: str, key: str = "") -> str:
    """The same identifier for the same capture, whenever it is converted."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest} {key}')}>"


def warc_record(fields: dict[str, str], block: bytes, key: str = "", refers: tuple[str, str, str] | None = None) -> bytes:
    """A WARC record of an ARC record.

    key: a page's id, noted in the record. refers: id, URL and ARC date of the page whose payload this one repeats; the record
    is then a revisit, which holds the HTTP head alone.
    """
    date = warc_date(fields["date"])
    more: list[str] = []
    payload = block
    if fields["url"].startswith("filedesc:"):
        kind, content = "warcinfo", "application/warc-fields"
        payload = block = f"software: logweir\r\nformat: WARC File Format 1.1\r\nconverted-from: ARC version {fields['version']}\r\n".encode()
        more.append(f"WARC-Filename: {fields['url'].removeprefix('filedesc://')}")
    elif block.startswith(b"HTTP/"):
        kind, content = "response", HTTP
        head, payload = split_http(block)
    else:
        kind, content = "resource", "text/dns" if fields["url"].startswith("dns:") else fields["kind"]
    digest = hashlib.sha256(payload).hexdigest()
    name = record_id(fields["url"], date, digest, key)
    if kind != "warcinfo":
        more += [f"WARC-Target-URI: {fields['url']}", f"WARC-Payload-Digest: sha256:{digest}"]
        if fields["ip"] not in ("0.0.0.0", "-"):
            more.append(f"WARC-IP-Address: {fields['ip']}")
    if refers is not None:
        page, url, then = refers
        kind, block = "revisit", head if content == HTTP else b""
        more += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(url, warc_date(then), digest, page)}", f"WARC-Refers-To-Target-URI: {url}", f"WARC-Refers-To-Date: {warc_date(then)}", f"X-Refers-To-Page: {page}"]
    if key:
        more += [f"X-Payload-Length: {len(payload)}", f"X-Page: {key}"]
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}", *more, f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}", f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """A gzip member that ends in a zero byte, as all of under 16 MiB do; after larger ones an empty member follows."""
    made = gzip.compress(record, 5, mtime=0)
    return made if made[-1] == 0 else made + gzip.compress(b"", mtime=0)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError("a WARC record has no header")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = dict(x.split(": ", 1) for x in lines)
        length, at = int(fields["Content-Length"]), end + 4
        if data[at + length : at + length + 4] != b"\r\n\r\n":
            raise ValueError("a WARC record's length is wrong")
        yield fields, data[at : at + length]
        at += length + 4


def unpacked(data: bytes) -> bytes:
    """Gzip members, one or many, or plain bytes."""
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def to_arc(pages: DataFrame) -> DataFrame:
    """pages, refers, refers_urls and content: ARC files of pages (page_id, url, html, refers_to, refers_url), of both versions in turn."""
    ids, names = pa.list_(pa.int64()), pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            page, urls, refers, refers_urls = (b.column(i).to_pylist() for i in (0, 1, 3, 4))
            payloads = [x or b"" for x in b.column(2).cast(pa.binary()).to_pylist()]
            lo = size = 0
            for i, p in enumerate(payloads):
                size += len(p)
                if size >= FILE_BYTES // 4 or i == len(page) - 1:
                    version = 1 + zlib.crc32(str(page[lo]).encode()) % 2
                    content = arc_file(f"pages-{page[lo]}.arc", version, [(url_field(urls[k], page[k]), http_block(payloads[k])) for k in range(lo, i + 1)])
                    yield pa.RecordBatch.from_pydict({"pages": pa.array([page[lo : i + 1]], ids), "refers": pa.array([refers[lo : i + 1]], ids), "refers_urls": pa.array([refers_urls[lo : i + 1]], names), "content": pa.array([content], pa.binary())})
                    lo, size = i + 1, 0

    return pages.select("page_id", "url", "html", "refers_to", "refers_url").mapInArrow(run, "pages array<long>, refers array<long>, refers_urls array<string>, content binary")


def converted(content: bytes) -> Iterator[bytes]:
    """WARC records of any ARC file."""
    for fields, block in parse_arc(unpacked(content)):
        yield warc_record(fields, block)


def convert(arcs: DataFrame) -> DataFrame:
    """A column value of gzip members without their last byte, one for each WARC record, from ARC files of pages (pages, refers, refers_urls, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pages, refers, urls, content in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), strict=True):
                records = parse_arc(unpacked(content.as_py()))
                out = [member(warc_record(*next(records)))[:-1]]
                for (fields, block), page, refer, url in zip(records, pages, refers, urls, strict=True):
                    out.append(member(warc_record(fields, block, "" if page is None else str(page), None if refer is None else (str(refer), url_field(url, refer), DATE)))[:-1])
                raw = pa.array(out, pa.binary())
                # The text sink takes strings and writes their bytes as they are.
                yield pa.RecordBatch.from_arrays([pa.StringArray.from_buffers(len(raw), *raw.buffers()[1:])], names=["value"])

    return arcs.select("pages", "refers", "refers_urls", "content").mapInArrow(run, "value string")


def write_warc(members: DataFrame, path: str) -> None:
    """Files of gzip members; a lost task writes its file again."""
    members.write.option("lineSep", "\0").text(path)


def read_warc(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, warc_date and record_id of the records of pages in the files.

    Responses' digests are taken from the payload that was read and must be those declared; a revisit has what it declares.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = []
                for fields, block in parse_warc(unpacked(content.as_py())):
                    if fields["WARC-Type"] not in ("response", "revisit"):
                        continue
                    digest, page, refers = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields.get("X-Page"), fields.get("X-Refers-To-Page")
                    _, payload = split_http(block)
                    size = len(payload)
                    if fields["WARC-Type"] == "revisit":
                        size = int(fields["X-Payload-Length"])
                    elif hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"record {fields['WARC-Record-ID']} doesn't hold what it declares")
                    rows.append((int(page) if page else None, size, digest, fields["WARC-Type"], int(refers) if refers else None, fields["WARC-Date"], fields["WARC-Record-ID"]))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
                columns = list(zip(*rows, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "warc_date", "record_id"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, warc_date string, record_id string")


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages through ARC files and the converter into WARC files, and what those hold: one row for each input row.

    Of records with equal payloads of at least 100 bytes, the one with the smallest id is the response and the others
    revisit it; smaller ones are responses. Null html is an empty payload, a null or blank url a made-up one. Rows without
    an id are responses and referred to by none; rows that repeat an id and payload come out each, both as responses if
    theirs is the smallest. An empty table gives an empty table.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))
    size = F.octet_length("html")
    large = written(pages.where((size >= LEAST_REVISIT) & F.col("page_id").isNotNull()).select("page_id", "url", F.sha2(F.encode("html", "UTF-8"), 256).alias("digest"), size.alias("n")), "digests")
    total = large.agg(F.sum("n")).first()[0] or 0
    firsts = written(large.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.max("page_id").alias("last")).where("first.page_id < last").select("digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url")), "firsts")
    revisits = written(large.join(firsts, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to", "refers_url").distinct(), "revisits")
    keyed = pages.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256)).join(revisits, ["page_id", "digest"], "left")
    spread = keyed.repartition(max(1, -(-total // FILE_BYTES)), F.xxhash64("page_id", "digest"))
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(convert(to_arc(spread)), path)
    return read_warc(spark, path)


def op7_arc_to_warc(spark, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS digest FROM p),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to FROM f
"""
