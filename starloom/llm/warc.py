"""Operator 3: legacy ARC archives to WARC.

ARC files hold records of one header line and a body of declared length. The
first record names the version: version 1 lines have five fields, version 2
lines ten. :func:`parse_arc` reads both; :func:`to_warc` synthesises what WARC
asks for beyond that: record identifiers, ISO timestamps, record types and
payload digests. Records with equal payloads are written once as ``response``;
the others become ``revisit`` records that keep the HTTP header and refer to
the first.

WARC files are written gzip-compressed record by record, under names unique to
the task attempt; only files named by the manifest, which Spark commits as a
whole, are read back.

Defined results for odd input: null html is an empty payload; null or blank
addresses become ``urn:unknown``, white space in addresses is percent-encoded
(the header line is split at spaces); bodies shorter than declared raise an
error with the offset; repeated ids are separate records, and every record of
the least id among equal payloads is a response; null ids sort last and are
written as records without an id; an empty table gives no files and an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.llm.common import as_uri, cut_lineage, fresh_path, open_input, open_output, short_batches

#: Field names of the header lines, by version (fixed by the format).
ARC_FIELDS = {
    "1": ("url", "ip", "date", "mime", "length"),
    "2": ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
ROLL_BYTES = 64 << 20
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122


@dataclass
class ArcRecord:
    fields: dict
    body: bytes
    offset: int


class ArcError(ValueError):
    """An archive that doesn't follow its declared version or lengths."""


def arc_header(version: str, **fields) -> bytes:
    return (" ".join(str(fields.get(k) or "-") for k in ARC_FIELDS[version]) + "\n").encode()


def arc_preamble(version: str = "1", name: str = "pages.arc", date: str = "20000101000000") -> bytes:
    """The version block with which every archive begins."""
    body = f"{version} 0 archive\n{'URL IP-address Archive-date Content-type Archive-length' if version == '1' else 'URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length'}\n".encode()
    head = f"filedesc://{name} 0.0.0.0 {date} text/plain " + (f"{len(body)}\n" if version == "1" else f"200 - - 0 {name} {len(body)}\n")
    return head.encode() + body + b"\n"


def parse_arc(stream) -> Iterator[ArcRecord]:
    """Records of an (uncompressed) archive, the version block left out."""
    first = stream.readline()
    parts = first.decode("latin-1").split()
    if not first.startswith(b"filedesc:") or not parts[-1].isdigit():
        raise ArcError("no version block at offset 0")
    block = stream.read(int(parts[-1]))
    version = block.split(b" ", 1)[0].decode("latin-1")
    names = ARC_FIELDS.get(version)
    if names is None or len(parts) not in {len(x) for x in ARC_FIELDS.values()}:
        raise ArcError(f"unknown archive version {version!r}")
    at = len(first) + len(block)
    while line := stream.readline():
        here, at = at, at + len(line)
        if not line.strip():
            continue  # records are set apart by an empty line
        values = line.decode("utf-8", "surrogateescape").rstrip("\r\n").split(" ")
        if len(values) != len(names) or not values[-1].isdigit():
            raise ArcError(f"header line with {len(values)} fields at offset {here}; version {version} has {len(names)}")
        body = stream.read(int(values[-1]))
        if len(body) < int(values[-1]):
            raise ArcError(f"body of {len(body)} bytes at offset {here}; {values[-1]} were declared")
        at += len(body)
        yield ArcRecord(dict(zip(names, values, strict=True)), body, here)


def iso_date(stamp: str) -> str:
    """ARC's 14 (or fewer) digits as a WARC timestamp."""
    digits = re.sub(r"\D", "", stamp)
    padded = digits + "00000101000000"[len(digits) : 14] if len(digits) < 14 else digits[:14]
    return f"{padded[:4]}-{padded[4:6]}-{padded[6:8]}T{padded[8:10]}:{padded[10:12]}:{padded[12:14]}Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP header block (with its blank line) and payload; no header: all payload."""
    if body.startswith(b"HTTP/"):
        head, mark, rest = body.partition(b"\r\n\r\n")
        if mark:
            return head + mark, rest
    return b"", body


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, key)}>"


def page_record_id(page_id: int) -> str:
    """Reversible identifier: a version 8 UUID that holds the 64-bit id."""
    n = page_id & (1 << 64) - 1
    return f"<urn:uuid:{uuid.UUID(int=(n >> 16) << 80 | 8 << 76 | 2 << 62 | (n & 0xFFFF))}>"


def page_of(identifier: str) -> int | None:
    """The id held by :func:`page_record_id`; None for other identifiers."""
    n = uuid.UUID(identifier.strip("<>").rsplit(":", 1)[1]).int
    if n >> 76 & 15 != 8 or n >> 62 & 3 != 2:
        return None
    value = (n >> 80) << 16 | n & 0xFFFF
    return value - (1 << 64) if value >> 63 else value


def to_warc(record: ArcRecord, *, identifier: str | None = None, refers_to: str | None = None) -> bytes:
    """The WARC record of an ARC record, as bytes.

    Type: ``revisit`` if ``refers_to`` names the record with the same payload,
    else ``response`` for records with an HTTP header and ``resource`` for the
    rest. The digest is that of the payload in both cases.
    """
    f = record.fields
    http, payload = split_http(record.body)
    kind = "revisit" if refers_to else "response" if http else "resource"
    block = http if refers_to else record.body
    mime = "application/http;msgtype=response" if http else f["mime"]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {identifier or record_id(f'{f["url"]} {f["date"]} {record.offset}')}",
        f"WARC-Date: {iso_date(f['date'])}",
        f"WARC-Target-URI: {f['url']}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
    ]
    if re.fullmatch(r"[0-9A-Fa-f:.]+", f["ip"]) and f["ip"] != "0.0.0.0":
        lines.append(f"WARC-IP-Address: {f['ip']}")
    if refers_to:
        lines += [f"WARC-Refers-To: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"Content-Type: {mime}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member, so that a record can be read from its offset alone."""
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class GzipMembers(io.RawIOBase):
    """Decompressed view of a file of gzip members, in bounded memory."""

    def __init__(self, stream):
        self.stream, self.unpack, self.raw = stream, zlib.decompressobj(31), b""

    def readable(self):
        return True

    def readinto(self, buffer):
        while True:
            if not self.raw:
                self.raw = self.stream.read(1 << 18)
                if not self.raw:
                    return 0
            data = self.unpack.decompress(self.raw, len(buffer))
            self.raw = self.unpack.unconsumed_tail
            if self.unpack.eof:
                self.raw, self.unpack = self.unpack.unused_data, zlib.decompressobj(31)
            if data:
                buffer[: len(data)] = data
                return len(data)


def open_archive(path: str):
    """An archive, compressed or not, as a buffered stream."""
    stream = open_input(path)
    packed = stream.read(2) == b"\x1f\x8b"
    stream.seek(0)
    return io.BufferedReader(GzipMembers(stream) if packed else _Plain(stream), 1 << 18)


class _Plain(io.RawIOBase):
    def __init__(self, stream):
        self.stream = stream

    def readable(self):
        return True

    def readinto(self, buffer):
        data = self.stream.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def parse_warc(stream) -> Iterator[tuple[dict, bytes]]:
    """(header fields in lower case, block) of each record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC version line: {line[:40]!r}")
        head = {}
        while (line := stream.readline()) and line.strip():
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            head[name.strip().lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        if len(block) < int(head["content-length"]):
            raise ValueError("record cut short")
        yield head, block


MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType())])


class WarcWriter:
    """Rolls over to a new file every ``ROLL_BYTES``."""

    def __init__(self, root: str):
        self.root, self.out, self.done = root, None, []

    def write(self, data: bytes) -> None:
        if self.out is None:
            self.path = f"{self.root}/{uuid.uuid4().hex}.warc.gz"
            self.out, self.records, self.bytes = open_output(self.path), 0, 0
            self.put(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: " + f"<urn:uuid:{uuid.uuid4()}>".encode() + b"\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: 20\r\n\r\nformat: WARC/1.1\r\n\r\n\r\n\r\n")
        self.put(data)
        self.records += 1
        if self.bytes >= ROLL_BYTES:
            self.close()

    def put(self, data: bytes) -> None:
        packed = member(data)
        self.out.write(packed)
        self.bytes += len(packed)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append({"path": self.path, "records": self.records, "bytes": self.bytes})
            self.out = None


def _arrow(schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def arc_entry(page_id: int | None, url: str | None, html: str | None, version: str, date: str = "20000101000000") -> bytes:
    """One page as a legacy record: header line, HTTP response, empty line."""
    payload = (html or "").encode()
    name = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{name}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    address = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), (url or "").strip()) or "urn:unknown"
    return arc_header(version, url=address, ip="0.0.0.0", date=date, mime="text/html", status=200, length=len(body)) + body + b"\n"


def with_first_of_payload(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """``pages`` and ``_first``, the least id among the rows of equal payload.

    Digests and ids alone are grouped, with partial sums before the shuffle, and
    written down, so that the join back is one of plain tables, which adaptive
    execution splits where one payload is very common.
    """
    keyed = pages.withColumn("_digest", F.unhex(F.sha1(F.coalesce(F.col(payload_col), F.lit("")).cast("binary"))))
    first = cut_lineage(keyed.groupBy("_digest").agg(F.min(id_col).alias("_first")), "first")
    return keyed.join(first, "_digest")


def convert_pages(pages: DataFrame, out_dir: str, *, version: str = "1", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as legacy records, converted to WARC files; returns the manifest."""
    spark = pages.sparkSession
    short_batches(spark)
    root = as_uri(out_dir).rstrip("/")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = with_first_of_payload(rows, "page_id", "html").select("page_id", "url", "html", "_first")

    def convert(batches):
        import pyarrow as pa

        writer = WarcWriter(root)
        try:
            for batch in batches:
                for page_id, url, html, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    legacy = io.BytesIO(arc_preamble(version) + arc_entry(page_id, url, html, version))
                    repeat = first is not None and page_id != first
                    for record in parse_arc(legacy):
                        writer.write(to_warc(record, identifier=None if page_id is None else page_record_id(page_id), refers_to=page_record_id(first) if repeat else None))
        finally:
            writer.close()
        if writer.done:
            yield pa.RecordBatch.from_pylist(writer.done, schema=_arrow(MANIFEST))

    manifest = f"{root}/manifest"
    rows.mapInArrow(convert, MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def convert_archives(spark: SparkSession, paths: list[str], out_dir: str) -> DataFrame:
    """Existing ARC files (compressed or not) to WARC files; returns the manifest.

    One task per archive, streamed record by record; equal payloads within an
    archive become revisits of the first.
    """
    root = as_uri(out_dir).rstrip("/")
    sources = spark.createDataFrame([(as_uri(p),) for p in paths], "path string").repartition(max(1, len(paths)), "path")

    def convert(batches):
        import pyarrow as pa

        writer = WarcWriter(root)
        try:
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    seen: dict[bytes, str] = {}
                    for record in parse_arc(open_archive(path)):
                        payload = split_http(record.body)[1]
                        key = hashlib.sha1(payload).digest()
                        name = record_id(f"{path} {record.offset}")
                        writer.write(to_warc(record, identifier=name, refers_to=seen.get(key)))
                        seen.setdefault(key, name)
        finally:
            writer.close()
        if writer.done:
            yield pa.RecordBatch.from_pylist(writer.done, schema=_arrow(MANIFEST))

    manifest = f"{root}/manifest"
    sources.mapInArrow(convert, MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


RECORDS = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to_id", T.StringType()),
        T.StructField("http", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def read_warc(manifest: DataFrame, *, payloads: bool = True) -> DataFrame:
    """The records of the files a manifest names; ``payloads=False`` leaves bodies out.

    ``payload_bytes`` is the full payload's length: that of the block, or for
    revisits what the kept HTTP header declares. Digests of responses are
    checked against their payload.
    """
    spark = manifest.sparkSession
    files = manifest.select("path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for path in batch.column(0).to_pylist():
                out, held = [], 0
                for head, block in parse_warc(open_archive(path)):
                    if head["warc-type"] == "warcinfo":
                        continue
                    http, payload = split_http(block)
                    said = head.get("warc-payload-digest", "").removeprefix("sha1:")
                    repeat = head["warc-type"] == "revisit"
                    if not repeat and said != digest(payload):
                        raise ValueError(f"digest of {head['warc-record-id']} in {path} doesn't match")
                    length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
                    out.append(
                        {
                            "record_id": head["warc-record-id"],
                            "record_type": head["warc-type"],
                            "date": head["warc-date"],
                            "url": head.get("warc-target-uri"),
                            "payload_digest": said,
                            "refers_to_id": head.get("warc-refers-to"),
                            "http": http.decode("latin-1"),
                            "payload_bytes": int(length[1]) if repeat and length else len(payload),
                            "payload": payload if payloads and not repeat else None,
                        }
                    )
                    held += len(block)
                    if held >= 4 << 20 or len(out) >= 2000:
                        yield pa.RecordBatch.from_pylist(out, schema=_arrow(RECORDS))
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=_arrow(RECORDS))

    return files.mapInArrow(read, RECORDS)


def warc_digest(pages: DataFrame, *, out_dir: str | None = None) -> DataFrame:
    """Write pages through the converter, read the archives back, digest them."""
    manifest = convert_pages(pages, out_dir or fresh_path(pages.sparkSession, "warc"))
    back = read_warc(manifest, payloads=False)

    def held(identifier: str):
        """The 64 bits of :func:`page_record_id`: 48 before the version digit, 16 at the end."""
        bare = F.replace(F.regexp_extract(identifier, r"urn:uuid:([0-9a-f-]+)", 1), F.lit("-"), F.lit(""))
        digits = F.concat(F.substring(bare, 1, 12), F.substring(bare, 29, 4))
        return F.when(F.col(identifier).isNotNull(), F.conv(digits, 16, -10).cast("long"))

    page_id = F.when(F.col("http").contains("X-Page-Id: "), held("record_id"))
    return back.select(page_id.alias("page_id"), "payload_bytes", "payload_digest", "record_type", held("refers_to_id").alias("refers_to"), "record_id", "url")
