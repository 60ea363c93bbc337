"""Legacy archive converter: ARC records of version 1 and 2 to WARC/1.0 records, written and read back.

An ARC archive starts with a version block, whose second line names the version; every document has one header
line (5 fields in version 1, 10 in version 2, the last of which declares the length) and so many bytes. The
converter synthesises record identifiers, timestamps, types and SHA-1 digests. Records whose payload
another record holds are written as revisits. Archives are text files of Spark's writer with the
record end as line separator, which gives whole WARC files on any file system that Spark writes to.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barrspark.llm.common import materialize, scratch_path

REVISIT_BYTES = 1000
RECORDS_PER_FILE = 2000
_END = "\r\n\r\n"
#: Fields of a document's header line by archive version.
_FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


class ArcRecord(NamedTuple):
    """A document of an archive; ``whole`` is false for bytes that follow a damaged header line or end early."""

    offset: int
    url: str
    ip: str
    date: str
    mime: str
    content: bytes
    whole: bool = True


def arc_version_block(version: int, name: str, date: str = "19960101000000") -> bytes:
    """The first record of an archive of the given version."""
    names = ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length")
    if version == 2:
        names = (*names[:4], "Result-code", "Checksum", "Location", "Offset", "Filename", names[4])
    body = f"{version} 0 barrspark\n{' '.join(names)}\n".encode()
    middle = f" 200 - - 0 {name}" if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{middle} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, content: bytes, *, ip: str = "0.0.0.0", date: str = "19960101000000", mime: str = "text/html", offset: int = 0, name: str = "-") -> bytes:
    middle = f" 200 - - {offset} {name}" if version == 2 else ""
    return f"{url} {ip} {date} {mime}{middle} {len(content)}\n".encode() + content + b"\n"


def _header(line: bytes, version: int) -> dict[str, str] | None:
    """Fields of a header line, counted from its right end as URLs may hold spaces."""
    names = _FIELDS[version]
    parts = line.decode("utf-8", "replace").rstrip("\r").rsplit(" ", len(names) - 1)
    if len(parts) != len(names) or not parts[-1].isdigit():
        return None
    return dict(zip(names, parts, strict=True))


def parse_arc(archive: bytes) -> Iterator[ArcRecord]:
    """All documents of an archive, without its version block.

    An archive without a version block is read as version 1. From a header line that cannot be read on, the
    rest is one record that is not whole; so is a document that ends before its declared length. Gzip
    members are inflated first.
    """
    if archive[:2] == b"\x1f\x8b":
        archive = gunzip(archive)
    at, version = 0, 1
    while at < len(archive):
        if archive[at : at + 1] == b"\n":
            at += 1
            continue
        stop = archive.find(b"\n", at)
        line = archive[at : stop if stop >= 0 else len(archive)]
        if line.startswith(b"filedesc://"):
            second = archive[stop + 1 : stop + 3]
            version = 2 if second == b"2 " else 1
        found = _header(line, version) if stop >= 0 else None
        if found is None:
            yield ArcRecord(at, "", "", "", "", archive[at:], False)
            return
        end = stop + 1 + int(found["length"])
        if not line.startswith(b"filedesc://"):
            yield ArcRecord(at, found["url"], found["ip"], found["date"], found["mime"], archive[stop + 1 : end], end <= len(archive))
        at = end


def gunzip(data: bytes) -> bytes:
    """All members of a gzip file."""
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        data = d.unused_data
    return b"".join(out)


def warc_date(date: str) -> str:
    """A 14-digit ARC date as a WARC timestamp; missing or unreadable parts take their least value."""
    d = "".join(c for c in date if c in "0123456789")[:14]
    parts, at = [], 0
    for width, least in ((4, "1970"), (2, "01"), (2, "01"), (2, "00"), (2, "00"), (2, "00")):
        p = d[at : at + width]
        parts.append(p if len(p) == width else least)
        at += width
    return "{}-{}-{}T{}:{}:{}Z".format(*parts)


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header with its blank line, and payload; no header where the block has none."""
    if block.startswith(b"HTTP/"):
        cut = block.find(b"\r\n\r\n")
        if cut >= 0:
            return block[: cut + 4], block[cut + 4 :]
    return b"", block


def http_field(header: bytes, name: bytes) -> str | None:
    for line in header.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name:
            return value.strip().decode()
    return None


def record_id(*parts: object) -> str:
    """A UUID of version 5 form from a record's place, address and time."""
    return str(uuid.UUID(bytes=hashlib.sha1("\n".join(map(str, parts)).encode()).digest()[:16], version=5))


_RECORDS = (
    "archive string, offset long, key long, record_id string, url string, ip string, date string, mime string, whole boolean, "
    "http binary, payload binary, payload_bytes long, payload_digest string"
)


def convert(archives: DataFrame) -> DataFrame:
    """Records of archives (``name`` string, ``content`` binary), in WARC's terms.

    ``key`` is the number in a captured ``X-Page-Id`` field, if any. Null contents have no records.
    """
    names = [x.split()[0] for x in _RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                rows = []
                for r in parse_arc(content.as_py() or b""):
                    http, payload = split_http(r.content)
                    key, date = http_field(http, b"x-page-id"), warc_date(r.date)
                    rid = record_id(name.as_py(), r.offset, r.url, date)
                    rows.append((name.as_py(), r.offset, key and int(key), rid, r.url, r.ip, date, r.mime, r.whole, http, payload, len(payload), hashlib.sha1(payload).hexdigest()))
                if rows:
                    types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return archives.select("name", "content").mapInArrow(run, _RECORDS)


def mark_revisits(records: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Adds ``refers_to`` and ``refers_id``: key and identifier of the record that holds an equal payload.

    Of records with equal payloads of ``least`` bytes or more, that with the largest key is the holder (records
    that share that key all are); a group without keys has no holder. Groups are summed before they are joined.
    """
    best = F.max(F.struct("key", "record_id", "url", "date"))
    shared = (
        records.where((F.col("payload_bytes") >= least) & F.col("whole"))
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.count("*").alias("n"), best.alias("best"))
        .where("n > 1 and best.key is not null")
        .select("payload_digest", "payload_bytes", "best")
    )
    out = records.join(materialize(shared, "sharedpayloads"), ["payload_digest", "payload_bytes"], "left")
    return out.withColumn("best", F.when(~F.col("key").eqNullSafe(F.col("best.key")) & F.col("best").isNotNull(), F.col("best")))


def _base32(hex_digest: Column) -> Column:
    """RFC 4648 letters of a SHA-1 digest given in hexadecimal: 32 groups of 5 bits."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    five = lambda i: F.conv(F.substring(hex_digest, i * 5 + 1, F.lit(5)), 16, 10).cast("long")
    four = lambda v: F.concat(*[F.substring(F.lit(letters), (F.shiftright(v, s).bitwiseAND(31) + 1), F.lit(1)) for s in (15, 10, 5, 0)])
    return F.concat(*[four(five(F.lit(i))) for i in range(8)])


def warc_records(records: DataFrame) -> DataFrame:
    """``record``: header and block of each record of :func:`mark_revisits` (binary, without the record's end).

    A revisit's block holds the captured header alone; a record that is not HTTP is a ``resource``.
    """
    revisit = F.col("best").isNotNull()
    kind = F.when(revisit, "revisit").when(F.length("http") > 0, "response").otherwise("resource")
    payload = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    block = F.concat("http", payload)
    optional = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise("")
    mime = F.when(F.length("http") > 0, "application/http; msgtype=response").otherwise(F.col("mime"))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: <urn:uuid:"), F.col("record_id"), F.lit(">\r\nWARC-Date: "), F.col("date"),
        F.lit("\r\nWARC-Target-URI: "), F.col("url"), F.lit("\r\nWARC-IP-Address: "), F.col("ip"),
        F.lit("\r\nWARC-Block-Digest: sha1:"), _base32(F.sha1(block)), F.lit("\r\nWARC-Payload-Digest: sha1:"), _base32(F.col("payload_digest")),
        F.lit("\r\n"),
        F.when(revisit, F.concat(
            F.lit(f"WARC-Profile: {_PROFILE}\r\nWARC-Refers-To: <urn:uuid:"), F.col("best.record_id"), F.lit(">\r\nWARC-Refers-To-Target-URI: "), F.col("best.url"),
            F.lit("\r\nWARC-Refers-To-Date: "), F.col("best.date"), F.lit("\r\n"),
        )).otherwise(""),
        optional("X-Refers-To-Key", F.col("best.key")), optional("X-Key", F.col("key")), F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string"),
        F.lit("\r\nContent-Type: "), mime, F.lit("\r\nContent-Length: "), F.length(block).cast("string"), F.lit(_END),
    )
    return records.select(F.concat(head.cast("binary"), block).alias("record"))


def write_warc(records: DataFrame, path: str, per_file: int = RECORDS_PER_FILE, compression: str = "none") -> None:
    """WARC files of at most ``per_file`` records in the folder ``path``."""
    text = records.select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", _END).option("maxRecordsPerFile", per_file).option("compression", compression).text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record, by declared lengths."""
    if data[:2] == b"\x1f\x8b":
        data = gunzip(data)
    at = 0
    while at < len(data):
        cut = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or cut < 0:
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:cut].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        n = int(fields["content-length"])
        yield fields, data[cut + 4 : cut + 4 + n]
        at = cut + 4 + n + len(_END)


def read_warc(df_files: DataFrame) -> DataFrame:
    """Records of files (``content`` binary): ``key, record_id, record_type, url, date, payload_bytes, payload_digest, refers_to``.

    Digest and length of a payload that the record holds are computed anew, and must be those declared.
    """
    schema = "key long, record_id string, record_type string, url string, date string, payload_bytes long, payload_digest string, refers_to long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = []
                for f, block in parse_warc(content.as_py()):
                    digest, n = base64.b32decode(f["warc-payload-digest"].partition(":")[2]).hex(), int(f["x-payload-length"])
                    if f["warc-type"] != "revisit":
                        payload = split_http(block)[1]
                        if (hashlib.sha1(payload).hexdigest(), len(payload)) != (digest, n):
                            raise ValueError(f"payload of {f['warc-record-id']} differs from its digest")
                    key, to = f.get("x-key"), f.get("x-refers-to-key")
                    rows.append((key and int(key), f["warc-record-id"][10:-1], f["warc-type"], f["warc-target-uri"], f["warc-date"], n, digest, to and int(to)))
                if rows:
                    types = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in schema.split(", ")]
                    )

    return df_files.select("content").mapInArrow(run, schema)


def pages_as_arc(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", most: int = 4 << 20) -> DataFrame:
    """Pages as ARC archives (``name``, ``content``) of about ``most`` bytes, of both versions in turn.

    Each page is an HTTP response with its key as ``X-Page-Id``. Null texts are empty; a null address is
    ``unknown:`` and characters that end a header line or field are percent-encoded in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial, version, size, parts = 0, 1, 0, []
        task = TaskContext.get().partitionId()  # the same in a task that runs again
        done: list[tuple[str, bytes]] = []
        for b in batches:
            for k, u, h in zip(b.column(0), b.column(1), b.column(2), strict=True):
                body, page = h.as_py() or b"", k.as_py()
                if not parts:
                    version, name = 1 + serial % 2, f"pages-{task}-{serial}.arc"
                    parts, size = [arc_version_block(version, name)], 0
                address = (u.as_py() or "unknown:").replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D")
                own = f"X-Page-Id: {page}\r\n" if page is not None else ""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(body)}\r\n\r\n".encode()
                parts.append(arc_record(version, address, head + body, offset=size, name=name))
                size += len(parts[-1])
                if size >= most:
                    done.append((name, b"".join(parts)))
                    serial, parts = serial + 1, []
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done]), pa.array([c for _, c in done], pa.binary())], ["name", "content"])
                done = []
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(parts)], pa.binary())], ["name", "content"])

    read = pages.select(F.col(key).cast("long"), F.col(url).cast("string"), F.col(html).cast("binary"))
    return read.mapInArrow(run, "name string, content binary")


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Converts pages from ARC to WARC, writes the archives, and reads them back (see :func:`read_warc`).

    Repeated rows give repeated records; an empty table writes and returns none; other columns are not read.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_warc(warc_records(mark_revisits(convert(pages_as_arc(pages)))), path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return read_warc(files)
