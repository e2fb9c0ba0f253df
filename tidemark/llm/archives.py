"""Web archives: pages to ARC files, ARC files to WARC files, and both back to rows.

The converter reads legacy ARC files as they are: the version block names the
fields of the header lines (five in version 1, ten in version 2), and declared
lengths delimit the records. From those it synthesises what WARC asks for:
identifiers from file and offset, timestamps from 14-digit dates, types from
protocol and payload, and SHA-1 digests. Of records with equal payloads one stays
a response; the others become revisits that name it and keep no payload.

Spark's text writer lays the bytes down, with the formats' own record ends as its
line ends, so any file system that Spark writes will do. A file ends at
``ARCHIVE_BYTES``, and a task holds one file at a time. Payloads are shuffled only
where more than ``SMALL_WINNERS`` texts have copies; else they stay in their task.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.skew import lookup_join
from tidemark.session import ensure_checkpoint_dir

from .common import small_side, stored

#: Bytes of records after which a new archive begins; a longer record is an archive of its own.
ARCHIVE_BYTES = 64 << 20
#: Bytes of records that travel at once between Spark and Python.
BATCH_BYTES = 4 << 20
#: Payloads shorter than this are always stored whole.
REVISIT_BYTES = 1000
#: Payloads with copies up to which their responses are broadcast.
SMALL_WINNERS = 100_000

# Fixed values of the two formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARC_END, WARC_END = "\n", "\r\n\r\n"


class Record(NamedTuple):
    """One record of an ARC file. ``head`` is the protocol's own header, with its blank line."""

    offset: int
    uri: str
    ip: str
    date: str
    mime: str
    head: bytes
    payload: bytes
    truncated: bool


def _unzipped(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def split_protocol(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header and body; other protocols have no header."""
    if block[:5] == b"HTTP/":
        for end in (b"\r\n\r\n", b"\n\n"):
            at = block.find(end)
            if at >= 0:
                return block[: at + len(end)], block[at + len(end) :]
        return block, b""
    return b"", block


def parse_arc(content: bytes) -> Iterator[Record]:
    """The records after the version block, by declared lengths.

    Blank lines between records are passed over. A URL may hold spaces: the other
    fields are counted from the line's end. A header line with a wrong number of
    fields or without a length ends the file, as nothing tells where the next
    record begins; a record longer than what is left is marked truncated.
    """
    data = _unzipped(content)
    names: list[str] | None = None
    at = 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            return
        line = data[at:end].rstrip(b"\r").decode("utf-8", "replace")
        if names is None:  # no version block seen: the number of fields tells the version
            parts = line.split(" ")
            fields = ARC_FIELDS[2 if len(parts) >= 10 and parts[-6].isdigit() or len(parts) == 10 else 1].split(" ")
        else:
            fields = names
        values = line.rsplit(" ", len(fields) - 1)
        if len(values) != len(fields) or not values[-1].isdigit():
            return
        row = dict(zip(fields, values))
        start, length = end + 1, int(values[-1])
        block = data[start : start + length]
        uri = row.get("URL", "")
        if uri.startswith("filedesc:"):
            lines = block.decode("utf-8", "replace").splitlines()
            if len(lines) > 1 and "Archive-length" in lines[1]:
                names = lines[1].split(" ")
        else:
            head, payload = split_protocol(block)
            yield Record(at, uri, row.get("IP-address", "-"), row.get("Archive-date", ""), row.get("Content-type", "-"), head, payload, len(block) < length)
        at = start + length


def header_value(head: bytes, name: str) -> str | None:
    """The first value of a header field, or None."""
    for line in head.split(b"\n")[1:]:
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == name.lower().encode():
            return value.strip().decode("utf-8", "replace")
    return None


def warc_date(date: str) -> str:
    """ISO 8601 for a 14-digit date; missing digits are the earliest, an unusable date the epoch."""
    digits = (date + "00000101000000"[len(date) :])[:14] if 4 <= len(date) <= 14 and date.isdigit() else "19700101000000"
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def record_id(path: str, offset: int) -> str:
    """An identifier that depends on the archive's name and the record's place in it."""
    name = path.rstrip("/").rsplit("/", 2)[-2:]
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(name) + f'#{offset}')}"


def sha1_label(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def hex_of_label(label: str) -> str:
    """The hexadecimal digest of a ``sha1:`` label in base 32 or 16."""
    value = label.partition(":")[2]
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


def warc_record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [WARC_VERSION, *[f"{name}: {value}" for name, value in fields if value is not None], f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    data = _unzipped(content)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        start, length = end + 4, int(fields.get("content-length", "0"))
        yield fields, data[start : start + length]
        at = start + length


# ---- writing


def _packed(build: Callable, head: Callable[[str, int], bytes], name: str, limit: int):
    """Rows (archive, value) of records: ``head`` opens each archive, which ends before it grows beyond ``limit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        archive, offset, out, held = -1, limit + 1, [], 0
        for rows in batches:
            for row in build(rows):
                size = row if isinstance(row, int) else len(row(0, "", part) if callable(row) else row)
                if offset + size > limit:
                    archive += 1
                    out.append((archive, head(f"{name}-{part:05d}-{archive:05d}", part + archive)))
                    offset = len(out[-1][1]) + 1
                value = row(offset, f"{name}-{part:05d}-{archive:05d}", part + archive) if callable(row) else row
                out.append((archive, value))
                offset += len(value) + 1
                held += len(value)
                if held >= BATCH_BYTES:
                    yield _pair(out)
                    out, held = [], 0
        if out:
            yield _pair(out)

    return run


def _pair(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["archive", "value"])


def _write(records: DataFrame, folder: str, end: str) -> None:
    """The records of each archive in order, gzip-compressed, each followed by ``end``."""
    lines = records.select("archive", F.col("value").cast("string").alias("value"))
    lines.write.partitionBy("archive").option("compression", "gzip").option("lineSep", end).text(folder)


def _arc_line(version: int, uri: str, ip: str, date: str, mime: str, code: str, offset: int, name: str, length: int) -> str:
    first = f"{uri} {ip} {date} {mime}"
    return f"{first} {length}\n" if version == 1 else f"{first} {code} - - {offset} {name} {length}\n"


def _arc_head(name: str, number: int) -> bytes:
    version = 1 + number % 2
    block = f"{version} 0 tidemark\n{ARC_FIELDS[version]}\n"
    return (_arc_line(version, f"filedesc://{name}.arc", "0.0.0.0", "20000101000000", "text/plain", "200", 0, f"{name}.arc", len(block)) + block).encode()


def _arc_uri(url: str | None, page: int | None) -> str:
    """The URL without white space or control characters; a missing one is named after its page."""
    text = url or f"urn:page:{'-' if page is None else page}"
    return "".join(c if c > "\x20" and c != "\x7f" and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def _arc_rows(rows: pa.RecordBatch):
    for page, url, date, html in zip(*[rows.column(c) for c in ("page_id", "url", "date", "html")]):
        page, url, date, body = page.as_py(), url.as_py(), date.as_py(), html.as_buffer() if html.is_valid else b""
        body = bytes(body or b"")
        known = "" if page is None else f"X-Page-Id: {page}\r\n"
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(body)}\r\n{known}\r\n".encode() + body

        def record(offset, name, number, uri=_arc_uri(url, page), date=date, block=block):
            return _arc_line(1 + number % 2, uri, "0.0.0.0", date, "text/html", "200", offset, f"{name}.arc", len(block)).encode() + block

        yield record


def write_arc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """ARC files of the pages, of version 1 and 2 in turn.

    Each page is an HTTP response with its id as a header field and its html in
    UTF-8 as the body. Pages tell no dates, so a page's is the year 2000 plus its
    id in seconds.
    """
    page = F.col(f"`{id_col}`").cast("bigint")
    moment = F.timestamp_seconds(F.lit(946_684_800) + F.pmod(F.coalesce(page, F.lit(0)), F.lit(100_000_000)))
    slim = pages.select(page.alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.date_format(moment, "yyyyMMddHHmmss").alias("date"), F.col(f"`{html_col}`").cast("string").alias("html"))
    _write(slim.mapInArrow(_packed(_arc_rows, _arc_head, "pages", archive_bytes), "archive int, value binary"), folder, ARC_END)


# ---- reading


def _files(spark: SparkSession, folder: str) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz")
    return reader.load(folder).select("path", "content")


_ARC_TYPES = [("record_id", pa.string()), ("uri", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("page_id", pa.int64()), ("bytes", pa.int64()), ("digest", pa.string()), ("truncated", pa.bool_()), ("head", pa.binary()), ("payload", pa.binary())]
_ARC_SCHEMA = "record_id string, uri string, ip string, date string, mime string, page_id long, bytes long, digest string, truncated boolean, head binary, payload binary"
_WARC_TYPES = [("record_id", pa.string()), ("record_type", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("bytes", pa.int64()), ("digest", pa.string()), ("refers", pa.string()), ("payload", pa.binary())]
_WARC_SCHEMA = "record_id string, record_type string, uri string, date string, page_id long, bytes long, digest string, refers string, payload binary"


def _number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def _arc_values(path: str, content: bytes, whole: bool) -> Iterator[tuple]:
    for r in parse_arc(content):
        values = (record_id(path, r.offset), r.uri, r.ip, warc_date(r.date), r.mime, _number(header_value(r.head, "X-Page-Id")), len(r.payload), hashlib.sha1(r.payload).hexdigest(), r.truncated)
        yield *values, r.head if whole else None, r.payload if whole else None


def _warc_values(path: str, content: bytes, whole: bool) -> Iterator[tuple]:
    for fields, block in parse_warc(content):
        kind = fields.get("warc-type")
        if kind == "warcinfo":
            continue
        uri = fields.get("warc-target-uri", "")
        head, payload = split_protocol(block)
        named = fields.get("warc-payload-digest")
        if kind == "revisit":
            size, digest = _number(fields.get("payload-length")), hex_of_label(named) if named else None
        else:  # the stored bytes tell, not the label
            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        refers = fields.get("warc-refers-to", "").strip("<>") or None
        yield fields.get("warc-record-id", "").strip("<>"), kind, uri, fields.get("warc-date"), _number(header_value(head, "X-Page-Id")), size, digest, refers, payload if whole and kind != "revisit" else None


def _rows(values: Callable, types: list[tuple[str, pa.DataType]], whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for path, content in zip(files.column("path"), files.column("content")):
                out, held = [], 0
                for row in values(path.as_py(), bytes(content.as_buffer()), whole):
                    out.append(row)
                    held += sum(len(x) for x in row if isinstance(x, (bytes, str)))
                    if held >= BATCH_BYTES:
                        yield _batch(out, types)
                        out, held = [], 0
                if out:
                    yield _batch(out, types)

    return run


def _batch(rows: list[tuple], types: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, (_, kind) in zip(zip(*rows), types)], names=[name for name, _ in types])


def read_arc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """One row per ARC record; without ``payloads`` head and payload are null."""
    return _files(spark, folder).mapInArrow(_rows(_arc_values, _ARC_TYPES, payloads), _ARC_SCHEMA)


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """One row per WARC record but the file descriptions; revisits have no payload, and the size and digest of the full one."""
    return _files(spark, folder).mapInArrow(_rows(_warc_values, _WARC_TYPES, payloads), _WARC_SCHEMA)


# ---- converting


def _warc_head(name: str, number: int) -> bytes:
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{record_id(name, 0)}>"), ("WARC-Date", "2000-01-01T00:00:00Z"), ("WARC-Filename", f"{name}.warc"), ("Content-Type", "application/warc-fields")]
    return warc_record(fields, b"software: tidemark\r\nformat: WARC File Format 1.1\r\n")


def _warc_rows(rows: pa.RecordBatch):
    names = [n for n in rows.schema.names if n not in ("head", "payload")]
    heads, payloads = rows.column("head"), rows.column("payload")
    for i, r in enumerate(rows.select(names).to_pylist()):
        head, payload = heads[i].as_py(), payloads[i].as_py()
        revisit = r["response_id"] is not None and r["response_id"] != r["record_id"]
        kind = "revisit" if revisit else "response" if head else "resource"
        fields = [
            ("WARC-Type", kind), ("WARC-Record-ID", f"<{r['record_id']}>"), ("WARC-Target-URI", r["uri"]), ("WARC-Date", r["date"]),
            ("WARC-IP-Address", r["ip"] if r["ip"] not in ("-", "0.0.0.0", "") else None), ("WARC-Payload-Digest", sha1_label(r["digest"])), ("Payload-Length", str(r["bytes"])),
            ("WARC-Truncated", "unspecified" if r["truncated"] else None), ("WARC-Profile", REVISIT_PROFILE if revisit else None),
            ("WARC-Refers-To", f"<{r['response_id']}>" if revisit else None), ("WARC-Refers-To-Target-URI", r["response_uri"] if revisit else None), ("WARC-Refers-To-Date", r["response_date"] if revisit else None),
            ("Content-Type", "application/http; msgtype=response" if head or revisit else r["mime"]),
        ]
        yield warc_record(fields, head if revisit else head + payload)


def responses(index: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """For each payload of ``least`` bytes or more that occurs twice: digest, copies, and the record that stays a response.

    It is that with the largest page id, then the greatest record id; records without a page id come last.
    """
    best = F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "record_id", "uri", "date")).alias("best")
    groups = index.where(F.col("bytes") >= least).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), best).where("copies > 1")
    return groups.select("digest", "copies", F.col("best.record_id").alias("response_id"), F.col("best.uri").alias("response_uri"), F.col("best.date").alias("response_date"))


def convert(spark: SparkSession, arc_folder: str, warc_folder: str, least: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """WARC files with a record for each record of the ARC files."""
    found = stored(responses(read_arc(spark, arc_folder, payloads=False), least))
    records = read_arc(spark, arc_folder).withColumn("key", F.when(F.col("bytes") >= least, F.col("digest")))
    winners = found.withColumnRenamed("digest", "key")
    if winners.limit(SMALL_WINNERS + 1).count() <= SMALL_WINNERS:
        met = records.join(small_side(winners, SMALL_WINNERS), "key", "left")
    else:
        met = lookup_join(records, winners, ["key"], weight="copies")
    met = met.select(*[name for name, _ in _ARC_TYPES], "response_id", "response_uri", "response_date")
    _write(met.mapInArrow(_packed(_warc_rows, _warc_head, "pages", archive_bytes), "archive int, value binary"), warc_folder, WARC_END)


def discard(spark: SparkSession, folder: str) -> None:
    """Remove a folder of intermediate files, wherever Spark keeps it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def archive_pages(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archive the pages and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The WARC files lie in ``folder``, by default one of their own beside the
    session's checkpoints. A null html is an empty payload, and a null or empty
    URL is named after the page. Pages that repeat are records each; of equal
    ones with the same id one is the response and the others refer to that id.
    A null page_id stays null and yields to any other. Extra columns are
    ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    if folder is None:
        ensure_checkpoint_dir(spark)
        folder = f"{spark.sparkContext.getCheckpointDir()}/archives-{uuid.uuid4()}"
    write_arc(pages, f"{folder}/arc", id_col, url_col, html_col, archive_bytes)
    convert(spark, f"{folder}/arc", f"{folder}/warc", archive_bytes=archive_bytes)
    discard(spark, f"{folder}/arc")
    slim = stored(read_warc(spark, f"{folder}/warc", payloads=False).drop("payload", "uri", "date"))
    named = slim.where("record_type = 'response'").select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"))
    named = named.join(slim.where("refers IS NOT NULL").groupBy("refers").agg(F.count(F.lit(1)).alias("copies")), "refers")
    met = lookup_join(slim, stored(named), ["refers"], weight="copies")
    return met.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
