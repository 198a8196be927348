"""WARC archives, and the conversion of legacy ARC archives into them.

An ARC file begins with a version block (``filedesc:``) that names the fields of all
header lines that follow; a record is a header line, as many bytes as it declares, and a
line end.  The converter reads either version by those names and declared lengths, and
synthesises for each record what WARC asks for: an identifier, an ISO timestamp, a record
type, block and payload digests.  Records go to files of one gzip member each.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modeloom.llm.common import new_folder, table, written

#: Field names of the two ARC versions (fixed values of the format).
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:modeloom:page").int >> 64  # upper half of the identifiers that carry a number
ROWS = 10_000  # records that a reader hands out at a time
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# -- ARC


@dataclass
class ArcRecord:
    fields: dict[str, str]
    block: bytes
    offset: int


def arc_file_head(name: str, date: str, version: int = 1) -> bytes:
    lines = f"{version} 0 modeloom\n{ARC_FIELDS[version]}\n".encode()
    more = "" if version == 1 else " 200 - - 0 " + name
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{more} {len(lines)}\n".encode() + lines + b"\n"


def arc_record(fields: dict[str, str], block: bytes, version: int = 1) -> bytes:
    """A record; white space in a field would break the header line, so it is percent-encoded."""
    values = {k: re.sub(r"\s", lambda m: quote(m[0]), v) or "-" for k, v in fields.items()} | {"Archive-length": str(len(block))}
    return " ".join(values.get(n, "-") for n in ARC_FIELDS[version].split()).encode() + b"\n" + block + b"\n"


def arc_records(data) -> Iterator[ArcRecord]:
    """Records of an ARC stream (a binary file), the version block left out."""
    names: list[str] | None = None
    while True:
        offset = data.tell()
        line = data.readline()
        if not line:
            return
        if not line.strip():
            continue  # the line end after a record
        parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        if names is None:
            if not parts[0].startswith("filedesc:"):
                raise ValueError("an ARC file begins with a version block")
            head = data.read(int(parts[-1])).decode("utf-8", "replace").splitlines()
            version = int(head[0].split(" ")[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            names = (head[1] if len(head) > 1 and head[1].strip() else ARC_FIELDS[version]).split(" ")
            continue
        if len(parts) < len(names):
            raise ValueError(f"header line with {len(parts)} of {len(names)} fields at {offset}")
        # a URL may hold blanks in old archives: what is too much belongs to the first field
        extra = len(parts) - len(names)
        fields = dict(zip(names, [" ".join(parts[: extra + 1]), *parts[extra + 1 :]]))
        length = int(fields["Archive-length"])
        block = data.read(length)
        if len(block) < length:
            raise ValueError(f"record at {offset} is shorter than it declares")
        yield ArcRecord(fields, block, offset)


# -- WARC


def page_urn(number: int) -> str:
    """An identifier that carries a number, so that revisits can name a record in any file."""
    return f"<urn:uuid:{uuid.UUID(int=SPACE << 64 | number & (1 << 64) - 1)}>"


def page_of_urn(urn: str) -> int | None:
    try:
        value = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int
    except ValueError:
        return None
    low = value & (1 << 64) - 1
    return (low - (1 << 64) if low >> 63 else low) if value >> 64 == SPACE else None


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its blank line) and payload; a block that is no HTTP message is all payload."""
    if block.startswith(b"HTTP/"):
        at = block.find(b"\r\n\r\n")
        if at >= 0:
            return block[: at + 4], block[at + 4 :]
    return b"", block


def http_field(head: bytes, name: bytes) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("latin-1") if m else None


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def convert(record: ArcRecord, archive: str, identify: Callable[[bytes], str | None] = lambda head: None, refers_to: str | None = None) -> bytes:
    """The WARC record of an ARC record; with ``refers_to``, a revisit, which keeps the HTTP head only."""
    f = record.fields
    head, payload = split_http(record.block)
    urn = identify(head) or f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{record.offset}')}>"
    d = f["Archive-date"].ljust(14, "0")
    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    http = bool(head)
    kind = "revisit" if refers_to else "response" if http else "resource"
    block = head if refers_to else record.block
    headers = [("WARC-Type", kind), ("WARC-Record-ID", urn), ("WARC-Date", date), ("WARC-Target-URI", f["URL"])]
    if f.get("IP-address", "-") not in ("-", "0.0.0.0"):
        headers.append(("WARC-IP-Address", f["IP-address"]))
    headers += [("WARC-Payload-Digest", "sha1:" + digest(payload)), ("WARC-Block-Digest", "sha1:" + digest(block))]
    if refers_to:
        headers += [("WARC-Profile", REVISIT), ("WARC-Refers-To", refers_to)]
    return warc_record([*headers, ("Content-Type", "application/http; msgtype=response" if http else f.get("Content-type", "application/octet-stream"))], block)


def gzip_member(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(file, size: int = 1 << 20) -> Iterator[bytes]:
    """Each gzip member of a binary file, read bit by bit."""
    rest, z, parts = b"", None, []
    while True:
        data = rest or file.read(size)
        rest = b""
        if not data:
            if z is not None:
                raise ValueError("truncated gzip member")
            return
        if z is None:
            z, parts = zlib.decompressobj(31), []
        parts.append(z.decompress(data))
        if z.eof:
            rest, z = z.unused_data, None
            yield b"".join(parts)


def parse_warc(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; its digests are tested."""
    at = data.find(b"\r\n\r\n")
    lines = data[:at].decode("utf-8", "replace").split("\r\n")
    if at < 0 or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = data[at + 4 : at + 4 + int(headers["Content-Length"])]
    if headers.get("WARC-Block-Digest", "sha1:" + digest(block)) != "sha1:" + digest(block):
        raise ValueError(f"block digest of {headers['WARC-Record-ID']} differs")
    return headers, block


# -- tables


def page_as_arc(url: str | None, date: str, page: int | None, html: bytes) -> bytes:
    """A page as an ARC record, its number in a header field of the response."""
    name = b"" if page is None else b"X-Page-Id: %d\r\n" % page
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + name + b"Content-Length: %d\r\n\r\n" % len(html)
    return arc_record({"URL": url or "about:blank", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html"}, head + html)


def numbered(head: bytes) -> str | None:
    page = http_field(head, b"X-Page-Id")
    return None if page is None else page_urn(int(page))


def write_archives(pages: DataFrame, folder: str, date: str = "20240101000000", least: int = 0, most: int = 64 << 20) -> DataFrame:
    """Writes one WARC record per page, through ARC, and returns the manifest (path, records).

    ``pages``: page_id, url, html; a null html is empty, a null url ``about:blank``, other columns
    are ignored.  Of the pages with equal payloads of at least ``least`` bytes, the one with the
    largest page_id is a response and the others revisit it; repeated rows of that page_id are
    responses too, and so is a page without an id.  Which page that is, is an aggregate by digest
    that shuffles digests only; pages meet it in a join whose small side is built into a hash
    table, and a digest that a large part of all pages share is split by adaptive execution.
    Each attempt of a task writes files of its own (new ones beyond ``most`` bytes); the
    manifest, a written table, names those of successful attempts; an empty table gives an empty
    one.  A task holds 500 pages at a time, a very long page as a whole.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stem = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        files, at = fs.FileSystem.from_uri(stem)
        files.create_dir(at.rsplit("/", 1)[0], recursive=True)
        paths, counts, out, size = [], [], None, 0
        for batch in batches:
            names = ["page", "url", "html", "keep"]
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            for begin in range(0, len(rows), 500):
                arc = io.BytesIO()
                arc.write(arc_file_head(f"part-{begin}.arc", date))
                part = [dict(zip(names, r)) for r in rows[begin : begin + 500]]
                for r in part:
                    arc.write(page_as_arc(r["url"], date, r["page"], r["html"].encode()))
                arc.seek(0)
                for r, record in zip(part, arc_records(arc)):
                    if out is None:
                        paths.append(f"{stem}-{len(paths)}.warc.gz")
                        counts.append(0)
                        out, size = files.open_output_stream(fs.FileSystem.from_uri(paths[-1])[1], compression=None), 0
                    old = r["keep"] is not None and r["page"] is not None and r["page"] != r["keep"]
                    data = gzip_member(convert(record, stem, numbered, page_urn(r["keep"]) if old else None))
                    out.write(data)
                    size += len(data)
                    counts[-1] += 1
                    if size >= most:
                        out.close()
                        out = None
        if out is not None:
            out.close()
        if paths:
            yield pa.RecordBatch.from_pydict({"path": paths, "records": pa.array(counts, pa.int64())})

    rows = pages.select(F.col("page_id").cast("long").alias("page"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sum", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    large = F.octet_length("html") >= least
    kept = rows.where(large).groupBy("sum").agg(F.max("page").alias("keep"))
    met = rows.join(kept.hint("shuffle_hash"), "sum", "left").select("page", "url", "html", F.when(large, F.col("keep")).alias("keep"))
    return written(met.mapInArrow(work, "path string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A task for each archive, which reads one record at a time and hands out ``ROWS`` at a time; an
    empty manifest gives no row.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, at = fs.FileSystem.from_uri(path)
                rows: list[tuple] = []
                with files.open_input_stream(at, compression=None) as f:
                    for data in members(f):
                        headers, block = parse_warc(data)
                        head, payload = split_http(block)
                        kind, total = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "revisit":
                            size = int(http_field(head, b"Content-Length") or 0)
                        else:
                            size = len(payload)
                            if digest(payload) != total:
                                raise ValueError(f"payload digest of {headers['WARC-Record-ID']} differs")
                        refers = headers.get("WARC-Refers-To")
                        rows.append((page_of_urn(headers["WARC-Record-ID"]), size, total, kind, page_of_urn(refers) if refers else None))
                        if len(rows) >= ROWS:
                            yield batch_of(rows)
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
        rows.clear()
        return out

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(work, SCHEMA)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages of the table, written and read back; see :func:`write_archives` for odd rows."""
    return read_archives(write_archives(table(spark, sf_dir, "pages"), new_folder(spark, "warc")))
