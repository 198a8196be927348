"""PNG in binary columns: chunks with checksums, unfiltering with numpy, cosine-transform hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from modeloom.llm.common import map_batches, table, texts_of

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}  # samples a pixel by colour type
ROW = 192  # bytes a row: 64 pixels of three samples
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def png_write(samples: np.ndarray, level: int = 1, most: int = 1 << 20) -> bytes:
    """A PNG of 8-bit samples, shape (height, width, 1 to 4); the first row by filter Sub, the others by Up."""
    height, width, n = samples.shape
    rows = np.zeros((height, 1 + width * n), np.uint8)
    rows[:, 1:] = samples.reshape(height, -1)
    rows[1:, 1:] -= rows[:-1, 1:].copy()
    rows[:1, 1 + n :] -= rows[:1, 1:-n].copy()
    rows[:1, 0], rows[1:, 0] = 1, 2
    data = zlib.compress(rows.tobytes(), level)
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[n]
    body = b"".join(chunk(b"IDAT", data[i : i + most]) for i in range(0, len(data), most))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + body + chunk(b"IEND", b"")


def png_chunks(data: bytes):
    """(kind, content) of each chunk; raises ValueError on a bad checksum, length or signature."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("truncated chunk")
        (n,) = struct.unpack_from(">I", data, at)
        if at + 12 + n > len(data):
            raise ValueError("truncated chunk")
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(data[at + 4 : at + 8 + n]) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError(f"bad checksum in {kind!r}")
        yield kind, body
        at += 12 + n
        if kind == b"IEND":
            return
    raise ValueError("no end chunk")


def unfilter(rows: np.ndarray, step: int) -> np.ndarray:
    """Undoes row filters. rows: (height, 1 + bytes a row); step: bytes a pixel."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if not kinds.any():
        return out
    if kinds.max() > 4:
        raise ValueError("unknown row filter")
    if kinds.max() > 2:
        return along_diagonals(kinds, out, step)
    y = 0
    while y < len(out):
        if kinds[y] == 2:  # a run of Up rows is a running sum down the columns
            stop = y
            while stop < len(out) and kinds[stop] == 2:
                stop += 1
            if y:
                out[y] += out[y - 1]
            out[y:stop] = np.cumsum(out[y:stop], axis=0, dtype=np.uint8)
            y = stop
            continue
        if kinds[y] == 1:  # a running sum along the row for each sample
            out[y] = np.cumsum(out[y].reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        y += 1
    return out


def along_diagonals(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """Undoes filters of any kind, a diagonal of pixels at a time: a pixel needs those to the left, above and at the corner, which lie on the two diagonals before."""
    height, width = len(rows), rows.shape[1] // step
    skewed = np.zeros((width + height + 1, height + 1, step), np.int16)  # by diagonal (two empty ones first) and row (an empty one first)
    y, x = np.indices((height, width))
    skewed[x + y + 2, y + 1] = rows.reshape(height, width, step)
    kind = np.zeros((height + 1, 1), np.int16)
    kind[1:, 0] = kinds
    for d in range(2, width + height + 1):
        begin, end = max(1, d - width), min(height, d - 1) + 1  # rows that have a pixel here
        own, k = skewed[d, begin:end], kind[begin:end]
        left, up, corner = skewed[d - 1, begin:end], skewed[d - 1, begin - 1 : end - 1], skewed[d - 2, begin - 1 : end - 1]
        p = left + up - corner
        da, db, dc = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
        paeth = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))
        own += np.where(k == 1, left, np.where(k == 2, up, np.where(k == 3, (left + up) >> 1, np.where(k == 4, paeth, 0))))
        own &= 255
    return skewed[x + y + 2, y + 1].astype(np.uint8).reshape(height, width * step)


def png_read(data: bytes) -> np.ndarray:
    """Samples of an 8-bit PNG without interlacing, shape (height, width, samples a pixel)."""
    head, body, over = None, [], False
    for kind, content in png_chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", content)
        elif kind == b"IDAT":
            body.append(content)
        over |= kind == b"IEND"
    if head is None or not over:
        raise ValueError("no header")
    width, height, depth, colour, _, _, laced = head
    if depth != 8 or colour not in CHANNELS or laced:
        raise ValueError("only 8-bit images without palette or interlacing are read")
    n = CHANNELS[colour]
    raw = zlib.decompress(b"".join(body))
    if len(raw) != height * (1 + width * n):
        raise ValueError("wrong amount of data")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, 1 + width * n), n).reshape(height, width, n)


def _cosines(n: int, low: int) -> np.ndarray:
    k = np.arange(low)[:, None]
    return np.cos(np.pi * (2 * np.arange(n)[None, :] + 1) * k / (2 * n))


COSINES = _cosines(32, 8)


def cosine_hash(samples: np.ndarray) -> str:
    """16 hex digits: signs of the low frequencies of a 32 x 32 reduction, against their median."""
    grey = samples.sum(axis=2, dtype=np.float64)
    for axis in (0, 1):
        n = grey.shape[axis]
        if n >= 32:
            edge = np.arange(33) * n // 32
            grey = np.add.reduceat(grey, edge[:-1], axis=axis) / np.diff(edge).reshape((-1, 1) if axis == 0 else (1, -1))
        else:
            grey = np.take(grey, np.arange(32) * n // 32, axis=axis)
    low = np.round(COSINES @ grey @ COSINES.T, 3).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text as a PNG 64 pixels wide.

    A null text is empty; bytes 32 fill up the last row, and one row is the least.  Repeated
    rows and null ids stay; other columns are ignored; an empty table gives no row.  A very
    long text costs memory for a few copies of its bytes.
    """

    def work(batch: pa.RecordBatch) -> dict:
        sizes, media = [], []
        for data in batch.column(1).cast(pa.binary()):
            text = data.as_py()
            sizes.append(len(text))
            text = text.ljust(max(ROW, -(-len(text) // ROW) * ROW), b" ")
            media.append(png_write(np.frombuffer(text, np.uint8).reshape(-1, 64, 3)))
        return {"doc_id": batch.column(0), "n_bytes": pa.array(sizes, pa.int64()), "media": pa.array(media, pa.large_binary()).cast(pa.binary())}

    return map_batches(texts_of(docs, "doc_id"), work, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """What the stored bytes give when they are read back; checksums are tested on the way."""

    def work(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {x.split()[0]: [] for x in SCHEMA.split(", ")[2:]}
        for data in batch.column(2).to_pylist():
            samples = png_read(data)
            payload = samples.tobytes()
            for k, v in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(samples))):
                out[k].append(v)
        return {"doc_id": batch.column(0), "n_bytes": batch.column(1)} | out

    return map_batches(media, work, SCHEMA)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of the table as images, and what the stored bytes say; see :func:`store` for odd rows."""
    return features(store(table(spark, sf_dir, "documents")))
