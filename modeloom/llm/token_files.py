"""Token-id files: one concatenated id array, document boundaries in Elias-Fano form.

A file holds, in this order: the magic, the ids (2 bytes each if the vocabulary allows, else
4), the low bits, high bits and select directory of the boundaries, the same three of the
document ids (less their least), and a footer with the sizes.  ``n`` values up to ``u`` take about
``n * (2 + log2(u / n))`` bits; ``select`` finds value ``i`` from the directory (the place of
every 256th set bit) and a population count of few words.  Nulls come first in a file and are only counted.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modeloom.llm.common import new_folder, table, texts_of, written
from modeloom.llm.pieces import text_slices
from modeloom.llm.tokens import library_cache, vocabulary

MAGIC = b"MLOOMEF1"
FOOTER = struct.Struct("<8sIIIQQQQQqQ")  # magic, id width, low bits of boundaries and document ids, documents, nulls among them, ids, high bytes of both, least document id, bytes of both
FILE_IDS = 32_000_000  # ids after which a new file begins
FILE_BYTES = 64 << 20  # bytes of the table that a task is to have
UNKNOWN_SIZE = 1 << 60  # plans whose size Spark doesn't know say so by a size beyond this
EVERY = 256
BLOCK = 4_000_000  # ids that are read at a time


class EliasFano:
    """A non-decreasing sequence in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, directory: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.directory = n, low_bits, low, high, directory

    def stored(self) -> list[bytes]:
        return [self.low.tobytes(), self.high.tobytes(), self.directory.astype("<u8").tobytes()]

    @classmethod
    def read(cls, raw: bytes, n: int, bits: int, high: int) -> EliasFano:
        low = (bits * n + 7) // 8
        return cls(n, bits, np.frombuffer(raw[:low], np.uint8), np.frombuffer(raw[low : low + high], np.uint8), np.frombuffer(raw[low + high :], "<u8"))

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(place[-1]) + 8) // 8 if n else 0, np.uint8)
        np.bitwise_or.at(high, place >> 3, (1 << (place & 7)).astype(np.uint8))
        parts = np.zeros((n, bits), np.uint8)
        for k in range(bits):
            parts[:, k] = (values >> np.uint64(k)) & np.uint64(1)
        return cls(n, bits, np.packbits(parts.ravel(), bitorder="little"), high, place[::EVERY].astype(np.uint64))

    def select(self, i: int) -> int:
        """Value ``i``: the directory gives a set bit nearby, a count over the bytes that follow gives the bit."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.directory[i // EVERY])
        need = i % EVERY  # set bits after that one
        byte = at >> 3
        first = int(self.high[byte]) & (0xFF << (at & 7)) & 0xFF
        need += 1
        while (have := first.bit_count()) < need:
            need -= have
            byte += 1
            first = int(self.high[byte])
        for bit in range(8):
            if first >> bit & 1:
                need -= 1
                if not need:
                    break
        low = 0
        for k in range(self.low_bits):
            b = i * self.low_bits + k
            low |= (int(self.low[b >> 3]) >> (b & 7) & 1) << k
        return (8 * byte + bit - i) << self.low_bits | low

    def after(self, value: int, begin: int = 0) -> int:
        """Number of the first value from ``begin`` on that is greater than ``value`` (``n``: none), by selects that halve what is left."""
        end = self.n
        while begin < end:
            middle = (begin + end) // 2
            begin, end = (begin, middle) if self.select(middle) > value else (middle + 1, end)
        return begin

    def between(self, i: int, j: int) -> np.ndarray:
        """Values ``i`` to ``j - 1`` (unsigned), by one pass over the bits that hold them, which the directory finds."""
        if not 0 <= i < j <= self.n:
            return np.zeros(0, np.uint64)
        d, stop = i // EVERY, -(-j // EVERY)
        begin = int(self.directory[d]) >> 3
        end = (int(self.directory[stop]) >> 3) + 1 if stop < len(self.directory) else len(self.high)
        place = np.flatnonzero(np.unpackbits(self.high[begin:end], bitorder="little")) + 8 * begin
        skip = int(np.searchsorted(place, int(self.directory[d]))) + i - d * EVERY
        out = (place[skip : skip + j - i] - np.arange(i, j)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            first = i * self.low_bits
            bits = np.unpackbits(self.low[first >> 3 : (j * self.low_bits + 7) >> 3], bitorder="little")[first & 7 :][: (j - i) * self.low_bits].reshape(j - i, self.low_bits)
            for k in range(self.low_bits):
                out |= bits[:, k].astype(np.uint64) << np.uint64(k)
        return out

    def all(self) -> np.ndarray:
        """Every value, by one pass over the bits."""
        return self.between(0, self.n)


class TokenFileWriter:
    """Appends documents in ascending order of their ids, nulls first; holds boundaries and document ids of one file only."""

    def __init__(self, path: str, width: int):
        files, self.path = fs.FileSystem.from_uri(path)
        files.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out, self.width = files.open_output_stream(self.path), width
        self.ends: list[np.ndarray] = [np.zeros(1, np.int64)]
        self.docs: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.n = self.n_docs = self.nulls = 0
        self.out.write(MAGIC)

    def append(self, docs: np.ndarray, nulls: int, ids: np.ndarray, ends: np.ndarray) -> None:
        """Documents: ``nulls`` without an id, then ``docs``; document k ends before ``ends[k]`` in ``ids``."""
        self.out.write(ids.astype("<u2" if self.width == 2 else "<u4").tobytes())
        self.docs.append(docs.astype(np.int64))
        self.ends.append(ends + self.n)
        self.n += len(ids)
        self.n_docs += len(ends)
        self.nulls += nulls

    def close(self) -> None:
        docs = np.concatenate(self.docs)
        least = int(docs[0]) if len(docs) else 0
        both = [EliasFano.encode(np.concatenate(self.ends)), EliasFano.encode(docs.view(np.uint64) - np.array(least).astype(np.int64).view(np.uint64))]
        parts = [b"".join(e.stored()) for e in both]
        for x in parts:
            self.out.write(x)
        self.out.write(FOOTER.pack(MAGIC, self.width, both[0].low_bits, both[1].low_bits, self.n_docs, self.nulls, self.n, len(both[0].high), len(both[1].high), least, len(parts[0])))
        self.out.close()


class TokenFile:
    """Reads a file back; ids are read by range."""

    def __init__(self, path: str):
        files, at = fs.FileSystem.from_uri(path)
        self.file = files.open_input_file(at)
        size = self.file.size()
        magic, self.width, bits, doc_bits, self.n_docs, self.nulls, self.n_ids, high, doc_high, self.least, edge = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"not a token file: {path}")
        begin = len(MAGIC) + self.width * self.n_ids
        raw = self.file.read_at(size - FOOTER.size - begin, begin)
        self.bounds = EliasFano.read(raw[:edge], self.n_docs + 1, bits, high)
        self.ids_of_docs = EliasFano.read(raw[edge:], self.n_docs - self.nulls, doc_bits, doc_high)

    def ids(self, begin: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(self.width * (end - begin), len(MAGIC) + self.width * begin), "<u2" if self.width == 2 else "<u4").astype("<u4")

    def document(self, k: int) -> np.ndarray:
        return self.ids(self.bounds.select(k), self.bounds.select(k + 1))

    def doc_ids(self, k: int, m: int) -> pa.Array:
        """Ids of documents ``k`` to ``m - 1``."""
        none = max(0, min(m, self.nulls) - k)
        known = self.ids_of_docs.between(max(k - self.nulls, 0), max(m - self.nulls, 0)) + np.array(self.least).astype(np.int64).view(np.uint64)
        return pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(known.view(np.int64))])


def write_token_files(docs: DataFrame, vocab: str, folder: str, end_id: int = 0, width: int = 2) -> DataFrame:
    """Writes the documents in ascending doc_id order, in files of about ``FILE_IDS`` ids; returns the manifest.

    ``docs``: doc_id, text; a null text is empty, null doc_ids come first, equal ids follow
    each other by a hash of their text, other columns are ignored; an empty table gives an empty
    manifest.  The table is sorted in ranges, as many as its size asks for; rows with equal ids, or none,
    are spread over several ranges by that hash and their place in the input.  A very long
    text costs memory for its ids and one part of it.
    Each attempt of a task writes files of its own and only successful ones are in the manifest
    (part, file, path, n_docs, n_ids), a written table, so lost tasks leave nothing that is read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, out, number = library_cache(vocab), None, 0
        part = TaskContext.get().partitionId()
        stem = f"{folder}/{part:06d}-{uuid.uuid4().hex}"

        def close() -> pa.RecordBatch:
            nonlocal out, number
            out.close()
            row = {"part": pa.array([part], pa.int32()), "file": pa.array([number], pa.int32()), "path": [f"{stem}-{number}.ids"], "n_docs": [out.n_docs], "n_ids": [out.n]}
            out, number = None, number + 1
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            texts, docs = batch.column(1).to_pylist(), batch.column(0)
            for a, b in text_slices(texts):
                ids, at = cache.encode_texts(texts[a:b])
                out = out or TokenFileWriter(f"{stem}-{number}.ids", width)
                ends = at[1:] + np.arange(1, b - a + 1)
                full = np.full(len(ids) + b - a, end_id, np.uint32)
                body = np.ones(len(full), bool)
                body[ends - 1] = False
                full[body] = ids
                own = docs.slice(a, b - a)
                out.append(own.drop_null().to_numpy(), own.null_count, full, ends)
                if out.n >= FILE_IDS:
                    yield close()
        if out:
            yield close()

    rows = texts_of(docs, "doc_id").withColumns({"h": F.xxhash64("text"), "at": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(ranges(docs), "doc_id", "h", "at").sortWithinPartitions("doc_id", "h", "at")
    return written(rows.select("doc_id", "text").mapInArrow(work, "part int, file int, path string, n_docs long, n_ids long"), "token-manifest")


def ranges(docs: DataFrame) -> int:
    """Tasks for a sort of the table: what its files' size asks for, or the session's number of shuffle partitions if that is more or the size is not known."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // FILE_BYTES if size < UNKNOWN_SIZE else 0)


def file_rows(path: str, base: int) -> Iterator[pa.RecordBatch]:
    """The rows of :func:`read_token_files` for one file, whose first id is number ``base``; a block of documents at a time."""
    f = TokenFile(path)
    k = 0
    while k < f.n_docs:
        m = max(k + 1, f.bounds.after(f.bounds.select(k) + BLOCK, k) - 1)
        bounds = f.bounds.between(k, m + 1).astype(np.int64)
        ids = memoryview(f.ids(int(bounds[0]), int(bounds[-1])).tobytes())
        own = (bounds - bounds[0]) * 4
        crc = [zlib.crc32(ids[a:b]) for a, b in zip(own[:-1].tolist(), own[1:].tolist())]
        yield pa.RecordBatch.from_arrays([f.doc_ids(k, m), pa.array(bounds[:-1] + base), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
        k = m


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The driver sums one number per file; offsets within a file come from its encoded boundaries:
    :meth:`EliasFano.select` finds the edges of a block of documents, and one pass over the
    block's bits gives those between.  An empty manifest gives no row.
    """
    files = sorted(manifest.collect(), key=lambda r: (r["part"], r["file"]))
    start, rows = 0, []
    for r in files:
        rows.append((r["path"], start))
        start += r["n_ids"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from file_rows(path, base)

    df = spark.createDataFrame(rows, "path string, base long")
    return df.repartition(max(1, len(rows))).mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the table as the files give them; see :func:`write_token_files` for odd rows."""
    manifest = write_token_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), new_folder(spark, "token-files"))
    return read_token_files(spark, manifest)
