"""Packing of token sequences into windows by best-fit decreasing.

A document's ids (end id included) are first cut into full windows, which need no search;
what is left over, shorter than a window, is put by descending length into the open window
with the least remaining capacity that still holds it.  A segment tree over the remaining
capacities finds that window in O(log capacity).

Texts are encoded where they are read; only their pieces (numbers, no ids) are written to the
shared folder.  Full windows are done; pieces left over are dealt evenly to as many tasks as
hold ``run`` pieces each, however many partitions the texts came from, and each task packs its
own, so only the few windows still open at the end of a task carry padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modeloom.llm.common import release, table, texts_of, written
from modeloom.llm.pieces import text_slices
from modeloom.llm.tokens import library_cache, vocabulary

ROWS = 1000  # rows of a batch whose texts are Python strings at a time
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Open windows by remaining capacity; finds the least capacity that is at least a given one."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, remaining: int, window: int) -> None:
        self.windows[remaining].append(window)
        i = remaining + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Remaining capacity and number of the tightest window, which leaves the tree."""
        count, i = self.count, length + self.size
        while not count[i]:
            while i & 1:  # a right child: climb until there is a right neighbour
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if count[2 * i] else 2 * i + 1
        found = i - self.size
        while i:
            count[i] -= 1
            i >>= 1
        return found, self.windows[found].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of each piece (1 <= length <= capacity), and the number of windows."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, used = CapacityTree(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.take(n)
        if found is None:
            found = (capacity, used)
            used += 1
        remaining, window[i] = found
        offset[i] = capacity - remaining
        if remaining > n:
            tree.add(remaining - n, found[1])
    return window, offset, used


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long"


def batch(schema: str, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in schema.split(", ")])


def cut_pieces(docs: DataFrame, vocab: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of the documents; a full one has a sequence of its own, others have none yet."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, number, end = library_cache(vocab), TaskContext.get().partitionId() << 32, np.array([end_id], np.uint32)
        release()
        for rows in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            texts, docs = rows.column(1).to_pylist(), rows.column(0).to_pylist()
            for a, b in text_slices(texts):
                ids, at = cache.encode_texts(texts[a:b])
                out: list[tuple] = []
                for k, doc in enumerate(docs[a:b]):
                    own = np.concatenate([ids[at[k] : at[k + 1]], end])
                    for s in range(0, len(own), capacity):
                        piece = own[s : s + capacity]
                        full = len(piece) == capacity
                        out.append((doc, s, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), len(own), number if full else None))
                        number += full
                if out:
                    yield batch(PIECE, list(zip(*out)))

    return texts_of(docs, "doc_id").mapInArrow(work, PIECE)


def pack(docs: DataFrame, vocab: str, end_id: int = 1, capacity: int = 2048, run: int = 262_144) -> DataFrame:
    """Packs documents into sequences of at most ``capacity`` tokens; one row per piece.

    ``docs``: doc_id, text; a null text is empty, a null doc_id stays null, repeated rows are
    packed one by one, other columns are ignored, an empty table gives no row.  A document is
    its ids followed by ``end_id``, so even an empty text has one token.  Pieces of a document
    are cut at multiples of ``capacity``; offsets in a sequence have no gaps.  ``sequence_id``
    is unique over the table: for a full piece, the task that encoded it and a number within it; for
    others the same of the task that packed them, plus 2 to the power 62.  A very long
    text costs memory for its ids and one part of it.
    """
    pieces = written(cut_pieces(docs, vocab, end_id, capacity), "pieces")
    left = pieces.where(F.col("sequence_id").isNull())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        base = 1 << 62 | TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            nonlocal base
            t = pa.Table.from_batches(held)
            held.clear()
            window, offset, n = best_fit_decreasing(t["length"].to_numpy(), capacity)
            out = batch(SCHEMA, [*[t.column(i).combine_chunks() for i in range(5)], window + base, offset])
            base += n
            return out

        for rows in batches:
            held.append(rows)
            if sum(r.num_rows for r in held) >= 2 * run:
                yield flush()
        if held:
            yield flush()

    packed = left.repartition(max(1, -(-left.count() // run))).mapInArrow(work, SCHEMA)
    return pieces.where(F.col("sequence_id").isNotNull()).withColumn("offset", F.lit(0).cast("long")).unionByName(packed)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents of the table; see :func:`pack` for odd rows."""
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
