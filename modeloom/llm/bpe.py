"""Byte-level BPE by tree reduction.

Encodings form a monoid: the value of a byte string is its token sequence, and two
neighbouring values are joined by re-encoding a window around their seam.  The window
grows until the tokens outside it provably stay: a token sequence is the encoding of its
bytes exactly if each pair of neighbours is the encoding of the pair's bytes, so it is
enough that the window's outermost tokens stand next to their outer neighbours unchanged.
Pieces of the pattern are walls that no token crosses; there, a join is concatenation.

A text is halved down to leaves of at most ``TEXT_LEAF`` characters, wherever the halves fall,
and a piece, or what a cut leaves of it, down to leaves of a few bytes.  What is next
to a wall is final, so of the joins of a text only those at seams inside pieces change tokens;
they are made in the order of the tree, and the rest is concatenation.  Decoding
concatenates up the tree of halves.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from modeloom.llm.common import map_batches, table, texts_of
from modeloom.llm.pieces import CACHE_BYTES, PieceCache, code_points, piece_starts, ragged, spelled, text_slices
from modeloom.llm.tokens import vocabulary

TEXT_LEAF = 512
#: Bytes after which a worker forgets the joins it has made.
JOINED_BYTES = 32 << 20
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class TreeBPE:
    """Encoder and decoder over ranks (bytes of a token -> id)."""

    def __init__(self, ranks: dict[bytes, int], leaf: int = 4):
        self.ranks, self.leaf = ranks, leaf
        self.token = {i: b for b, i in ranks.items()}
        self.joins = 0
        self._pairs: dict[tuple[int, int], list[int]] = {}
        self._halves: dict[bytes, list[int]] = {}

    @classmethod
    def from_file(cls, path: str, leaf: int = 4) -> TreeBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, leaf)

    def merge(self, data: bytes) -> list[int]:
        """The encoding by merges alone: the pair of least rank first, the leftmost of equals."""
        ranks = self.ranks
        if len(data) > 64:
            return self._merge_long(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap of pairs, O(n log n)."""
        ranks, n = self.ranks, len(data)
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := ranks.get(data[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue  # one of the pair has changed since
            alive[j] = False
            end[i], after[i] = end[j], after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = after[i]
        return out

    def pair(self, a: int, b: int) -> list[int]:
        """The encoding of the bytes of two tokens, kept (the bound changes speed only)."""
        found = self._pairs.get((a, b))
        if found is None:
            if len(self._pairs) > 200_000:
                self._pairs.clear()
            found = self._pairs[a, b] = self.merge(self.token[a] + self.token[b])
        return found

    def neighbours(self, a: int, b: int) -> bool:
        """Whether the two tokens stand next to each other in an encoding."""
        found = self.pair(a, b)
        return len(found) == 2 and found[0] == a and found[1] == b

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of both."""
        if not left or not right:
            return left + right
        self.joins += 1
        middle, size = self.pair(left[-1], right[0]), 1
        while True:
            a, b = max(0, len(left) - size), min(len(right), size)
            if size > 1:
                middle = self.merge(b"".join([self.token[t] for t in left[a:] + right[:b]]))
            if (a == 0 or self.neighbours(left[a - 1], middle[0])) and (b == len(right) or self.neighbours(middle[-1], right[b])):
                return left[:a] + middle + right[b:]
            size *= 2

    def tree(self, data: bytes) -> list[int]:
        """The encoding of bytes that no wall divides; short ones are kept (the bound changes speed only)."""
        if len(data) > max(8, self.leaf):
            half = len(data) // 2
            return self.join(self.tree(data[:half]), self.tree(data[half:]))
        found = self._halves.get(data)
        if found is None:
            half = len(data) // 2
            found = self.merge(data) if len(data) <= self.leaf else self.join(self.tree(data[:half]), self.tree(data[half:]))
            if len(self._halves) > 200_000:
                self._halves.clear()
            self._halves[data] = found
        return found

    def encode_piece(self, data: bytes) -> list[int]:
        """The encoding of one match of the pattern."""
        return self.as_piece(data, self.tree(data))

    def as_piece(self, data: bytes, ids: list[int]) -> list[int]:
        """A whole piece that is a token is that token, even one that merges would not reach."""
        if len(ids) > 1 and (whole := self.ranks.get(data)) is not None:
            return [whole]
        return ids

    def decode(self, ids: np.ndarray, leaf: int = 1 << 16) -> bytes:
        """Bytes of ids: those of the halves, one after the other; a leaf is one gather from the table of tokens."""
        if len(ids) > leaf:
            half = len(ids) // 2
            return self.decode(ids[:half], leaf) + self.decode(ids[half:], leaf)
        pool, begin, count = self.tables()[:3]
        return pool[ragged(begin[ids], count[ids])].tobytes()

    @lru_cache(maxsize=1)
    def tables(self) -> tuple[np.ndarray, ...]:
        """Bytes of all tokens in a row with starts and lengths; the same for decimal numbers and a comma."""
        top = max(self.token) + 1
        out = []
        for rows in ([self.token.get(i, b"") for i in range(top)], [b"%d," % i for i in range(top)]):
            n = np.fromiter(map(len, rows), np.int64, top)
            out += [np.frombuffer(b"".join(rows), np.uint8), np.cumsum(n) - n, n]
        return tuple(out)


class TreeEncoder(PieceCache):
    """Encodes texts by the tree of their halves; equal pieces, and equal joins inside pieces, are made once per worker."""

    def __init__(self, bpe: TreeBPE, most: int = CACHE_BYTES):
        super().__init__(lambda pieces: [bpe.encode_piece(p.encode("utf-8", "surrogatepass")) for p in pieces], most)
        self.bpe = bpe
        self.joined: dict[tuple[str, ...], list[int]] = {}
        self.joined_chars = 0

    def join_parts(self, parts: list[str], heights: list[int]) -> list[int]:
        """The encoding of a piece from its parts between seams, joined in the order of the seams' heights in the tree."""
        found = self.joined.get(key := tuple(parts))
        if found is None:
            values = [self.bpe.tree(p.encode("utf-8", "surrogatepass")) for p in parts]
            heights = heights[:]
            while heights:
                k = heights.index(min(heights))
                values[k : k + 2] = [self.bpe.join(values[k], values[k + 1])]
                del heights[k]
            found = self.bpe.as_piece("".join(parts).encode("utf-8", "surrogatepass"), values[0])
            if 20 * self.joined_chars + 300 * len(self.joined) > JOINED_BYTES:
                self.joined.clear()
                self.joined_chars = 0
            self.joined[key] = found
            self.joined_chars += sum(map(len, parts))
        return found

    def encode_part(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cp, at = code_points(texts)
        starts = piece_starts(cp, at)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        ends = np.append(starts[1:], len(cp))
        seam, height = seams(at)
        piece = np.searchsorted(starts, seam, "right") - 1
        inside = starts[piece] != seam  # elsewhere the join is concatenation
        seam, height, piece = seam[inside], height[inside], piece[inside]
        cut, first = np.unique(piece, return_index=True)
        results = []
        for p, a, b in zip(cut.tolist(), first.tolist(), np.append(first[1:], len(piece)).tolist()):
            edge = [int(starts[p]), *seam[a:b].tolist(), int(ends[p])]
            results.append(self.join_parts([spelled(cp[i:j]) for i, j in zip(edge, edge[1:])], height[a:b].tolist()))
        uncut = np.ones(len(starts), bool)
        uncut[cut] = False
        size = ends - starts
        kept = cp[ragged(starts[uncut], size[uncut])] if len(cut) else cp
        own = size[uncut]
        ids, count = self.encode_pieces(kept, np.cumsum(own) - own) if len(own) else (np.zeros(0, np.uint32), own)
        n, where = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        more = np.fromiter(map(len, results), np.int64, len(results))
        n[uncut], n[cut] = count, more
        where[uncut], where[cut] = np.cumsum(count) - count, len(ids) + np.cumsum(more) - more
        pool = np.concatenate([ids, np.fromiter((i for r in results for i in r), np.uint32, int(more.sum()))])
        upto = np.concatenate([[0], np.cumsum(n)])
        return pool[ragged(where, n)], np.diff(upto[np.searchsorted(starts, at)])


def seams(at: np.ndarray, leaf: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where texts, which begin at ``at``, are cut into leaves by halving, in ascending order, and how high in the tree each seam is joined."""
    n = np.diff(at)
    depth = np.ceil(np.log2(np.maximum(n / (leaf or TEXT_LEAF), 1))).astype(np.int64)
    leaves = 1 << depth
    text = np.repeat(np.arange(len(n)), leaves - 1)
    i = ragged(np.ones(len(n), np.int64), leaves - 1)
    return at[text] + n[text] * i // leaves[text], (i & -i)


@lru_cache(maxsize=2)
def tree_encoder(path: str) -> TreeEncoder:
    return TreeEncoder(TreeBPE.from_file(path))


def digests(data: bytes, sizes: np.ndarray, cut: int = 0) -> list[str]:
    """SHA-256 of each of the texts in a row, whose sizes are given, without their last ``cut`` bytes."""
    edge, view = np.concatenate([[0], np.cumsum(sizes)]).tolist(), memoryview(data)
    return [hashlib.sha256(view[a : max(a, b - cut)]).hexdigest() for a, b in zip(edge, edge[1:])]


def summed(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(values)])
    return np.diff(upto[at])


def encode_documents(docs: DataFrame, vocab: str) -> DataFrame:
    """doc_id and ids (array of int) of each text.

    Null texts are empty, null ids and repeated rows stay, other columns are ignored, an empty
    table gives no row.  A very long text is encoded part by part, so it costs memory for its ids
    and one part; one without any blank between other signs is one part.
    """

    def work(batch: pa.RecordBatch) -> dict:
        cache = tree_encoder(vocab)
        texts, parts, sizes = batch.column(1).to_pylist(), [], []
        for a, b in text_slices(texts):
            ids, at = cache.encode_texts(texts[a:b])
            parts.append(ids)
            sizes.append(np.diff(at))
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate(sizes))])
        flat = pa.array(np.concatenate(parts).astype(np.int32))
        return {"doc_id": batch.column(0), "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)}

    return map_batches(texts_of(docs, "doc_id"), work, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocab: str) -> DataFrame:
    """Per row of :func:`encode_documents`: how many ids, and the digests of the ids and of the bytes they decode to."""

    def work(batch: pa.RecordBatch) -> dict:
        bpe = tree_encoder(vocab).bpe
        _, _, count, dpool, dbegin, dcount = bpe.tables()
        lists = batch.column(1)
        flat, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())]).astype(np.int64)
        by_ids, by_bytes, k = [], [], 0
        while k < len(ends) - 1:
            m = max(k + 1, int(np.searchsorted(ends, ends[k] + 1_000_000, "right")) - 1)
            ids, at = flat[ends[k] : ends[m]], ends[k : m + 1] - ends[k]
            by_ids += digests(dpool[ragged(dbegin[ids], dcount[ids])].tobytes(), summed(dcount[ids], at), 1)
            by_bytes += digests(bpe.decode(ids), summed(count[ids], at))
            k = m
        return {"doc_id": batch.column(0), "n_tokens": np.diff(ends), "ids_sha256": by_ids, "decoded_sha256": by_bytes}

    return map_batches(encoded, work, SCHEMA)


def op5_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents of the table and what they decode to; see :func:`encode_documents` for odd rows."""
    vocab = vocabulary("byte_bpe_multi_50k.tiktoken")
    return decode_documents(encode_documents(table(spark, sf_dir, "documents"), vocab), vocab)
