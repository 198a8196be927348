"""Vectorised splitting of texts into the pieces of a byte-level BPE pattern.

The pattern is the public one of ``public_tokenizers.PATTERN``: contractions, runs of
letters, digits or other signs with at most one leading space, and white-space runs.
A batch of texts is handled as one array of code points; the rules are evaluated with
numpy on classes of code points, so no Python object is made per piece.  Each piece
gets a hash by which it is looked up among those met before, its code points are compared
with those of the piece found, and only pieces not met before are handed to an encoder.
Code points that Python's Unicode tables do not assign count as other signs.  A worker keeps
what it has encoded in a bounded :class:`PieceCache`; the bound changes speed only, never
results.  A long text is cut at single blanks between other signs, where a piece always begins.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

LETTER, DIGIT, SPACE, OTHER = 0, 1, 2, 3
#: White space as Unicode defines it (fixed values).
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_K1, _K2, _R = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), 0xD6E8FEB86659FD93
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: Bytes after which a worker forgets the pieces it has encoded, and characters of texts that are split at a time.
CACHE_BYTES, PART_CHARS = 64 << 20, 500_000
_cache: dict[str, np.ndarray] = {}


def classes() -> np.ndarray:
    """The class of each code point."""
    if "class" not in _cache:
        kind = {"L": LETTER, "N": DIGIT}
        table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        table[WHITE] = SPACE
        _cache["class"] = table
    return _cache["class"]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd multiplier and of its inverse modulo 2**64, n at least."""
    if "pow" not in _cache or len(_cache["pow"]) < n:
        n = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("pow", _R), ("inv", pow(_R, -1, 1 << 64))):
            out, b = np.ones(n, np.uint64), base
            k = 1
            while k < n:  # out[k:2k] = out[:k] * base**k
                out[k : 2 * k] = out[:k] * np.uint64(b)
                b, k = b * b % (1 << 64), 2 * k
            _cache[name] = out
    return _cache["pow"], _cache["inv"]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of an integer array that may overlap.

    Equal contents give equal hashes.  The hash is a polynomial modulo 2**64, for which contents
    of regular build may collide; where it is used, equal hashes decide no result.
    """
    pw, inv = powers(len(values) + 1)
    v = (values.astype(np.uint64) + np.uint64(1)) * _K1
    v ^= v >> np.uint64(29)
    v *= _K2
    v *= pw[: len(v)]
    total = np.zeros(len(v) + 1, np.uint64)
    np.cumsum(v, out=total[1:])
    return mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * _K2)


def tile_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ascending disjoint spans: sums of random numbers that stand for each value at its place in the span."""
    n = len(values)
    place = np.arange(n)
    if len(starts):
        place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, n)))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(values.astype(np.uint64) * _K1 + place.astype(np.uint64) * _K2), out=total[1:])
    return mix(total[ends] - total[starts] + (ends - starts).astype(np.uint64) * _K2)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges start .. start + length."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    full = lengths > 0
    s, n = starts[full].astype(np.int64), lengths[full]
    at = np.zeros(len(n), np.int64)
    np.cumsum(n[:-1], out=at[1:])
    out[0] = s[0]
    out[at[1:]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, and where each text begins (one more entry than texts)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), at


def piece_starts(cp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where each piece begins, in ascending order; pieces never cross texts."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[cp]
    first = np.zeros(n + 1, bool)  # a text begins here
    first[at] = True
    edge = first[:n].copy()  # a run of one class begins here
    edge[1:] |= kind[1:] != kind[:-1]
    white, blank = kind == SPACE, cp == 0x20
    starts = edge.copy()
    # the last of a white run goes with what follows it: alone, or joined when it is a blank
    last = white.copy()
    last[:-1] &= ~white[1:]
    last &= ~first[1:]
    starts |= last
    joined = np.flatnonzero(last & blank) + 1
    starts[joined] = False
    # contractions: a sole apostrophe that no blank precedes, and certain letters after it
    q = np.flatnonzero((cp == 0x27) & edge)
    if len(q):
        q = q[starts[q]]
        pad = np.zeros(n + 3, np.uint32)
        pad[:n] = cp
        stop = np.zeros(n + 3, bool)
        stop[: n + 1] = first
        stop[n:] = True
        a, b = np.where(stop[q + 1], 0, pad[q + 1]), np.where(stop[q + 1] | stop[q + 2], 0, pad[q + 2])
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        size = np.where(one, 2, np.where(two, 3, 0))
        hit = size > 0
        starts[q[hit] + 1] = False
        after = q[hit] + size[hit]
        after = after[after < n]
        starts[after[~(blank_joined(starts, blank, after))]] = True
    return np.flatnonzero(starts)


def blank_joined(starts: np.ndarray, blank: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the piece at ``at`` already begins with the blank before it (never after a contraction's letter)."""
    return blank[at - 1] & ~starts[at]


class PieceCache:
    """Encoded pieces of this worker: a pool of ids, a pool of code points, and the place of each piece in both.

    All is forgotten once it takes more than ``most`` bytes, so a cache never has more than that and what one part of texts adds.
    ``whole``: a pattern; texts in which it is found are encoded each as a whole.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = CACHE_BYTES, whole: re.Pattern | None = None, encode_whole: Callable[[str], list[int]] | None = None):
        self.encode, self.most, self.whole, self.encode_whole = encode, most, whole, encode_whole
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.int64)
        self.keys, self.entry = np.zeros(0, np.uint64), none  # sorted hashes, and their entries
        self.where, self.count, self.text_at, self.text_size = none, none, none, none
        self.pools, self.used = {"ids": np.zeros(1 << 16, np.uint32), "text": np.zeros(1 << 16, np.uint32)}, {"ids": 0, "text": 0}
        self.others: dict[str, int] = {}  # pieces whose hash another piece has

    def size(self) -> int:
        """Bytes of pools and places."""
        return 48 * len(self.where) + sum(p.nbytes for p in self.pools.values()) + 8 * sum(map(len, self.others))

    def put(self, name: str, values: np.ndarray) -> None:
        used, pool = self.used[name], self.pools[name]
        if used + len(values) > len(pool):  # in place and by a fifth, so that no second pool stands beside the full one
            pool.resize(max(used + len(values), len(pool) * 6 // 5), refcheck=False)
        pool[used : used + len(values)] = values
        self.used[name] += len(values)

    def add(self, pieces: list[np.ndarray]) -> np.ndarray:
        """New entries, from code points."""
        ids = self.encode([spelled(p) for p in pieces])
        n, size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (ids, pieces))
        first = len(self.where)
        self.where = np.concatenate([self.where, self.used["ids"] + np.cumsum(n) - n])
        self.text_at = np.concatenate([self.text_at, self.used["text"] + np.cumsum(size) - size])
        self.count, self.text_size = np.concatenate([self.count, n]), np.concatenate([self.text_size, size])
        self.put("ids", np.fromiter((i for x in ids for i in x), np.uint32, int(n.sum())))
        self.put("text", np.concatenate(pieces))
        return np.arange(first, len(self.where))

    def entries(self, cp: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The entry of each piece; the pieces tile ``cp``."""
        ends = np.append(starts[1:], len(cp))
        size = ends - starts
        code, unique = pd.factorize(tile_hashes(cp, starts, ends))
        if self.size() > self.most:
            self.clear()
        place = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        if len(self.keys):
            known = self.keys[np.minimum(place, len(self.keys) - 1)] == unique
        if not known.all():
            new = np.flatnonzero(~known)
            one = np.zeros(len(unique), np.int64)
            one[code[::-1]] = np.arange(len(code) - 1, -1, -1)  # first occurrence
            fresh = self.add([cp[i:j] for i, j in zip(starts[one[new]].tolist(), ends[one[new]].tolist())])
            keys, entry = np.concatenate([self.keys, unique[new]]), np.concatenate([self.entry, fresh])
            order = np.argsort(keys)
            self.keys, self.entry = keys[order], entry[order]
            place = np.searchsorted(self.keys, unique)
        out = self.entry[place][code]
        # an equal hash proves nothing: the code points are compared
        same = self.text_size[out] == size
        held = np.where(same, size, 0)
        differ = self.pools["text"][ragged(self.text_at[out], held)] != (cp if same.all() else cp[ragged(starts, held)])
        if differ.any() or not same.all():
            same[np.searchsorted(np.cumsum(held), np.flatnonzero(differ), "right")] = False
            for k in np.flatnonzero(~same).tolist():
                piece = cp[starts[k] : ends[k]]
                name = spelled(piece)
                if name not in self.others:
                    self.others[name] = int(self.add([piece])[0])
                out[k] = self.others[name]
        return out

    def encode_pieces(self, cp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has."""
        entry = self.entries(cp, starts)
        n = self.count[entry]
        return self.pools["ids"][ragged(self.where[entry], n)], n

    def encode_part(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in a row, and how many each has."""
        cp, at = code_points(texts)
        starts = piece_starts(cp, at)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        ids, n = self.encode_pieces(cp, starts)
        upto = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=upto[1:])
        return ids, np.diff(upto[np.searchsorted(starts, at)])

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text begins in them (one more entry than texts)."""
        parts, sizes = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64)
        for k, own in text_parts(texts, self.whole):
            if own is None:
                ids = np.array(self.encode_whole(texts[k]), np.uint32)
                n = np.array([len(ids)])
            else:
                ids, n = self.encode_part(own)
            parts.append(ids)
            sizes[k : k + len(n)] += n
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])


def spelled(cp: np.ndarray) -> str:
    return cp.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def text_parts(texts: list[str], whole: re.Pattern | None = None, chars: int = PART_CHARS) -> Iterator[tuple[int, list[str] | None]]:
    """(number of the first text, texts) in runs of about so many characters, in order.

    A longer text comes in parts that are pieces in a row, each as a run of its own (as long as
    it takes to the next place where it can be cut); a text with the pattern comes as None.
    """
    begin = size = 0
    for i, t in enumerate(texts):
        special = whole is not None and whole.search(t) is not None
        if special or len(t) > chars:
            if begin < i:
                yield begin, texts[begin:i]
            at = 0
            while not special and at < len(t):
                m = _BETWEEN.search(t, at + chars)
                stop = m.start() if m else len(t)
                yield i, [t[at:stop]]
                at = stop
            if special:
                yield i, None
            begin, size = i + 1, 0
            continue
        size += len(t)
        if size >= chars:
            yield begin, texts[begin : i + 1]
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, texts[begin:]


def text_slices(texts: list[str], chars: int = PART_CHARS) -> Iterator[tuple[int, int]]:
    """Runs of texts of about so many characters, so that arrays stay small; a text is never cut."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
