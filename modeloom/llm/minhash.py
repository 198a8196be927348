"""Near-duplicates of documents by BagMinHash over multisets of word shingles.

A shingle is five words in a row (words: runs without white space, lower case; a text of
fewer words is one shingle); its weight is how often it occurs.  Weights are discretised at
the integers and grouped in levels [0, 1), [1, 2), [2, 4), [4, 8) ...; each shingle has a
Poisson process per level, of a rate as wide as the level, whose points carry a time, a
register and a height.  A document keeps for each register the earliest point whose height
its weight covers.  Two documents agree in a register with a probability equal to their
weighted Jaccard similarity.  Processes start from hashes and are followed only up to the
time by which all registers are full, about the number of registers times its logarithm in
points, however long a document is.

Signatures are cut into bands.  In each band's bucket every document is compared with the
bucket's least one, and documents that stay unconnected are compared with all others of
their bucket in blocks.  Both compare the multisets themselves, whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modeloom.llm.common import discard, release, table, texts_of, written
from modeloom.llm.components import components
from modeloom.llm.pieces import SPACE, classes, code_points, mix, text_parts, text_slices, tile_hashes

WORDS, SIMILARITY = 5, 0.8
ROWS, BANDS = 4, 20
REGISTERS = ROWS * BANDS
BLOCK, BLOCK_BYTES = 2000, 16 << 20  # documents, and bytes of their multisets, that a side of a block has
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in a row, and how many each text has; a long text is taken part by part."""
    parts, count = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    for k, own in text_parts(texts):
        cp, at = code_points([t.lower() for t in own])
        if not len(cp):
            continue
        word = classes()[cp] != SPACE
        edge = np.zeros(len(cp) + 1, bool)
        edge[at] = True
        starts, stops = word.copy(), word.copy()
        starts[1:] &= ~word[:-1] | edge[1:-1]
        stops[:-1] &= ~word[1:] | edge[1:-1]
        starts, stops = np.flatnonzero(starts), np.flatnonzero(stops) + 1
        parts.append(tile_hashes(cp, starts, stops))
        count[k : k + len(own)] += np.diff(np.searchsorted(starts, at))
    return np.concatenate(parts), count


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, weight), by text.

    A word is known by 64 bits: sums of random numbers for each of its letters at its place.
    """
    h, count = word_hashes(texts)
    text = np.repeat(np.arange(len(texts)), count)
    first = np.cumsum(count) - count
    size = np.minimum(count[text], words)  # a short text is one shingle
    begins = np.arange(len(h)) - first[text] <= count[text] - size
    total = np.zeros(int(begins.sum()), np.uint64)
    b, size = np.flatnonzero(begins), size[begins]
    for k in range(words):
        has = size > k
        total[has] += (h[b[has] + k] ^ (h[b[has] + k] >> np.uint64(31))) * _ODD[k % 5]
    value, text = mix(total), text[begins]
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    place = np.flatnonzero(new)
    weight = np.diff(np.append(place, len(value)))
    return text[place], value[place], weight


def draw(seed: np.ndarray, step: int) -> np.ndarray:
    """64 random bits for each seed and a step."""
    return mix(seed + np.uint64(step * int(_ODD[1]) % (1 << 64)))


def uniform(seed: np.ndarray, step: int) -> np.ndarray:
    """Numbers in (0, 1)."""
    return ((draw(seed, step) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(text: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """(n, registers) signatures, uint32; texts without shingles get zeros."""
    total = np.bincount(text, weight, n)
    best = np.full((n, registers), np.inf)
    until = registers * (np.log(registers) + 6) / np.maximum(total, 1)
    open_ = total > 0
    while open_.any():
        chosen = open_[text]
        flat = best.ravel()
        level = 0
        t_, v_, w_ = text[chosen], value[chosen], weight[chosen]
        while len(t_):
            low = 0 if level == 0 else 1 << (level - 1)
            rate = 1 if level == 0 else low
            seed = draw(v_ ^ _ODD[2], level + 1)
            own, weights, limit = t_, w_, until[t_]
            time, step = np.zeros(len(own)), 0
            while len(own):
                time = time - np.log(uniform(seed, 3 * step)) / rate
                go = time <= limit
                own, weights, limit, seed, time = own[go], weights[go], limit[go], seed[go], time[go]
                if not len(own):
                    break
                register = (draw(seed, 3 * step + 1) % np.uint64(registers)).astype(np.int64)
                if level == 0:
                    np.minimum.at(flat, own * registers + register, time)
                else:
                    under = low + rate * uniform(seed, 3 * step + 2) < weights
                    np.minimum.at(flat, own[under] * registers + register[under], time[under])
                step += 1
            level += 1
            higher = w_ > (1 << (level - 1))
            t_, v_, w_ = t_[higher], v_[higher], w_[higher]
        open_ &= ~np.isfinite(best).all(axis=1)
        until = until * 2
    out = (mix(best.view(np.uint64)) >> np.uint64(32)).astype(np.uint32)
    out[total == 0] = 0
    return out


def multisets(text: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int) -> list[bytes]:
    """Per text its elements (shingle and number of the copy), 32 bits of the hash of each, ascending."""
    again = np.repeat(np.arange(len(text)), weight)
    copy = np.arange(len(again)) - np.repeat(np.cumsum(weight) - weight, weight)
    element = (mix(value[again] + copy.astype(np.uint64) * _ODD[3]) >> np.uint64(32)).astype(np.uint32)
    edge = np.searchsorted(text[again], np.arange(n + 1))
    return [np.sort(element[a:b]).tobytes() for a, b in zip(edge[:-1], edge[1:])]


def weighted_jaccard(a: bytes, b: bytes) -> float:
    """Of two multisets; elements carry 32 bits of a hash, which moves the result by less than the set size / 2**32."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    if not len(x) or not len(y):
        return 0.0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return both / (len(x) + len(y) - both)


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, whole hash of the text, signature; null where there is no word) of documents with an id."""

    def work(batches):
        import hashlib

        release()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in text_slices(texts):
                text, value, weight = shingles(texts[a:b])
                sig = signatures(text, value, weight, b - a)
                has = np.bincount(text, minlength=b - a) > 0
                sums = [hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(sums, pa.binary()), pa.array([s.tobytes() if h else None for s, h in zip(sig, has)], pa.binary())], ["doc_id", "sum", "sig"])

    return texts_of(docs, "doc_id").where("doc_id is not null").mapInArrow(work, "doc_id long, sum binary, sig binary")


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(n, BANDS) keys of buckets."""
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    total = np.zeros(parts.shape[:2], np.uint64)
    for k in range(ROWS):
        total = mix(total + parts[:, :, k] * _ODD[k] + np.uint64(k))
    return mix(total + np.arange(BANDS, dtype=np.uint64) * _ODD[4]).view(np.int64)


def banded(nodes: DataFrame) -> DataFrame:
    """(key, v): the buckets of each node."""

    def work(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, REGISTERS)
            keys = band_keys(sig)
            v = np.repeat(batch.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(v)], ["key", "v"])

    return nodes.select("v", "sig").where("sig is not null").mapInArrow(work, "key long, v long")


def multisets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(v, items) of the documents whose ids are in ``wanted`` (v)."""

    def sets(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in text_slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(multisets(*shingles(texts[a:b]), b - a), pa.binary())], ["v", "items"])

    texts = texts_of(docs, "doc_id").join(wanted.select(F.col("v").alias("doc_id")).hint("shuffle_hash"), "doc_id", "left_semi")
    return texts.mapInArrow(sets, "v long, items binary")


def verified(items: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Those of the distinct pairs (a, b) whose multisets are as similar."""

    def compare(batches):
        for batch in batches:
            keep = [weighted_jaccard(x, y) >= similarity for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(items.select(F.col("v").alias("b"), F.col("items").alias("y")), "b")
    two = one.join(items.select(F.col("v").alias("a"), F.col("items").alias("x")), "a")
    return two.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long").distinct()


def similar(left: list[bytes], right: list[bytes], similarity: float, width: int = 4096) -> np.ndarray:
    """Whether each pair of multisets is as similar; overlaps are counted by products of 0/1 matrices, some columns at a time."""
    x, y = ([np.frombuffer(b, np.uint32) for b in side] for side in (left, right))
    nx, ny = (np.array([len(a) for a in side]) for side in (x, y))
    ox, oy = np.repeat(np.arange(len(x)), nx), np.repeat(np.arange(len(y)), ny)
    x, y = np.concatenate(x), np.concatenate(y)
    shared = np.intersect1d(x, y)
    both = np.zeros((len(nx), len(ny)), np.float32)
    if not len(shared):
        return both > 1
    places = []
    for values, owner in ((x, ox), (y, oy)):
        at = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
        hit = shared[at] == values
        order = np.argsort(at[hit], kind="stable")
        places.append((at[hit][order], owner[hit][order]))
    for k in range(0, len(shared), width):
        parts = []
        for (at, owner), n in zip(places, (len(nx), len(ny))):
            a, b = np.searchsorted(at, [k, k + width])
            part = np.zeros((n, width), np.float32)
            part[owner[a:b], at[a:b] - k] = 1
            parts.append(part)
        both += parts[0] @ parts[1].T
    return both / np.maximum(nx[:, None] + ny[None, :] - both.astype(np.float64), 1) >= similarity


def least_linked(v: np.ndarray, w: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least vertex that each of ``v`` and ``w`` is linked to, directly or in steps."""
    a, b, most = v.copy(), w.copy(), np.iinfo(np.int64).max
    while True:
        a2 = np.minimum(a, np.where(hit, b[None, :], most).min(axis=1))
        b2 = np.minimum(b, np.where(hit, a2[:, None], most).min(axis=0))
        if (a2 == a).all() and (b2 == b).all():
            return a, b
        a, b = a2, b2


def unmet(items: DataFrame, bands: DataFrame, joined: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b), a written table, between documents that share a bucket and lie in different components so far.

    In a bucket, the documents outside its most frequent component meet all of its
    documents; both sides are dealt in blocks of bounded number and bytes, so no task holds a
    large bucket.  A block of pairs is compared in memory, and what it gives is one link per
    document at most, to the least one that it is linked to there, so no pairs are written.  Each
    document is sent once for each block of the other side: rows and time grow with the product
    of both sides, which is the price of losing no link.
    """
    sizes_of = items.select("v", F.octet_length("items").cast("long").alias("size"))
    member = bands.join(joined.select("v", "component"), "v", "left").join(sizes_of, "v").select("key", "v", "size", F.coalesce("component", "v").alias("c"))
    mixed = member.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    member = written(member.join(mixed, "key"), "mixed-buckets")
    by = F.struct("count", F.col("c"))
    sizes = member.groupBy("key", "c").agg(F.count("*").alias("count"), F.sum("size").alias("bytes")).groupBy("key").agg(F.sum("count").alias("n"), F.sum("bytes").alias("n_bytes"), F.max_by("c", by).alias("home"), F.max("count").alias("most"), F.max_by("bytes", by).alias("most_bytes"))
    known = member.join(sizes, "key").withColumns({"out": F.col("n") - F.col("most"), "out_bytes": F.col("n_bytes") - F.col("most_bytes")})
    blocks = lambda n: F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(n + "_bytes") / BLOCK_BYTES), F.lit(1)).cast("int")
    at = lambda n, salt: F.pmod(F.xxhash64("v", F.lit(salt)), blocks(n).cast("long")).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    outside = known.where("c <> home").withColumn("i", at("out", 1)).withColumn("j", spread("n"))
    everyone = known.withColumn("j", at("n", 2)).withColumn("i", spread("out"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        a = b = np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            get = lambda t: (t.column(3).to_numpy(), t.column(4).to_numpy(), t.column(5).to_pylist())
            (v, c, s), (w, d, u) = get(left), get(right)
            hit = similar(s, u, similarity) & (c[:, None] != d[None, :])
            one, two = least_linked(v, w, hit)
            a, b = np.concatenate([one, two]), np.concatenate([v, w])
            a, b = a[a < b], b[a < b]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    cols = ["key", "i", "j", "v", "c", "items"]
    right = [c + "2" for c in cols]
    with_items = lambda df: df.join(items, "v").select(cols)
    met = with_items(outside).groupBy(cols[:3]).cogroup(with_items(everyone).toDF(*right).groupBy(right[:3])).applyInArrow(meet, "a long, b long")
    out = written(met.distinct(), "unmet")
    discard(member)
    return out


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) of every document: the least doc_id among those linked to it, directly or in steps.

    ``docs``: doc_id, text.  A null text is empty.  Equal texts are one class even if they have no
    word; rows with an equal doc_id are one document; documents without an id take no part and
    come back with a null class; other columns are ignored; an empty table gives no row.  A very
    long text is read part by part, but costs memory for its shingles, 24 bytes each.
    Signatures that stand in for candidates miss a pair at the similarity with a chance of 3e-5.
    """
    rows = written(sign(docs), "signatures")
    nodes = written(rows.groupBy("sum").agg(F.min("doc_id").alias("v"), F.min("sig").alias("sig")), "texts")
    bands = written(banded(nodes), "bands")
    centres = bands.groupBy("key").agg(F.min("v").alias("a"), F.max("v").alias("z")).where("a < z").select("key", "a")
    met = bands.join(centres, "key")
    near = written(met.groupBy("v").agg(F.min("a").alias("a")), "star")  # every document that shares a bucket
    items = written(multisets_of(docs, near), "multisets")
    star = near.where("a < v").select("a", F.col("v").alias("b"))
    # one document with two texts links both
    same = rows.join(nodes.select("sum", "v"), "sum").where("doc_id <> v").select(F.col("v").alias("a"), F.col("doc_id").alias("b"))
    own = nodes.select(F.col("v").alias("a"))
    twice = same.join(own, same["b"] == own["a"], "left_semi")
    links = written(verified(items, star, similarity).unionByName(twice), "links")
    first = components(links)
    shared = bands.join(centres.select("key"), "key", "left_semi")
    more = unmet(items, shared, first, similarity)
    if more.limit(1).count():
        star = first
        first = components(links.unionByName(more))
        discard(star)
    discard(near, items, links, more, bands)
    whole = nodes.select("sum", "v").join(first, "v", "left").select("sum", F.coalesce("component", "v").alias("class_id"))
    out = rows.select("doc_id", "sum").join(whole, "sum").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    none = docs.where(F.col("doc_id").isNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"))
    return out.unionByName(none)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of the documents of the table; see :func:`near_duplicates` for odd rows."""
    return near_duplicates(table(spark, sf_dir, "documents"))
