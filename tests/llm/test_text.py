"""Language, near-duplicates, repeated substrings, nearest neighbours and the pipeline, against brute force."""

import collections
import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from modeloom.llm import ann, bwt, language, minhash, substrings
from modeloom.llm.common import text_bytes
from modeloom.llm.components import components

# -- language


def test_code_lengths_by_the_book():
    text = b"abracadabra abra"
    data, at = language.folded(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    counts = {}
    for k in range(4):
        g, n = np.unique(language.grams(data, k + 1), return_counts=True)
        counts[k] = (g, n)
    tree = language.ContextTree(counts)
    padded = b"   " + text
    seen = [collections.Counter(padded[i - k : i + 1] for i in range(3, len(padded))) for k in range(4)]

    def bits(context: bytes, symbol: int) -> float:
        total = 0.0
        for k in (3, 2, 1, 0):
            c = context[3 - k :]
            followers = {g: n for g, n in seen[k].items() if g[:-1] == c}
            if not followers:
                continue
            whole = sum(followers.values()) + len(followers)
            if c + bytes([symbol]) in followers:
                return total - np.log2(followers[c + bytes([symbol])] / whole)
            total -= np.log2(len(followers) / whole)
        return total + 8

    model = language.Model(["x"], [tree])
    for probe in (b"abra", b"cab zz", b"", b"qqq", "é abr".encode()):
        p = b"   " + probe
        want = sum(bits(p[i - 3 : i], p[i]) for i in range(3, len(p)))
        raw = np.frombuffer(b"abc" + probe + b"abra", np.uint8)
        got = model.lengths(raw, np.array([0, 3, 3 + len(probe), len(raw)]))
        assert got[1, 0] == pytest.approx(want, rel=1e-5)


def test_folding():
    data, at = language.folded(np.frombuffer("ÀÉß×A-z9".encode(), np.uint8), np.array([0, len("ÀÉß×A-z9".encode())]))
    assert data.tobytes().decode() == "   àéß×a z "


def test_op7(spark, sf):
    rows = language.op7_language(spark, sf).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows) and len(rows) == len(truth)
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.97 * len(out) > 0
    assert all(0 <= r.score <= 1 for r in rows)


def fold(text):
    out = [0x20] * 3
    for b in text.encode():
        if b < 0x80:
            b = ord(chr(b).lower()) if chr(b).isalpha() else 0x20
        elif out[-1] == 0xC3 and 0x80 <= b <= 0x9E and b != 0x97:
            b += 0x20
        out.append(b)
    return out


def test_predictions_of_the_query_by_the_book(spark, sf):
    """Code lengths by dictionaries: escapes of method C from order 3 down, then a uniform byte."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    seen = collections.defaultdict(lambda: collections.defaultdict(collections.Counter))  # language, context, byte
    for r in docs:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            b = fold(r.text)
            for i in range(3, len(b)):
                for k in range(4):
                    seen[r.lang][tuple(b[i - k : i])][b[i]] += 1

    def bits(lang, b):
        total = 0.0
        for i in range(3, len(b)):
            for k in (3, 2, 1, 0):
                c = seen[lang].get(tuple(b[i - k : i]))
                if c is None:
                    continue
                n = sum(c.values()) + len(c)
                if b[i] in c:
                    total -= np.log2(c[b[i]] / n)
                    break
                total -= np.log2(len(c) / n)
            else:
                total += 8
        return total

    got = {r.doc_id: r for r in language.op7_language(spark, sf).collect()}
    for r in docs[::9]:
        if not any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id].lang_pred == "und"
            continue
        cost = {lang: bits(lang, fold(r.text)) for lang in sorted(seen)}
        best = min(cost, key=cost.get)
        assert got[r.doc_id].lang_pred == best
        assert got[r.doc_id].score == pytest.approx(1 / sum(2.0 ** max(cost[best] - v, -1000) for v in cost.values()), abs=1e-3)


def test_a_sample_of_each_language(spark):
    rows = [(i, f"word{i} and more", "xy"[i % 2] if i < 900 else "z") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    many, few = language.train(df), language.train(df, 50)
    n = lambda model, k: int(model.trees[k].orders[0][1].sum())
    assert many.languages == few.languages == ["x", "y", "z"]
    assert all(0.05 < n(few, k) / n(many, k) < 0.3 for k in (0, 1)) and n(few, 2) < n(many, 2)


def test_op7_odd(spark, odd, nothing):
    model = spark.sparkContext.broadcast(language.train(odd))
    rows = language.predict(odd, model).collect()
    assert rows[0].v == "x" and len(rows) == odd.count()
    clash = odd.selectExpr("*", "'a' as lang_pred", "'b' as score", "'c' as lang_pred_", "'d' as __text")
    more = language.predict(clash, model).collect()
    assert [tuple(r)[-3:] for r in more] == [tuple(r)[-3:] for r in rows] and more[0][-7:-3] == ("a", "b", "c", "d")
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (letters or r.score == 0)
    none = spark.sparkContext.broadcast(language.train(nothing))
    assert {r.lang_pred for r in language.predict(odd, none).collect()} == {"und"}
    assert language.predict(nothing, model).count() == 0


# -- near-duplicates


def bag(text, words=5):
    w = (text or "").lower().split()
    return collections.Counter([tuple(w)] if 0 < len(w) < words else [tuple(w[i : i + words]) for i in range(len(w) - words + 1)])


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


def brute_classes(rows):
    bags, parent = [(d, t or "", bag(t)) for d, t in rows if d is not None], {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for i, (d, t, a) in enumerate(bags):
        find(d)
        for e, u, b in bags[:i]:
            if t == u or similarity(a, b) >= 0.8:
                x, y = find(d), find(e)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d, _, _ in bags}


def test_signatures_are_unbiased():
    rng = random.Random(5)
    base = [f"w{rng.randrange(200)}" for _ in range(300)]
    texts = [" ".join(base)]
    for k in (3, 12, 40):
        own = base[:]
        for i in rng.sample(range(300), k):
            own[i] = f"new{i}"
        texts.append(" ".join(own))
    texts += ["a b c d e " * 60, "a b c d e " * 45, "one two", ""]
    found = minhash.shingles(texts)
    sig = minhash.signatures(*found, len(texts), registers=4000)
    items = minhash.multisets(*found, len(texts))
    for i in range(len(texts)):
        for j in range(i):
            want = similarity(bag(texts[i]), bag(texts[j]))
            assert minhash.weighted_jaccard(items[i], items[j]) == pytest.approx(want, abs=1e-9)
            if texts[i] and texts[j]:
                assert (sig[i] == sig[j]).mean() == pytest.approx(want, abs=0.04)
    close = minhash.similar(items, items, 0.8, width=16)
    assert close.tolist() == [[bool(a and b) and minhash.weighted_jaccard(a, b) >= 0.8 for b in items] for a in items]


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 140), rng.randrange(100, 140)) for _ in range(30)] + [(500, k) for k in range(501, 530)]
    got = {r.v: r.component for r in components(spark.createDataFrame([*edges, (7, 7), (None, 3)], "a long, b long")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {v: find(v) for v in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def families(seed, n):
    """Families of near copies whose members lie on both sides of the threshold."""
    rng, rows = random.Random(seed), []
    for family in range(n):
        base = [f"{family}x{rng.randrange(10_000)}" for _ in range(rng.choice([3, 80, 160]))]
        for _ in range(rng.randrange(1, 14)):
            own = base[:]
            for i in rng.sample(range(len(own)), min(len(own) - 1, rng.randrange(5))):
                own[i] = f"e{rng.randrange(10_000)}"
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return list(enumerate(rows, 10))


def test_op2(spark, sf, documents):
    got = {r.doc_id: r.class_id for r in minhash.op2_minhash(spark, sf).collect()}
    assert got == brute_classes(documents.items())


@pytest.mark.parametrize("block", [minhash.BLOCK, 3])
def test_op2_families(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = families(block, 12)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_classes(rows)
    assert got == want
    assert len(set(want.values())) < 0.9 * len(rows)


def test_shingles_of_a_long_text():
    long_ = " ".join(f"w{i % 1013}" for i in range(420_000))
    assert len(long_) > 2_000_000
    text, value, weight = minhash.shingles(["a b c d e f", long_, ""])
    want = bag(long_)
    assert np.bincount(text, minlength=3).tolist() == [2, len(want), 0]
    assert sorted(weight[text == 1].tolist()) == sorted(want.values())


def test_op2_odd(odd, nothing):
    got = minhash.near_duplicates(odd).collect()
    want = brute_classes([(r.doc_id, r.text) for r in odd.collect()])
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    assert [r.class_id for r in got if r.doc_id is None] == [None, None]
    assert minhash.near_duplicates(nothing).count() == 0


# -- repeated substrings


def place_of(row):
    """Where a row (id, text, ...) stands in the order of documents."""
    h = np.uint64(xxhash.xxh64((row[1] or "").encode(), seed=42).intdigest()).astype(np.int64)
    return row[0] is not None, row[0] or 0, int(h)


def brute_repeats(rows, length=100):
    """[(doc, removed mask)] of rows sorted by id (null first) and a hash of the text."""
    seen, out = set(), []
    for doc, text in sorted(rows, key=place_of):
        b = (text or "").encode()
        mask = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if (w := b[s : s + length]) in seen:
                mask[s : s + length] = True
            seen.add(w)
        out.append((doc, b, mask))
    return out


def test_merge_orders_suffixes():
    rng = np.random.default_rng(4)
    shards = [[bytes(rng.integers(97, 99, rng.integers(1, 30)).astype(np.uint8)) for _ in range(6)] for _ in range(3)]
    bwts, lengths, strings = [], [], []
    for shard in shards:
        data = np.frombuffer(b"".join(s + b"\0" for s in shard), np.uint8)
        n = np.array([len(s) for s in shard])
        bwts.append(bwt.transform(data, n + 1))
        lengths.append(n)
        strings += shard
    depth = 6
    found = bwt.Merged(bwts, lengths, depth)
    rows, owner, offset = found.order, found.owner, found.offset
    suffix = [strings[o][k:] + b"\0" for o, k in zip(owner, offset)]
    assert sorted(suffix) == sorted(s[k:] + b"\0" for s in strings for k in range(len(s) + 1))
    merged = [suffix[r] for r in rows]
    cut = [s[:depth] for s in merged]
    assert cut == sorted(cut)
    assert len(cut) == sum(max(0, len(s) - depth + 1) for s in strings) and not any(b"\0" in c for c in cut)
    common = found.common_prefixes(rows[1:], rows[:-1])
    for i in range(1, len(cut)):
        assert common[i - 1] == next((k for k in range(depth) if cut[i][k] != cut[i - 1][k]), depth)


@pytest.mark.parametrize("depth", [5, 10, 35, 100])
def test_merge_and_shards_find_the_same_prefixes(depth):
    rng = np.random.default_rng(depth)
    base = bytes(rng.integers(97, 100, 300).astype(np.uint8))
    shards = []
    for _ in range(4):
        cuts = rng.integers(0, 180, 7)
        shards.append([base[a : a + 120] if rng.random() < 0.7 else bytes(rng.integers(97, 100, 130).astype(np.uint8)) for a in cuts])
    strings = [x for shard in shards for x in shard]
    lengths = [np.array([len(x) for x in shard]) for shard in shards]
    rows = [np.frombuffer(b"".join(x + b"\0" for x in shard), np.uint8) for shard in shards]
    found = bwt.Merged([bwt.transform(r, n + 1) for r, n in zip(rows, lengths)], lengths, depth)
    owner, offset, whole = found.owner, found.offset, found.order.tolist()
    assert sorted(whole) == [r for r in range(len(owner)) if offset[r] + depth <= len(strings[owner[r]])]
    text = [strings[owner[r]][offset[r] : offset[r] + depth] for r in whole]
    assert text == sorted(text)
    common = found.common_prefixes(np.array(whole[1:]), np.array(whole[:-1])).tolist()
    assert common == [next((k for k in range(depth) if a[k] != b[k]), depth) for a, b in zip(text, text[1:])]
    own = np.concatenate(rows)
    left = bwt.lefts(np.concatenate(lengths) + 1)
    one = bwt.SuffixOrder(own, left)
    whole = one.order[left[one.order] > depth]
    text = [own[p : p + depth].tobytes() for p in whole]
    assert text == sorted(text)
    assert one.alike(whole[1:], whole[:-1], depth).tolist() == [a == b for a, b in zip(text, text[1:])]


def test_a_merge_knows_suffixes_by_their_places():
    rng = np.random.default_rng(9)
    shards = [[rng.integers(1, 4, rng.integers(1, 60)).astype(np.uint8) for _ in range(5)] for _ in range(4)]
    rows = [np.concatenate([np.append(x, np.uint8(0)) for x in shard]) for shard in shards]
    lengths = [np.array([len(x) for x in shard]) for shard in shards]
    found = bwt.Merged([bwt.transform(r, n + 1) for r, n in zip(rows, lengths)], lengths, 10)
    assert found.symbols.tolist() == np.concatenate(rows).tolist()
    assert (found.at[found.owner] + found.offset).tolist() == list(range(len(found.symbols)))


def test_op9_cuts_in_small_arrays():
    """Cutting takes little memory beside the text and its segments."""
    data = np.random.default_rng(3).integers(97, 123, 3_000_000).astype(np.uint8)
    tracemalloc.start()
    try:
        segments = substrings.cut(data, np.arange(0, len(data) + 1, 1500))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(segments[0]) > 30_000 and peak < 50 << 20


def passages(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(2, 8)))
    shared = [" ".join(word() for _ in range(n)) for n in (17, 25, 60)]
    rows = []
    for d in range(40):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts.append(rng.choice(shared) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randrange(1, 40))))
        rows.append((d * 3, " ".join(parts)))
    rows += [(1000, "ab" * 200), (1001, "x" * 99), (1002, "x" * 100), (1003, "x" * 250), (1004, rows[3][1]), (-5, rows[4][1] + "tail")]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"split": 1}, {"run": 2000, "shard": 3000}, {"run": 500, "shard": 900, "split": 2, "fan": 3}])
def test_op9_passages(spark, sizes):
    rows = passages(len(sizes))
    texts = spark.createDataFrame(rows, "key long, text string").repartition(3)
    got = {r.key: r.repeats for r in substrings.repeats_of(texts, **sizes).collect()}
    removed = 0
    for doc, b, mask in brute_repeats(rows):
        own = np.zeros(len(b), bool)
        for r in got.get(doc, []):
            own[r["start"] : r["start"] + r["size"]] = True
        assert (own == mask).all()
        left, spans = substrings.kept_bytes(b, [tuple(r) for r in got.get(doc, [])])
        assert left == bytes(np.frombuffer(b, np.uint8)[~mask]) and spans == int((np.diff(np.r_[0, mask.astype(int)]) == 1).sum())
        removed += mask.sum()
    assert removed > 2000


def test_op9_long_text_in_slices(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SLICE", 700)
    rng = random.Random(8)
    long_ = "".join(rng.choice("abcdefgh") for _ in range(9000))
    rows = [(1, long_), (2, "x" * 50 + long_[650:900] + "y" * 50), (3, long_[3000:]), (4, long_[:1500] * 2), (5, "q" * 5000)]
    texts = spark.createDataFrame(rows, "key long, text string")
    got = {r.key: r.repeats for r in substrings.repeats_of(texts).collect()}
    for doc, b, mask in brute_repeats(rows):
        assert substrings.kept_bytes(b, [tuple(r) for r in got.get(doc, [])])[0] == bytes(np.frombuffer(b, np.uint8)[~mask])


def test_op9_equal_hashes_decide_nothing(spark, monkeypatch):
    """With one hash for all, everything enters the transforms, and the result is the same."""
    monkeypatch.setattr(substrings, "span_hashes", lambda data, a, b: np.zeros(len(a), np.uint64))
    monkeypatch.setattr(substrings, "gram_hashes", lambda data: np.zeros(len(data), np.uint64))
    rows = passages(3)[:12]
    key, text = zip(*sorted(rows))
    data, ends = text_bytes(pa.array(text))
    known = np.zeros(1, substrings.SHARED)
    s, begin, route = substrings.asked_strings(np.array(key), data, ends, known)
    out, again, start = substrings.build_shard(s, data, begin, np.zeros(len(s), np.int64))
    windows = set(zip(again.tolist(), start.tolist()))
    seen = set()
    for k, t in sorted(rows):
        b = t.encode()
        for i in range(len(b) - 99):
            assert ((k, i) in windows) == (b[i : i + 100] in seen)
            seen.add(b[i : i + 100])


@pytest.mark.parametrize("some", [1, 7, 1 << 16])
def test_op9_equal_segments_are_intervals_of_sorted_strings(some):
    """Strings come by bucket, bytes, key and start; an interval begins wherever bucket or bytes change."""
    rng = random.Random(some)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    data, ends = text_bytes(pa.array(texts))
    s = np.zeros(len(texts), substrings.SEGMENT)
    s["key"], s["size"] = rng.sample(range(1000), len(texts)), np.diff(ends)
    bucket = np.array([rng.randint(0, 3) for _ in texts])
    order, new = substrings.sorted_strings(bucket, s, data, ends[:-1], some)
    rows = [(bucket[i], texts[i], s["key"][i]) for i in order]
    assert rows == sorted((b, t, k) for b, t, k in zip(bucket, texts, s["key"]))
    assert new.tolist() == [k == 0 or rows[k][:2] != rows[k - 1][:2] for k in range(len(rows))]


def test_op9_anchors_do_not_depend_on_the_slice(monkeypatch):
    """Where the leading bits of hashes tie, the leftmost gram is the anchor, in slices of all lengths."""
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 6000).astype(np.uint8)
    tied = rng.integers(0, 1 << 21, 1 << 16).astype(np.uint64)
    monkeypatch.setattr(substrings, "gram_hashes", lambda own: tied[own])

    def anchors(a, b):
        _, begin, end, f = substrings.all_segments(data[a:b], np.array([0, b - a]))
        return {x + a: (e + a, h) for x, e, h in zip(begin, end, f)}

    whole = anchors(0, 6000)
    for a, b in ((0, 200), (0, 1500), (0, 5900)):
        part = sorted(anchors(a, b).items())[:-1]  # the last segment is cut by the end of the slice
        assert part and all(whole[x] == v for x, v in part)


@pytest.mark.parametrize("run, slice_", [(60_000, 3_000), (200_000, 40_000)])
def test_op9_many_runs_of_the_table(spark, documents, monkeypatch, run, slice_):
    monkeypatch.setattr(substrings, "SLICE", slice_)
    texts = spark.createDataFrame(list(documents.items()), "key long, text string").repartition(4)
    got = {r.key: r.repeats for r in substrings.repeats_of(texts, run=run, shard=20_000).collect()}
    for doc, b, mask in brute_repeats(documents.items()):
        assert substrings.kept_bytes(b, [tuple(r) for r in got.get(doc, [])])[0] == bytes(np.frombuffer(b, np.uint8)[~mask])


def test_op9(spark, sf, documents):
    got = {r.doc_id: tuple(r)[1:] for r in substrings.op9_substrings(spark, sf).collect()}
    assert len(got) == len(documents)
    for doc, b, mask in brute_repeats(documents.items()):
        left = bytes(np.frombuffer(b, np.uint8)[~mask])
        assert got[doc] == (len(b), int(mask.sum()), int((np.diff(np.r_[0, mask.astype(int)]) == 1).sum()), hashlib.sha256(left).hexdigest())


def test_op9_odd(spark, odd, nothing):
    got = substrings.remove_repeats(odd)
    assert got.columns == odd.columns and got.count() == odd.count()
    want = collections.Counter()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for (doc, b, mask), r in zip(brute_repeats(rows), sorted(odd.collect(), key=place_of)):
        want[doc, None if r.text is None else bytes(np.frombuffer(b, np.uint8)[~mask]).decode("utf-8", "ignore")] += 1
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == want
    assert substrings.remove_repeats(nothing).count() == 0
    clash = spark.createDataFrame([(77, "a" * 300, 77, "r"), (88, "b" * 150 + "a" * 120, 88, "r")], "doc_id long, text string, key long, repeats string")
    assert sorted((r.doc_id, r.key, r.repeats, len(r.text)) for r in substrings.remove_repeats(clash).collect()) == [(77, 77, "r", 1), (88, 88, "r", 1)]


# -- nearest neighbours


def brute_nearest(vectors, queries, k):
    out = {}
    for q in queries:
        others = [(-float(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q]
        out[q] = sorted((round(s, 9), i) for s, i in others)[:k]
    return out


def test_op1(spark, sf):
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = collections.defaultdict(list)
    for r in ann.op1_nearest(spark, sf).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = brute_nearest(vectors, [i for i in vectors if i % 20 == 0], 20)
    assert set(got) == set(want)
    hits = sum(len({i for _, i in want[q]} & {i for _, i, _ in got[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, rows in got.items():
        assert [r for r, _, _ in rows] == list(range(1, len(want[q]) + 1))
        assert [s for _, _, s in rows] == sorted((s for _, _, s in rows), reverse=True)
        assert all(s == pytest.approx(float(vectors[q] @ vectors[i]), abs=1e-12) for _, i, s in rows)


def test_op1_odd(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8) * rng.uniform(0.5, 4)]) for i in range(300)]
    rows += [(i, [1.0] * 8) for i in range(300, 360)]  # a large group of equal vectors
    rows += [(400, None), (401, []), (402, [0.0] * 8), (403, [1.0, None] * 4), (404, [float("nan")] * 8), (405, [float("inf")] * 8), (406, [1.0] * 7), (None, [1.0] * 8), (20, rows[20][1]), (480, [-0.0, *[1.0] * 7]), (500, [0.0, *[1.0] * 7])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as h1", "2 as vec", "3 as list")
    use = {i: np.array(v) for i, v in rows if i is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((round(-r.score, 9), r.vec_id))
    want = brute_nearest(use, [i for i in use if i % 20 == 0], 5)
    assert set(got) == set(want)
    assert sum(len(set(want[q]) & set(got[q])) for q in want) >= 0.95 * 5 * len(want)
    assert got[320] == want[320] and got[480] == want[480]  # ties go to smaller ids
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0
    few = ann.nearest(df.where("vec_id < 3"), F.lit(True), 5)
    assert few.groupBy("query_id").count().where("count = 2").count() == 3


def test_long_lists_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_ROWS", 7)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 6)) + (np.arange(200) % 3)[:, None] * 8
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): r.vec_id for r in ann.nearest(df, F.col("vec_id") < 10, 3, beam=1000, ratio=50).collect()}
    want = brute_nearest(dict(enumerate(x)), range(10), 3)
    assert got == {(q, k + 1): i for q, r in want.items() for k, (_, i) in enumerate(r)}


def test_every_query_gets_its_number(spark, monkeypatch):
    """A tight cluster and a few far vectors: the lists near a far query hold too few, so more are opened."""
    monkeypatch.setattr(ann, "calibrate", lambda index, classes, asked, k, near, replicas, ratio, least, beam: (ratio, least))
    monkeypatch.setattr(ann, "LIST_PROBES", 9)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(2000, 6)) * 0.01 + 1, rng.normal(size=(60, 6)) * 30])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.Counter(r.query_id for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20, least=1, ratio=1.0).collect())
    assert got == {i: 20 for i in range(0, 2060, 20)}


def heavy(rng):
    x = rng.standard_t(2, size=(4000, 16))
    return x[np.isfinite(x).all(axis=1)]


def clustered(rng):
    return rng.normal(size=(40, 24))[rng.integers(0, 40, 4000)] * 3 + rng.normal(size=(4000, 24)) * rng.choice([0.05, 1], (4000, 1))


def outliers(rng):
    return np.concatenate([rng.normal(size=(3900, 16)), rng.normal(size=(100, 16)) * 40])


@pytest.mark.parametrize("kind", [heavy, clustered, outliers])
def test_recall(spark, kind):
    x = kind(np.random.default_rng(21))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20).collect():
        got[r.query_id].append(r.vec_id)
    s = x[::20] @ x.T
    s[np.arange(len(s)), np.arange(0, len(x), 20)] = -np.inf
    want = np.argsort(-s, axis=1)[:, :20]
    assert all(len(v) == 20 for v in got.values()) and len(got) == len(s)
    assert np.mean([len(set(got[20 * q]) & set(w.tolist())) / 20 for q, w in enumerate(want)]) >= 0.9


def test_vectors_of_varied_length(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(6000, 64))
    x *= (rng.uniform(0.5, 1, 6000) / np.linalg.norm(x, axis=1))[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20).collect():
        got[r.query_id].add(r.vec_id)
    s = x[::20] @ x.T
    s[np.arange(300), np.arange(0, 6000, 20)] = -np.inf
    want = np.argsort(-s, axis=1)[:, :20]
    assert np.mean([len(got[20 * q] & set(w.tolist())) / 20 for q, w in enumerate(want)]) >= 0.95


def test_the_beam_caps_no_query():
    rng = np.random.default_rng(12)
    c, x = rng.normal(size=(300, 9)).astype(np.float32), rng.normal(size=(40, 8))
    index = ann.Index(ann.CentroidGraph(c), 3.0, 8)
    d = np.sqrt(ann.squared(index.lift(x, True), c))
    want = d <= d.min(axis=1, keepdims=True) * 1.5
    got = np.zeros(want.shape, bool)
    got[index.lists(x, True, 1.5, 8, 2)] = True
    assert want.sum(axis=1).max() > 32 and (got & want).sum() >= 0.99 * want.sum()
    assert np.bincount(index.lists(x, False, 1.5, 4, 1)[0]).max() == 4


def test_graph_search_finds_the_nearest_centroids():
    rng = np.random.default_rng(9)
    c = rng.normal(size=(500, 8)).astype(np.float32)
    x = rng.normal(size=(50, 8)).astype(np.float32)
    ids, d = ann.CentroidGraph(c).search(x, 32, 1.5)
    exact = np.argsort(ann.squared(x, c), axis=1)[:, :5]
    assert np.mean([len(set(a[:5]) & set(b)) / 5 for a, b in zip(ids, exact)]) > 0.95
    assert (np.diff(d, axis=1)[np.isfinite(d[:, 1:])] >= 0).all()


# -- pipeline


def test_pipeline(spark, sf, documents):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language"](spark, docs, sf).cache()
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {d for d, t in documents.items() if any(c.isalpha() for c in t)}
    unique = stages["near_duplicates"](spark, kept, sf).cache()
    classes = brute_classes([(d, t) for d, t in documents.items() if d in ids])
    assert {r.doc_id for r in unique.collect()} == {d for d, c in classes.items() if d == c}
    cut = stages["repeats"](spark, unique, sf)
    rows = {r.doc_id: r for r in cut.collect()}
    for doc, b, mask in brute_repeats([(d, documents[d]) for d, c in classes.items() if d == c]):
        assert rows[doc].text == bytes(np.frombuffer(b, np.uint8)[~mask]).decode("utf-8", "ignore") and rows[doc].n_chars == len(rows[doc].text)
    out = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in out.collect()} == set(rows)


def test_pipeline_odd(spark, odd, nothing):
    import corpus_pipeline

    clash = odd.selectExpr("*", "'a' as lang_pred", "'b' as score", "'c' as __lang_pred", "'d' as __text", "'e' as gone", "'f' as __gone", "7 as __key", "'g' as repeats", "'h' as `dotted.name`")
    for docs in (clash, clash.limit(0)):
        first = docs
        for _, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, "").cache()
            docs.count()
        assert before.columns == first.columns
    # 3 is as empty as the null text of 2, and 5 equals 4
    left = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, clash, "").collect()
    assert sorted(str(r.doc_id) for r in left) == sorted(map(str, [1, 2, 4, 6, 7, 8, None, None]))
    # of the rows of an equal id the same one stays however they are dealt
    again = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, clash.repartition(7), "").collect()
    assert sorted(map(str, again)) == sorted(map(str, left))
    assert all(r["dotted.name"] == "h" and r["__key"] == 7 for r in left)


@pytest.mark.parametrize("zone", ["Etc/UTC", "America/New_York"])
def test_pipeline_keeps_columns_of_all_types(spark, zone):
    """Every stage but the last gives back columns of any type, also where an id occurs twice."""
    import corpus_pipeline

    made = {"ts": "timestamp'2020-01-02 03:04:05.678901'", "ntz": "timestamp_ntz'2020-01-02 03:04:05'", "day": "date'2021-01-01'", "map": "map('a', timestamp'2020-01-02 03:04:05', 'b', null)", "arr": "array(timestamp'2020-01-02 03:04:05', null)", "str": "named_struct('x', timestamp'2020-01-02 03:04:05', 'y', map(1, array(2)))", "dec": "cast(1.5 as decimal(20,3))", "bin": "cast('xy' as binary)", "bool": "true", "real": "cast(1.5 as float)", "tiny": "cast(3 as tinyint)", "span": "interval '1' day", "none": "cast(null as map<string,timestamp>)"}
    made |= {f"some_{k}": f"if(doc_id = 3, null, {made[k]})" for k in ("ts", "map", "arr", "str")}
    text = " ".join(f"word{i % 50} thing{i % 7}" for i in range(60))
    rows = [(1, text, "en", "a", 5), (1, text, "en", "b", 6), (2, None, "en", None, None), (None, "no id here at all", "en", "c", 3), (3, "it is " + text, "en", "z", 1), (4, "another text of other words", "en", "q", 9)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
        docs = docs.select("*", *[F.expr(v).alias(k) for k, v in made.items()])
        want = {str(r) for r in docs.select(*made).collect()}
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            got = [str(r) for r in out.select(*made).collect()]
            assert got and set(got) <= want and out.schema.simpleString() == docs.schema.simpleString(), name
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
