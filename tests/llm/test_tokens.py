"""Pieces, tokenizers, token files and packing."""

import base64
import hashlib
import os
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from modeloom.llm import bpe, packing, pieces, token_files
from modeloom.llm.common import new_folder
from modeloom.llm.pieces import PieceCache, code_points, piece_starts, ragged, span_hashes, tile_hashes
from modeloom.llm.tokens import library_cache, vocabulary

os.environ["TOKENIZERS_PARALLELISM"] = "false"
TEXT = st.text(alphabet=st.one_of(st.sampled_from("abst'rvel dm \n\t.,!9１é　 ñ中’😀\x1c"), st.characters(codec="utf-8", exclude_categories=["Cn", "Cs"])), max_size=40)
BYTE = vocabulary("byte_bpe_50k.json")
MULTI = vocabulary("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(BYTE)
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def other():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_pieces_are_matches_of_the_pattern(texts):
    cp, at = code_points(texts)
    want = [int(at[k]) + m.start() for k, t in enumerate(texts) for m in regex.finditer(public_tokenizers.PATTERN, t)]
    assert piece_starts(cp, at).tolist() == want


def test_ragged_and_hashes():
    assert ragged(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
    x = np.array([1, 2, 3, 1, 2, 0, 1, 2])
    a, b, c, d = span_hashes(x, np.array([0, 3, 6, 0]), np.array([2, 5, 8, 3]))
    assert a == b == c != d


def thue_morse(n):
    """The word of n letters and its complement, which polynomial hashes modulo powers of two can't tell apart."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return [word, word.translate(str.maketrans("ab", "ba"))]


@pytest.mark.parametrize("n", [1024, 2048, 4096])
@pytest.mark.parametrize("together", [True, False])
def test_pieces_of_regular_build(library, other, n, together):
    words = thue_morse(n)
    for cache, encode in ((library_cache(BYTE), library), (bpe.TreeEncoder(bpe.TreeBPE.from_file(MULTI)), other)):
        for texts in [words] if together else [[w] for w in words]:
            ids, at = cache.encode_texts(texts)
            assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == [encode(t) for t in texts]
    starts = np.array([0, n])
    h = tile_hashes(code_points(words)[0], starts, starts + n)
    assert h[0] != h[1]


def test_equal_hashes_are_no_proof(monkeypatch, library):
    monkeypatch.setattr(pieces, "tile_hashes", lambda values, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    texts = ["the quick brown fox jumps", "over the lazy dog, dog, fox", "", "quick the 123 456"]
    cache = PieceCache(library_cache(BYTE).encode)
    for own in (texts, texts[::-1]):
        ids, at = cache.encode_texts(own)
        assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(own))] == [library(t) for t in own]


@pytest.mark.parametrize("chars", [1, 7, 100])
def test_long_texts_come_in_parts(documents, chars):
    for t in [*list(documents.values())[:40], "a  b 's it's c", "x" * 500]:
        parts = [own[0] for _, own in pieces.text_parts([t], chars=chars)]
        assert "".join(parts) == t
        want = [m[0] for m in regex.finditer(public_tokenizers.PATTERN, t)]
        assert [m[0] for p in parts for m in regex.finditer(public_tokenizers.PATTERN, p)] == want
    assert [k for k, _ in pieces.text_parts(["ab", "c d e f", "", "x"], chars=3)][-1] == 2


def test_a_text_above_two_million_characters(library, other):
    long_ = "".join(f"word{i % 977} {'x' * (i % 13)},\n  " for i in range(160_000))
    assert len(long_) > 2_100_000
    for cache, encode in ((library_cache(BYTE), library), (bpe.TreeEncoder(bpe.TreeBPE.from_file(MULTI)), other)):
        ids, at = cache.encode_texts(["before", long_, "", "behind"])
        assert ids[at[1] : at[2]].tolist() == encode(long_)
        assert [ids[at[k] : at[k + 1]].tolist() for k in (0, 2, 3)] == [encode(t) for t in ("before", "", "behind")]


def test_a_small_cache_gives_the_same():
    cache = PieceCache(lambda pieces: [[len(p), ord(p[0])] for p in pieces], most=3)
    for texts in (["a bb ccc", "", "dddd"], ["ccc a"], ["x y z q"]):
        ids, at = cache.encode_texts(texts)
        for k, t in enumerate(texts):
            want = [i for m in regex.finditer(public_tokenizers.PATTERN, t) for i in (len(m[0]), ord(m[0][0]))]
            assert ids[at[k] : at[k + 1]].tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_library_ids(texts):
    t = Tokenizer.from_file(BYTE) if not hasattr(test_library_ids, "t") else test_library_ids.t
    test_library_ids.t = t
    texts = [*texts, "a <|endoftext|> b", "<|endoftext|>"]
    ids, at = library_cache(BYTE).encode_texts(texts)
    for k, x in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == t.encode(x, add_special_tokens=False).ids


# -- tree reduction


def test_every_token_encodes_itself():
    tree = bpe.TreeBPE.from_file(MULTI)
    assert all(tree.merge(b) == [i] for b, i in tree.ranks.items())


@pytest.mark.parametrize("leaf", [1, 3, 24])
def test_tree_gives_the_library_s_ids(other, documents, leaf):
    tree = bpe.TreeBPE.from_file(MULTI, leaf)
    rng = np.random.default_rng(leaf)
    words = ["a" * n for n in (1, 7, 63, 64, 65, 500)] + ["".join(rng.choice(list("abcdeté"), n)) for n in (2, 9, 80, 400) for _ in range(8)]
    words += [m[0] for t in list(documents.values())[:20] for m in regex.finditer(public_tokenizers.PATTERN, t[:3000])]
    for w in words:
        if regex.fullmatch(r" ?\p{L}+", w):
            got = tree.encode_piece(w.encode())
            assert got == other(w)
            assert tree.decode(np.array(got), leaf=2).decode() == w


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=60), st.binary(max_size=60), st.binary(max_size=60))
def test_join_is_associative(a, b, c):
    t = test_join_is_associative.__dict__.setdefault("t", bpe.TreeBPE.from_file(MULTI, 4))
    x, y, z = (t.merge(d) for d in (a, b, c))
    assert t.join(t.join(x, y), z) == t.join(x, t.join(y, z)) == t.merge(a + b + c)


def test_all_documents_pass_through_joins(documents, other, monkeypatch):
    monkeypatch.setattr(bpe, "TEXT_LEAF", 40)
    tree = bpe.TreeBPE.from_file(MULTI)
    for t in [*documents.values(), "é😀" * 100, "word " * 1000]:
        encoder, before = bpe.TreeEncoder(tree), tree.joins
        tree._halves.clear()
        ids, _ = encoder.encode_texts([t])
        assert ids.tolist() == other(t)
        pieces_ = [m[0].encode() for m in regex.finditer(public_tokenizers.PATTERN, t)]
        assert tree.joins > before or max(map(len, pieces_), default=0) <= tree.leaf
        places, heights = bpe.seams(np.array([0, len(t)]))
        assert len(places) >= len(t) // 40 - 1 and (np.diff(places, prepend=0) <= 40).all()
        assert len(t) <= 400 or tree.joins > before + 1


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, max_size=4), st.integers(1, 9))
def test_cuts_fall_anywhere(texts, leaf):
    t = test_cuts_fall_anywhere.__dict__
    if "encoder" not in t:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
        t["encoder"], t["other"] = bpe.TreeEncoder(bpe.TreeBPE(ranks)), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    bpe.TEXT_LEAF, kept = leaf, bpe.TEXT_LEAF
    try:
        ids, at = t["encoder"].encode_texts(texts)
    finally:
        bpe.TEXT_LEAF = kept
    assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == [t["other"](x) for x in texts]


def test_op5(spark, sf, documents, other):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    rows = bpe.op5_tree_bpe(spark, sf).collect()
    assert len(rows) == len(documents)
    for r in rows:
        ids = other(documents[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(documents[r.doc_id].encode()))


def test_op5_odd(odd, nothing, other):
    got = bpe.decode_documents(bpe.encode_documents(odd, MULTI), MULTI).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(r.doc_id), len(other(r.text or ""))) for r in odd.collect())
    assert bpe.decode_documents(bpe.encode_documents(nothing, MULTI), MULTI).count() == 0


# -- token files


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=700))
def test_elias_fano(steps):
    values = np.cumsum([0, *steps])
    e = token_files.EliasFano.encode(values)
    assert e.all().tolist() == values.tolist()
    assert [e.select(i) for i in range(0, len(values), 7)] == values[::7].tolist()
    with pytest.raises(IndexError):
        e.select(len(values))
    n, u = len(values), int(values[-1])
    assert 8 * (len(e.low) + len(e.high)) <= n * (2 + max(0, np.log2(max(u, 1) / n))) + n + 32


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=900), st.data())
def test_elias_fano_in_part(steps, data):
    values = np.cumsum([0, *steps])
    e = token_files.EliasFano.encode(values)
    i = data.draw(st.integers(0, len(values) - 1))
    j = data.draw(st.integers(i, len(values)))
    assert e.between(i, j).tolist() == values[i:j].tolist()
    v = data.draw(st.integers(0, int(values[-1]) + 1))
    assert e.after(v, i) == max(i, int(np.searchsorted(values, v, "right")))


def test_blocks_are_found_by_select(spark, documents, library, monkeypatch, tmp_path):
    rows = sorted(documents.items())[:60]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = token_files.write_token_files(df.coalesce(1), token_files.vocabulary("byte_bpe_50k.json"), f"file://{tmp_path}")
    want, start = [], 0
    for r in sorted(manifest.collect(), key=lambda r: (r["part"], r["file"])):
        want.append((r["path"], start))
        start += r["n_ids"]
    selects = []
    select = token_files.EliasFano.select
    monkeypatch.setattr(token_files.EliasFano, "select", lambda self, i: selects.append(i) or select(self, i))
    monkeypatch.setattr(token_files, "BLOCK", 500)
    got = [tuple(x) for path, base in want for batch in token_files.file_rows(path, base) for x in zip(*batch.to_pydict().values())]
    assert got == expected_files(rows, library) and len(selects) > len(want)


def expected_files(rows, library):
    out, start = [], 0
    by = lambda t: np.uint64(xxhash.xxh64(t.encode(), seed=42).intdigest()).astype(np.int64)
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, by(r[1]))):
        ids = [*library(text), 0]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_op3(spark, sf, documents, library):
    assert sorted(map(tuple, token_files.op3_token_files(spark, sf).collect())) == expected_files(documents.items(), library)


def test_op3_odd(spark, odd, nothing, library):
    m = token_files.write_token_files(odd, BYTE, new_folder(spark, "t"))
    got = sorted(map(tuple, token_files.read_token_files(spark, m).collect()), key=lambda r: r[1])
    assert got == expected_files([(r.doc_id, r.text or "") for r in odd.collect()], library)
    f = token_files.TokenFile(m.orderBy("part", "file").first()["path"])
    assert len(f.document(0)) == got[0][2]
    m = token_files.write_token_files(nothing, BYTE, new_folder(spark, "t"))
    assert token_files.read_token_files(spark, m).count() == 0


def test_files_roll(spark, documents, library, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 1000)
    monkeypatch.setattr(token_files, "text_slices", lambda texts: pieces.text_slices(texts, 200))
    rows = [*sorted(documents.items())[:50], *[(None, f"none {k}") for k in range(40)], (-(2**63), "least"), (2**63 - 1, "most"), *[(5, "same")] * 30]
    m = token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), BYTE, new_folder(spark, "t"))
    assert m.count() > 2 * m.select("part").distinct().count()
    got = sorted(map(tuple, token_files.read_token_files(spark, m).collect()), key=lambda r: r[1])
    assert got == expected_files(rows, library)
    assert m.where("n_docs > 20").count() < m.count() and m.select("part").distinct().count() > 1


# -- packing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_best_fit_decreasing(lengths):
    lengths = np.array(lengths, np.int64)
    window, offset, n = packing.best_fit_decreasing(lengths, 64)
    left: list[int] = []  # by the book: scan all open windows
    for k in np.argsort(-lengths, kind="stable"):
        fit = [c for c in left if c >= lengths[k]]
        if fit:
            left.remove(min(fit))
        left.append((min(fit) if fit else 64) - lengths[k])
    assert n == len(left)
    used = np.bincount(window, lengths, n) if n else np.zeros(0)
    assert sorted(64 - used) == sorted(left)
    for w in range(n):
        own = np.flatnonzero(window == w)
        own = own[np.argsort(offset[own])]
        assert offset[own].tolist() == [0, *np.cumsum(lengths[own])[:-1]]


def check_pack(rows, texts, library, capacity=2048):
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= capacity
    for doc, text in texts.items():
        ids, at = [*library(text), 1], 0
        for start, n, crc, total in sorted(by_doc.pop(doc)):
            assert start == at and total == len(ids) and crc == zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())
            at += n
        assert at == len(ids)
    assert not by_doc
    return len(by_seq)


def test_op8(spark, sf, documents, library):
    rows = packing.op8_packing(spark, sf).collect()
    n = check_pack(rows, documents, library)
    assert sum(r.length for r in rows) > 0.98 * 2048 * n


def test_op8_odd(odd, nothing, library):
    rows = packing.pack(odd.where("doc_id > 2"), BYTE).collect()
    check_pack(rows, {r.doc_id: r.text or "" for r in odd.where("doc_id > 2").collect()}, library)
    assert sum(r.start == 0 for r in packing.pack(odd, BYTE, run=2).collect()) == odd.count()
    assert packing.pack(odd.withColumn("sequence_id", odd.key), BYTE).columns == [x.split()[0] for x in packing.SCHEMA.split(", ")]
    assert packing.pack(nothing, BYTE).count() == 0


def test_fill_does_not_depend_on_partitions(spark, sf, documents, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    few, many = (check_pack(packing.pack(docs.repartition(n), BYTE).collect(), documents, library) for n in (1, 200))
    assert few == many


def test_caches_are_bounded_by_bytes(other):
    """Long pieces without blanks, all different: a cache has no more than its bound and what one part of texts adds."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(4000)) for _ in range(300)]
    cache = PieceCache(lambda pieces: [[len(p), ord(p[0])] for p in pieces], most=1 << 20)
    most = 0
    for k in range(0, 300, 10):
        ids, at = cache.encode_texts(texts[k : k + 10])
        assert ids.tolist() == [x for t in texts[k : k + 10] for x in (len(t), ord(t[0]))]
        most = max(most, cache.size())
    assert most <= (1 << 20) + 2 * (4 * 40_000 + (1 << 18)) + (1 << 20) < 4 * sum(map(len, texts))
    encoder = bpe.TreeEncoder(bpe.TreeBPE.from_file(MULTI), most=1 << 18)
    whole = other
    for t in texts[:12]:
        ids, _ = encoder.encode_texts([t, t[:900]])
        assert ids.tolist() == whole(t) + whole(t[:900])
        assert encoder.size() <= (1 << 18) + (1 << 20) and 20 * encoder.joined_chars <= bpe.JOINED_BYTES + 20 * 4000


def test_a_pool_grows_in_place():
    """A full pool is never held beside a larger copy of itself."""
    cache = PieceCache(lambda pieces: [[1] for _ in pieces])
    values = np.arange(1000, dtype=np.uint32)
    tracemalloc.start()
    try:
        for _ in range(2000):
            cache.put("text", values)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert cache.pools["text"][: cache.used["text"]].tolist() == values.tolist() * 2000
    assert peak < 1.3 * cache.pools["text"].nbytes
