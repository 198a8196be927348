"""WARC and ARC, PNG, chat."""

import base64
import hashlib
import io
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from modeloom.llm import chat, media, warc
from modeloom.llm.common import new_folder

sha = lambda b: hashlib.sha256(b).hexdigest()


# -- archives


@pytest.mark.parametrize("version", [1, 2])
def test_arc_both_versions(version):
    blocks = [b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody\n\nmore", b"", b"plain text\r\nwith lines\n", "é".encode()]
    f = io.BytesIO(warc.arc_file_head("a.arc", "19990102030405", version) + b"".join(warc.arc_record({"URL": f"http://x/{i} y", "IP-address": "1.2.3.4", "Archive-date": "19990102030405", "Content-type": "text/html", "Checksum": "z"}, b, version) for i, b in enumerate(blocks)))
    got = list(warc.arc_records(f))
    assert [r.block for r in got] == blocks and got[1].fields["URL"] == "http://x/1%20y"
    headers, block = warc.parse_warc(warc.convert(got[0], "a.arc"))
    assert headers["WARC-Type"] == "response" and headers["WARC-Date"] == "1999-01-02T03:04:05Z" and headers["WARC-IP-Address"] == "1.2.3.4"
    assert headers["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"body\n\nmore").digest()).decode() and block == blocks[0]
    assert warc.parse_warc(warc.convert(got[2], "a.arc"))[0]["WARC-Type"] == "resource"
    assert warc.convert(got[0], "a.arc") == warc.convert(got[0], "a.arc") != warc.convert(got[0], "b.arc")


def test_old_urls_with_blanks_and_broken_archives():
    head = warc.arc_file_head("a", "19990102030405")
    [r] = warc.arc_records(io.BytesIO(head + b"http://x/a b c 1.2.3.4 19990102030405 text/html 3\nabc\n"))
    assert r.fields["URL"] == "http://x/a b c" and r.block == b"abc"
    for bad, said in ((b"http://x 1 2 t 9\nabc\n", "shorter"), (b"http://x 9\n", "fields")):
        with pytest.raises(ValueError, match=said):
            list(warc.arc_records(io.BytesIO(head + bad)))
    with pytest.raises(ValueError, match="begins with"):
        list(warc.arc_records(io.BytesIO(b"http://x 1 2 t 3\nabc\n")))


def test_members_and_digests():
    data = [b"a" * 10, b"", b"b" * 5000]
    z = b"".join(map(warc.gzip_member, data))
    assert list(warc.members(io.BytesIO(z), 7)) == data
    with pytest.raises(ValueError, match="truncated"):
        list(warc.members(io.BytesIO(z[:-3])))
    for n in (0, 7, -1, 2**62):
        assert warc.page_of_urn(warc.page_urn(n)) == n
    assert warc.page_of_urn("<urn:uuid:00000000-0000-0000-0000-000000000000>") is None
    record = warc.warc_record([("WARC-Record-ID", "x"), ("WARC-Block-Digest", "sha1:AAAA")], b"abc")
    with pytest.raises(ValueError, match="block digest"):
        warc.parse_warc(record)


def expected_pages(rows, least=0):
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    newest: dict = {}
    for page, _, html in rows:
        if page is not None:
            newest[html or ""] = max(page, newest.get(html or "", page))
    out = []
    for page, _, html in rows:
        new = newest.get(html or "")
        old = page is not None and page != new and len((html or "").encode()) >= least
        out.append((page, len((html or "").encode()), digest(html), "revisit" if old else "response", new if old else None))
    return sorted(out, key=str)


def test_op4(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, warc.op4_warc(spark, sf).collect()), key=str) == expected_pages(rows)


@pytest.mark.parametrize("least", [0, 3])
def test_op4_odd(spark, least):
    rows = [(1, "http://a", "same"), (2, None, "same"), (9, "http://c d\n", "same"), (3, "u", None), (4, "u", ""), (5, "u", "é😀"), (5, "u", "é😀"), (None, "u", "same"), (None, None, None), (-6, "u", "x" * 300_000), (8, "u", "HTTP/1.1 200 OK\r\n\r\nnested")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as page", "2 as keep", "3 as sum")
    got = warc.read_archives(warc.write_archives(df, new_folder(spark, "w"), least=least, most=400))
    assert sorted(map(tuple, got.collect()), key=str) == expected_pages(rows, least)
    assert warc.read_archives(warc.write_archives(df.limit(0), new_folder(spark, "w"))).count() == 0


def test_archives_are_read_by_as_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "ROWS", 7)
    pages = spark.range(200).selectExpr("id as page_id", "'u' as url", "repeat(cast(id % 150 as string), 40) as html").repartition(3)
    manifest = warc.write_archives(pages, new_folder(spark, "w"), most=1000)
    files = manifest.count()
    got = warc.read_archives(manifest)
    assert files > 10 and got.rdd.getNumPartitions() == files
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert sorted(map(tuple, got.collect()), key=str) == expected_pages(rows)


# -- images


def filtered(rows, kinds, step):
    """Row filters by the book."""
    out, h = [], rows.astype(int)
    for y, kind in enumerate(kinds):
        line = [kind]
        for x in range(rows.shape[1]):
            a = h[y, x - step] if x >= step else 0
            b = h[y - 1, x] if y else 0
            c = h[y - 1, x - step] if y and x >= step else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((h[y, x] - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        out.append(line)
    return np.array(out, np.uint8)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 7), st.integers(1, 9), st.sampled_from([1, 2, 3, 4]), st.data())
def test_png_filters(width, height, n, data):
    rng = np.random.default_rng(data.draw(st.integers(0, 999)))
    samples = rng.integers(0, 256, (height, width, n), np.uint8)
    kinds = [data.draw(st.integers(0, 4)) for _ in range(height)]
    raw = filtered(samples.reshape(height, -1), kinds, n)
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[n]
    png = media.SIGNATURE + media.chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + media.chunk(b"tEXt", b"a\0b") + media.chunk(b"IDAT", zlib.compress(raw.tobytes())) + media.chunk(b"IEND", b"")
    assert (media.png_read(png) == samples).all()
    assert (media.png_read(media.png_write(samples, most=10)) == samples).all()


@pytest.mark.parametrize("height,width,n", [(1, 1, 3), (1, 64, 3), (5, 1, 1), (9, 7, 4)])
def test_png_write_filters_every_row(height, width, n):
    samples = np.random.default_rng(4).integers(0, 256, (height, width, n), np.uint8)
    raw = zlib.decompress(b"".join(body for kind, body in media.png_chunks(media.png_write(samples)) if kind == b"IDAT"))
    kinds = [1, *[2] * (height - 1)]
    assert raw == filtered(samples.reshape(height, -1), kinds, n).tobytes()
    assert (media.png_read(media.png_write(samples)) == samples).all()


def test_png_errors():
    png = bytearray(media.png_write(np.zeros((2, 2, 3), np.uint8)))
    for change, said in ((slice(0, 1), "not a PNG"), (slice(20, 21), "checksum"), (slice(-20, -19), None)):
        bad = png.copy()
        bad[change] = b"\xfe"
        with pytest.raises((ValueError, zlib.error), match=said):
            media.png_read(bytes(bad))
    with pytest.raises(ValueError, match="end chunk|truncated"):
        media.png_read(bytes(png[:-12]))


def check_media(rows, texts):
    for r, t in zip(rows, texts):
        b = t.encode()
        payload = b.ljust(max(192, -(-len(b) // 192) * 192), b" ")
        png = media.png_write(np.frombuffer(payload, np.uint8).reshape(-1, 64, 3))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(payload), sha(payload), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(png), sha(png)) and len(r.feature) == 16


def test_op6(spark, sf, documents, odd, nothing):
    rows = media.op6_media(spark, sf).collect()
    assert len(rows) == len(documents)
    check_media(rows, [documents[r.doc_id] for r in rows])
    rows = media.features(media.store(odd)).collect()
    check_media(rows, [r.text or "" for r in odd.collect()])
    assert media.features(media.store(nothing)).count() == 0


def hash_by_the_book(samples):
    """The hash with plain loops: block means (or nearest samples) of a 32 x 32 picture, its cosine transform, signs against the median."""
    height, width = samples.shape[:2]
    grey = [[float(sum(int(v) for v in samples[y, x])) for x in range(width)] for y in range(height)]

    def reduce(line):
        n = len(line)
        if n < 32:
            return [line[i * n // 32] for i in range(32)]
        return [sum(line[i * n // 32 : (i + 1) * n // 32]) / ((i + 1) * n // 32 - i * n // 32) for i in range(32)]

    columns = [reduce([grey[y][x] for y in range(height)]) for x in range(width)]
    small = [reduce([columns[x][y] for x in range(width)]) for y in range(32)]
    cos = [[np.cos(np.pi * (2 * i + 1) * k / 64) for i in range(32)] for k in range(8)]
    low = [round(sum(cos[a][y] * small[y][x] * cos[b][x] for y in range(32) for x in range(32)), 3) for a in range(8) for b in range(8)]
    middle = float(np.median(low[1:]))
    return f"{int(''.join('1' if v > middle else '0' for v in low), 2):016x}"


def test_feature_of_the_query(spark, sf, documents):
    for r in media.op6_media(spark, sf).orderBy("doc_id").limit(25).collect():
        b = documents[r.doc_id].encode()
        samples = np.frombuffer(b.ljust(max(192, -(-len(b) // 192) * 192), b" "), np.uint8).reshape(-1, 64, 3)
        assert r.feature == hash_by_the_book(samples)


def test_hashes_follow_the_picture():
    rng = np.random.default_rng(1)
    smooth = (127 + 100 * np.sin(np.arange(200)[:, None, None] / 30) * np.cos(np.arange(64)[None, :, None] / 9)).astype(np.uint8).repeat(3, 2)
    noisy = np.clip(smooth.astype(int) + rng.integers(-4, 5, smooth.shape), 0, 255).astype(np.uint8)
    apart = lambda a, b: (int(media.cosine_hash(a), 16) ^ int(media.cosine_hash(b), 16)).bit_count()
    assert apart(smooth, noisy) <= 6 < apart(smooth, rng.integers(0, 256, smooth.shape, np.uint8))


# -- chat

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[/ROLE]", "[NAME]", "\\", " ", "a", "\n", "é"]
WORDS = st.lists(st.sampled_from(CONTROLS), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), WORDS), WORDS), max_size=6))
def test_round_trip(turns):
    turns = [(r, t) for r, t in turns]
    text = chat.instruction_template(turns)
    assert chat.parse(text) == turns
    got = chat.locate(chat.instruction_template, turns)
    assert got.rewritten_at is None and [chat.unescape(text[a:b]) for a, b in got.texts] == [t for _, t in turns]
    assert "".join(text[a:b] for a, b in got.spans) == text[len("<s>") :]


def test_a_template_that_declares_its_context_is_rendered_by_window():
    calls = []

    def render(turns):
        calls.append(len(turns))
        return chat.instruction_template(turns)

    turns = [("user" if k % 2 else "assistant", f"text {k}") for k in range(300)]
    got = chat.locate(render, turns, 0)
    assert [chat.unescape(got.formatted[a:b]) for a, b in got.texts] == [t for _, t in turns]
    assert sum(calls) < 10 * len(turns)
    assert vars(got) == vars(chat.locate(chat.instruction_template, turns))


def test_the_template_of_the_query_is_rendered_for_each_prefix():
    """Whole prefixes of 0, 1, 2, ... turns, each compared with the one before."""
    assert getattr(chat.instruction_template, "context", None) is None
    calls = []

    def render(turns):
        calls.append(tuple(t for _, t in turns))
        return chat.instruction_template(turns)

    turns = [("user" if k % 2 else "assistant", f"text {k}") for k in range(120)]
    got = chat.locate(render, turns, getattr(chat.instruction_template, "context", None))
    said = tuple(t for _, t in turns)
    assert {c for c in calls if chat.MARK not in c} == {said[:k] for k in range(121)}
    assert len(calls) == 1 + 2 * len(turns) and got.rewritten_at is None


def test_rewriting_is_found_on_the_path_of_the_query(spark):
    """A template that rewrites the first turn in one prefix only, in conversations of a table."""

    def once(turns):
        return "".join(f"<{'*' * len(t) if k == 0 and len(turns) == 71 else t}>" for k, (_, t) in enumerate(turns))

    rows = [(c, k, "user", f"text {k}") for c, n in ((1, 100), (2, 71), (3, 70), (4, 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.rewritten_at for r in chat.format_conversations(df, once).collect()} == {1: 70, 2: 70, 3: None, 4: None}


def test_templates_that_look_far_back_or_rewrite():
    numbered = lambda turns: "".join(f"<{k}:{r}>{t}" for k, (r, t) in enumerate(turns))
    turns = [("user", f"t{k}") for k in range(30)]
    for context in (None, 0, 3):  # what it declares is wrong, and found to be
        got = chat.locate(numbered, turns, context)
        assert [got.formatted[a:b] for a, b in got.texts] == [t for _, t in turns] and got.rewritten_at is None
    last_only = lambda turns: "".join(t if k == len(turns) - 1 else "." for k, (_, t) in enumerate(turns))
    assert chat.locate(last_only, turns).rewritten_at == 1


@pytest.mark.parametrize("late", [3, 69, 70, 99])
@pytest.mark.parametrize("undone", [False, True])
def test_rewriting_late_in_a_conversation(late, undone):
    """From turn ``late`` on the first turn is masked or in capitals, for ever or in that prefix only."""
    bad = lambda n: n == late + 1 if undone else n > late
    masked = lambda turns: "".join(f"<{'*' * len(t) if k == 0 and bad(len(turns)) else t}>" for k, (_, t) in enumerate(turns))
    upper = lambda turns: "".join(f"<{t.upper() if k == 0 and bad(len(turns)) else t}>" for k, (_, t) in enumerate(turns))
    turns = [("user", f"text {k}") for k in range(100)]
    for template in (masked, upper):
        got = chat.locate(template, turns)
        assert got.rewritten_at == late and len(got.spans) == late


def check_chat(spark, rows, got):
    by: dict = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(conv, []).append((role or "", text or ""))
    assert {r.conv_id for r in got} == set(by) and len(got) == len(by)
    for r in got:
        turns = by[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns).encode()))
        assert (r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(loss), sha(loss.encode()), len(chat.instruction_template(turns)))


def test_op10(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    own = "</s>[INST] ok [/INST]"
    check_chat(spark, [*rows, (-1, 0, "user", own), (-1, 1, "assistant", own)], chat.op10_chat(spark, sf).collect())


def test_op10_odd(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (1, None, None, "x"), (2, 0, "[NAME]", "</s>\\"), (None, 0, "user", "q"), (None, 1, "assistant", "r"), (3, 0, "assistant", "y" * 100_000)]
    rows += [(4, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(150)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as formatted", "2 as roles")
    check_chat(spark, rows, chat.read_back(chat.format_conversations(df)).collect())
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
