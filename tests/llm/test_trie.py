"""The trie of conversations against one built in a loop."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from modeloom.llm import registry
from modeloom.llm.common import table
from modeloom.llm.trie import op12_trie, prefix_trie, rebuilt, sequences

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Sorted rows of the trie of (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        made[c] = convs.get(base, [])[:h] + own[h:]
    members = defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[tuple(made[c][:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, own in members.items():
        gain = (len(own) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += kids[node] == 0
            saved[node[:d]] += gain
    out = []
    for node, own in members.items():
        ends = ",".join(str(c) for c in own if len(made[c]) == len(node))
        out.append((own[0], len(node), members[node[:-1]][0] if node else None, len(own), kids[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(df):
    return sorted([tuple(r) for r in prefix_trie(rebuilt(sequences(df))).collect()], key=str)


@pytest.fixture
def parts(spark):
    def put(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)

    yield put
    put(4)


@pytest.mark.parametrize("n", [1, 4, 13])
def test_query(spark, sf, parts, n):
    parts(n)
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert sorted([tuple(r) for r in op12_trie(spark, sf).collect()], key=str) == brute(rows)


@pytest.mark.parametrize("n", [1, 7, 23])
def test_borders_inside_shared_paths(spark, parts, n):
    """Many equal conversations, prefixes of each other and long paths, so that borders fall inside of runs and open paths."""
    parts(n)
    rows = [(5 * i, t, "user", "same") for i in range(60) for t in range(12)]
    rows += [(5 * i + 300, t, "user", "same") for i in range(40) for t in range(i)]
    rows += [(1000 + i, t, "user", f"{t if t < 9 + i % 4 else i % 3}") for i in range(50) for t in range(14)]
    rows += [(5000 + 5 * i, t, "a", "x" * (t % 7)) for i in range(3) for t in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert trie(df) == brute(rows)


def test_odd_rows(spark, parts):
    long_ = "word " * 200_000
    rows = [(1, None, None, None), (1, None, "user", "b"), (1, None, "user", "a"), (1, 3, "user", None), (None, 1, "user", "lost"), (0, 1, "user", long_), (0, 1, "user", long_), (0, 2, "ab", "c"), (2, 2, "a", "bc"), (-7, 1, "user", "x"), (-5, 1, "user", "y"), (2**63 - 1, 0, "", "é"), (-(2**63), 0, "", "é")]
    rows += [(10, t, "user", "q") for t in range(9)] + [(11, 0, "user", "z"), (16, 0, "user", "z")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("part", "kind", "turns", "oid", "key", "size", "base", "h")})
    for n in (1, 5):
        parts(n)
        got = trie(df)
        assert got == brute(rows) and got[-1][0] is not None
    assert (11, 0) not in [r[:2] for r in got]
    assert trie(df.limit(0)) == []


def test_sql(spark, sf):
    if "op12_trie" not in registry.ORACLE_SQL:
        pytest.skip("no SQL")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = con.execute(registry.ORACLE_SQL["op12_trie"]).fetchall()
    names = [d[0] for d in con.description]
    assert sorted(want, key=str) == sorted([tuple(r) for r in op12_trie(spark, sf).select(*names).collect()], key=str)
