"""Cycles, frequent labels, intervals and the latest before, against loops over rows, and what their plans do."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from modeloom.operators import LOG_SUM_EXP, VARIANCE, as_of, combine, contract, contract_best, contract_masked, contract_skewed, contract_within, diagonal, einsum, einsum_shares, moving, reduce_with, stencil, trace
from modeloom.operators.ranges import cover
from modeloom.operators.shares import LocalJoin, choose_shares, loads, replicated
from modeloom.operators.skew import Summary, block_products, grid
from modeloom.operators.sliding import dealt_along
from modeloom.plans import marginals
from modeloom.tensor import Tensor


def relation(spark, seed, rows, sizes, names, hot=0.0):
    """A sparse tensor with whole values, and the same as a dictionary; ``hot``: share of rows with the first label 0."""
    rng = random.Random(seed)
    d = {}
    for _ in range(rows):
        at = tuple(0 if k == 0 and rng.random() < hot else rng.randrange(n) for k, n in enumerate(sizes))
        d[at] = rng.randint(1, 5)
    schema = ", ".join([*[f"{m} long" for m in names], "v long"])
    return d, Tensor(spark.createDataFrame([(*at, v) for at, v in d.items()], schema), names)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()




# -- cycles


@pytest.fixture(scope="module")
def triangle(spark):
    return [relation(spark, 1, 3000, (60, 50), "ab", 0.3), relation(spark, 2, 2500, (50, 70), "bc"), relation(spark, 3, 3000, (70, 60), "ca", 0.1)]


def triangle_sums(x, y, z):
    out = Counter()
    for (a, b), v in x.items():
        for c in range(70):
            if (b, c) in y and (c, a) in z:
                out[a] += v * y[b, c] * z[c, a]
    return out


@pytest.mark.parametrize("cell_rows", [None, 400])
def test_triangles(spark, triangle, cell_rows):
    (x, tx), (y, ty), (z, tz) = triangle
    want = triangle_sums(x, y, z)
    assert {r.a: r.v for r in einsum_shares([tx, ty, tz], ("a",), cell_rows).df.collect()} == dict(want)
    assert einsum_shares([tx, ty, tz], (), cell_rows).df.collect()[0].v == sum(want.values())
    got = einsum([tx, ty, tz], ("a",)).df.collect()
    assert {r.a: r.v for r in got} == dict(want)


def test_no_intermediate_is_larger_than_an_operand(triangle):
    """Partial results of one and two labels stay below the operands' rows, and the last ones are the results."""
    operands = [(tuple(m), [np.array([k[i] for k in d]) for i in range(2)], np.array(list(d.values()))) for (d, _), m in zip(triangle, ("ab", "bc", "ca"))]
    local = LocalJoin(["a", "b", "c"], operands, {"a": 60, "b": 50, "c": 70}, chunk=10**9)
    columns, sums = local.sums(["a"], {})
    (x, _), (y, _), (z, _) = triangle
    assert dict(zip(columns[0].tolist(), sums.tolist())) == dict(triangle_sums(x, y, z))
    results = sum((b, c) in y and (c, a) in z for (a, b) in x for c in range(70))
    paths = sum(b == c for (_, b) in x for (c, _) in y)
    assert max(local.widest[:3]) <= max(len(x), len(y), len(z)) < paths and local.widest[3] == results
    few = LocalJoin(["a", "b", "c"], operands, {"a": 60, "b": 50, "c": 70}, chunk=500)
    again, totals = few.sums(["a"], {})
    assert (again[0] == columns[0]).all() and (totals == sums).all() and max(few.widest) <= 500 + 70


def test_one_shuffle_of_rows_with_the_copies_that_shares_say(triangle):
    tensors = [t for _, t in triangle]
    known = loads(tensors)
    assert [x.rows for x in known] == [len(d) for d, _ in triangle]
    assert known[0].hot["a"] == max(Counter(a for a, _ in triangle[0][0]).values())
    shares = choose_shares(known, 16)
    assert np.prod(list(shares.values())) == 16
    rows = replicated(tensors, shares, "bigint")
    assert rows.count() == sum(x.rows * x.copies(shares) for x in known)
    sizes = [r["count"] for r in rows.groupBy("cell").count().collect()]
    assert len(sizes) <= 16 and max(sizes) < 3 * np.median(sizes)
    plan = plan_of(einsum_shares(tensors, ("a",)).df)
    assert plan.count("Exchange hashpartitioning(cell") == 1 and "Join" not in plan and plan.count("Exchange") == 2


def test_stored_blocks_give_the_same_as_copies(spark, triangle, monkeypatch):
    """Where rows would be sent often, each is stored once, in the block of its own labels, and cells read blocks."""
    import pathlib

    monkeypatch.setattr("modeloom.operators.shares.COPIED", 0)
    (x, tx), (y, ty), (z, tz) = triangle
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(folder.glob("shares-*"))
    made = einsum_shares([tx, ty, tz], ("a",), 400)
    assert {r.a: r.v for r in made.df.collect()} == dict(triangle_sums(x, y, z))
    tables = set(folder.glob("shares-*")) - before
    assert sum(spark.read.parquet(str(t)).count() for t in tables) == len(x) + len(y) + len(z)
    plan = plan_of(made.df)
    assert "hashpartitioning(cell" not in plan and "Join" not in plan
    odd = Tensor(spark.createDataFrame([("u", None, 2), (None, 1, 9), ("w", 1, 4)], "a string, b int, v long"), ("a", "b"))
    other = Tensor(spark.createDataFrame([(1, 10), (1, 5), (2, 7)], "b long, v long"), ("b",))
    assert {r.a: r.v for r in einsum_shares([odd, other], ("a",)).df.collect()} == {"w": 60}
    assert einsum_shares([odd, Tensor(other.df.limit(0), ("b",))], ()).df.collect()[0].v == 0


def test_a_frequent_value_is_spread_along_the_other_label():
    from modeloom.operators.shares import Load

    known = [Load(("a", "b"), 1_000_000, {"a": 900_000, "b": 10}), Load(("b", "c"), 1000, {"b": 10, "c": 10}), Load(("c", "a"), 1000, {"c": 10, "a": 10})]
    shares = choose_shares(known, 1, 70_000)
    assert shares["b"] >= 16 and shares["a"] == 1


def test_odd_operands(spark):
    x = Tensor(spark.createDataFrame([("u", 1, 2.5), ("u", 1, 0.5), ("w", 2, 1.0), (None, 1, 9.0), ("u", None, 9.0)], "a string, b int, v double"), ("a", "b"))
    y = Tensor(spark.createDataFrame([(1, "q", 2), (2, "q", 3)], "b long, c string, v int"), ("b", "c"))
    z = Tensor(spark.createDataFrame([("q", "u", 10), ("q", "w", 100)], "c string, a string, v long"), ("c", "a"))
    got = {(r.a, r.c): r.v for r in einsum_shares([x, y, z], ("a", "c")).df.collect()}
    assert got == {("u", "q"): 60.0, ("w", "q"): 300.0}
    none = Tensor(x.df.limit(0), x.modes)
    assert einsum_shares([none, y, z], ("a",)).df.collect() == [] and einsum_shares([none, y, z], ()).df.collect()[0].v == 0
    # a label of one operand only is summed there, operands without a common label make a product
    assert einsum_shares([x, y], ()).df.collect()[0].v == 3.0 * 2 + 1.0 * 3
    with pytest.raises(ValueError):
        einsum_shares([x, y], ("d",))
    big = Tensor(spark.createDataFrame([(1, 2**40)], "a long, v long"), ("a",))
    with pytest.raises(Exception, match="64 bits"):
        einsum_shares([big, big], ("a",)).df.collect()


# -- frequent labels


def test_summaries_find_frequent_values_and_merge():
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(0, 50_000, 60_000), np.full(9_000, 7), np.full(2_000, 11)])
    rng.shuffle(values)
    whole = Summary(100)
    for part in np.array_split(values, 9):
        own = Summary(100)
        for piece in np.array_split(part, 5):
            own.add(piece)
            assert len(own.values) <= 100
        whole.merge(own)
    found = dict(zip(whole.values.tolist(), whole.counts.tolist()))
    slack = len(values) // 100
    for v in (7, 11):
        true = int((values == v).sum())
        assert true - slack <= found.get(v, 0) <= true


def zipf(spark, n, free, seed, names):
    rng = np.random.default_rng(seed)
    key = np.minimum(rng.zipf(1.4, n), 400)
    d = {(int(k), int(f)): 1 for k, f in zip(key, rng.integers(0, free, n))}
    schema = ", ".join([*[f"{m} long" for m in names], "v long"])
    return Tensor(spark.createDataFrame([(*at, v) for at, v in d.items()], schema), names)


def test_a_skewed_gram_is_even(spark):
    """The fullest task makes at most three times the products of the median one; a plain join is far from it."""
    a = zipf(spark, 6000, 2500, 1, "ki")
    b = a.as_("k", "j")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = contract_skewed(a, b, ("i", "j"), part=60)
        count = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        plain = a.columns("__x").hint("shuffle_hash").join(b.columns("__y"), "k")
        even, uneven = count(made.joined), count(plain)
        assert sum(even) == sum(uneven)
        assert max(even) < 3 * np.median(even) and max(uneven) > 6 * np.median(uneven)
        total = lambda t: t.df.agg(F.count("*"), F.sum("v"), F.sum(F.col("v") * (F.col("i") * 31 + F.col("j")))).first()
        assert total(made) == total(contract(a, b, ("i", "j")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("counters", [3, 1024])
def test_skewed_results_do_not_depend_on_what_is_found(spark, counters):
    d, a = relation(spark, 5, 2000, (20, 300), "ki", 0.5)
    e, b = relation(spark, 6, 2000, (20, 200), "kj", 0.4)
    want = {tuple(r) for r in contract(a, b, ("j", "i")).df.collect()}
    for part in (50, 10**6):
        assert {tuple(r) for r in contract_skewed(a, b, ("j", "i"), part=part, counters=counters).df.collect()} == want
    total = contract_skewed(a, a.as_("k", "i"), (), part=50).df.collect()[0].v
    assert total == sum(v * v for v in d.values())
    assert grid(a.df, b.df, ["k"], 10**6) == {}
    assert contract_skewed(Tensor(a.df.limit(0), a.modes), b, ("i", "j")).df.collect() == []
    with pytest.raises(ValueError):
        contract_skewed(a, b.as_("q", "j"))


@pytest.mark.parametrize("semiring", ["sum_product", "max_plus", "min_plus"])
@pytest.mark.parametrize("kind", ["long", "double"])
def test_few_frequent_values_make_whole_sums_in_blocks(spark, semiring, kind):
    """No product is shuffled; rows that occur twice, nulls, and coordinates without a product are as in a plain join."""
    rng = random.Random(9)
    rows = lambda n, free: [(rng.choice([None, 0, 0, 1, 2, 5]), rng.choice([None, *range(free)]), rng.choice([None, *range(-4, 5)])) for _ in range(n)]
    a, b = spark.createDataFrame(rows(300, 60) + [(7, 99, 1)], "k long, i long, v long"), spark.createDataFrame(rows(200, 40), "k long, j long, v long").withColumn("j", F.col("j").cast("string"))
    a, b = (Tensor(x.withColumn("v", F.col("v").cast(kind)), x.columns[:2]) for x in (a, b))
    made = contract_skewed(a, b, ("j", "i"), part=20, semiring=semiring)
    plain = contract(a, b, ("j", "i"), semiring=semiring)
    assert made.df.schema["v"].dataType == plain.df.schema["v"].dataType
    assert sorted(map(tuple, made.df.collect()), key=str) == sorted(map(tuple, plain.df.collect()), key=str)
    plan = plan_of(made.df).split("Initial Plan")[0]
    assert "Join" not in plan and plan.count("Exchange") == 1
    with pytest.raises(Exception, match="64 bits"):
        big = Tensor(spark.createDataFrame([(1, i, 2**40) for i in range(30)], "k long, i long, v long"), ("k", "i"))
        contract_skewed(big, big.as_("k", "j"), ("i", "j"), part=5).df.collect()


@pytest.mark.parametrize("nulls", [False, True])
def test_labels_with_equal_rows_share_their_sums(spark, nulls):
    """Of 20 kinds of labels; more labels of a kind than share a row, and labels that lack a value where ``nulls``."""
    rows = [(k, i, f"g{i % 3}", None if nulls and (i % 20, k) == (7, 2) else i % 20 * 31 + k * k) for i in range(1500) for k in range(5) if not nulls or i % 20 != k]
    a = Tensor(spark.createDataFrame(rows, "k long, i long, g string, v long"), ("k", "i", "g"))
    b = Tensor(spark.createDataFrame([(k, j, v) for k, j, g, v in rows if j < 700], "k long, j long, v long"), ("k", "j"))
    made, plain = contract_skewed(a, b, ("j", "g", "i"), part=50), contract(a, b, ("j", "g", "i"))
    total = lambda t: t.df.agg(F.count("*"), F.count("v"), F.sum("v"), F.sum(F.col("v") * (F.col("i") * 31 + F.col("j") * 7 + F.ascii(F.substring("g", 2, 1)))), F.countDistinct("i", "g", "j")).first()
    assert total(made) == total(plain) and total(made)[0] == total(made)[4] == 1500 * 700
    block = pa.table({"which": [0] * len(rows) + [1] * len(rows), "k": [r[0] for r in rows] * 2, "i": [r[1] for r in rows] + [None] * len(rows), "j": [None] * len(rows) + [r[1] for r in rows], "v": [r[3] for r in rows] * 2})
    lists = pa.concat_tables(block_products(block, ["k"], (["i"], ["j"]), "sum_product"))
    lefts, sums = (np.array(lists[c].combine_chunks().value_lengths()) for c in "iv")
    assert (lefts * sums).sum() == 1500 * 1500 and lefts.max() <= 64 and sums.max() <= 504
    assert sums.sum() < 1500 * 1500 / 30  # a sum for each pair of a kind and a label, in a few rows of lists


def test_a_written_gram_takes_little_room(spark, tmp_path):
    """All pairs of 2000 labels whose rows are of 20 kinds: less than half a byte for each of four million rows."""
    t = Tensor(spark.range(2000).selectExpr("id * 17 i", "explode(sequence(0L, 6L)) k", "1000 + id % 20 * 97 % 53 v").withColumn("v", F.col("v") + F.col("k") * F.col("v") % 11), ("i", "k"))
    made = contract_skewed(t, t.as_("j", "k"), ("i", "j"), part=50)
    each = [r["count"] for r in made.df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(each) == made.df.rdd.getNumPartitions() and max(each) < 2 * np.median(each)  # a block for each task
    made.df.write.parquet(str(tmp_path / "gram"))
    assert spark.read.parquet(str(tmp_path / "gram")).count() == 2000 * 2000
    assert sum(p.stat().st_size for p in (tmp_path / "gram").glob("*.parquet")) < 2000 * 2000 / 2


# -- intervals and the latest before


def test_covers_are_disjoint_and_whole(spark):
    rng = random.Random(4)
    pairs = [(0, 1), (0, 4096), (1, 4095), (7, 9), (63, 64), (5, 5)] + [tuple(sorted((rng.randrange(4096), rng.randrange(4097)))) for _ in range(200)]
    df = spark.createDataFrame(pairs, "b long, e long").withColumn("c", cover(F.col("b"), F.col("e"), 4))
    for b, e, cells in df.collect():
        points = [x for level, cell in cells for x in range(cell << 3 * level, (cell + 1) << 3 * level)]
        assert sorted(points) == list(range(b, e)) and len(cells) <= 14 * 4


@pytest.mark.parametrize("kind", ["whole", "times", "local times", "dates"])
def test_points_in_intervals(spark, kind):
    rng = random.Random(2)
    points = {(rng.randrange(5), rng.randrange(-1000, 9000)): rng.randint(1, 9) for _ in range(500)}
    spans = [(rng.randrange(5), i % 7, lo := rng.randrange(-2000, 9000), lo + rng.choice([0, 1, 5, 70, 3000, 20000, -5]), rng.randint(1, 4)) for i in range(400)]
    as_time = {"whole": "{}", "times": "timestamp_seconds({})", "local times": "cast(timestamp_seconds({}) as timestamp_ntz)", "dates": "date_from_unix_date(cast({} as int))"}[kind]
    p = spark.createDataFrame([(u, t, v) for (u, t), v in points.items()], "u long, t long, v long").withColumn("t", F.expr(as_time.format("t")))
    i = spark.createDataFrame(spans, "u long, g long, b long, e long, w long")
    i = i.unionByName(spark.createDataFrame([(1, 1, None, 5, 1), (1, 1, 5, None, 1)], i.schema)).withColumns({c: F.expr(as_time.format(c)) for c in "be"})
    want = Counter()
    for (u, t), v in points.items():
        for uu, g, lo, hi, w in spans:
            if u == uu and lo <= t < hi:
                want[g] += v * w
    made = contract_within(Tensor(p, ("u", "t")), "t", i, "b", "e", "w", ["u"], ("g",))
    assert {r.g: r.v for r in made.df.collect()} == dict(want)
    plan = plan_of(made.df)
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert contract_within(Tensor(p, ("u", "t")), "t", i.limit(0), "b", "e", "w", ["u"], ("g",)).df.collect() == []
    with pytest.raises(ValueError):
        contract_within(Tensor(p, ("u", "t")), "t", i, "b", "e", "w", ["q"])


def test_nothing_is_made_for_each_pair_of_point_and_interval(spark):
    """Times and intervals of one key, all close together: rows of the joins grow with the rows, not with the pairs that meet."""
    n = 1000
    points = Tensor(spark.range(n).selectExpr("1L u", "id * 10 t", "id % 3 p", "1L v"), ("u", "t", "p"))
    spans = spark.range(n).selectExpr("1L u", "id % 2 g", "id * 10 b", "id * 10 + 5000 e", "2L w")
    made = contract_within(points, "t", spans, "b", "e", "w", ["u"], ("p", "g"))
    want = Counter()
    for i in range(n):
        for j in range(i, min(n, i + 500)):
            want[j % 3, i % 2] += 2
    assert {(r.p, r.g): r.v for r in made.df.collect()} == dict(want) and sum(want.values()) > 2 * 370 * n
    assert made.met.count() < 40 * n


@pytest.mark.parametrize("listed", [0, 1 << 16])
@pytest.mark.parametrize("semiring", ["sum_product", "max_plus", "min_plus", "max_min", "or_and"])
def test_points_in_intervals_of_mixed_lengths(spark, monkeypatch, semiring, listed):
    """Full grains and others, long intervals and short ones, free labels and the time itself in the result."""
    monkeypatch.setattr("modeloom.operators.ranges.LISTED", listed)
    rng = random.Random(7)
    points = [(rng.randrange(3), rng.choice([rng.randrange(40_000), rng.randrange(100)]), rng.randrange(2), rng.randint(-3, 5)) for _ in range(500)]
    spans = [(rng.randrange(3), rng.randrange(2), lo := rng.choice([rng.randrange(40_000), rng.randrange(90)]), lo + rng.choice([1, 3, 60, 64, 512, 30_000]), rng.randint(-3, 3)) for _ in range(200)]
    p, i = spark.createDataFrame(points, "u long, t long, p long, v long"), spark.createDataFrame(spans, "u long, g long, b long, e long, w long")
    times = {"sum_product": lambda x, y: x * y, "max_plus": lambda x, y: x + y, "min_plus": lambda x, y: x + y, "max_min": min, "or_and": lambda x, y: int(x != 0 and y != 0)}[semiring]
    add = {"sum_product": lambda x, y: x + y, "min_plus": min}.get(semiring, max)
    for out in (("p", "g"), ("u", "g"), ("t", "p"), ()):
        want = {}
        for u, t, q, v in points:
            for uu, g, lo, hi, w in spans:
                if u == uu and lo <= t < hi:
                    k = tuple({"u": u, "t": t, "p": q, "g": g}[m] for m in out)
                    want[k] = add(want[k], times(v, w)) if k in want else times(v, w)
        made = contract_within(Tensor(p, ("u", "t", "p")), "t", i, "b", "e", "w", ["u"], out, semiring)
        assert {tuple(r)[:-1]: r.v for r in made.df.collect()} == want


@pytest.mark.parametrize("tasks", [1, 4, 17])
def test_latest_before(spark, tasks):
    """A key with most rows lies in several partitions; keys and times may be null, and times tie."""
    rng = random.Random(tasks)
    left = [(rng.choice([None, 0, 0, 0, 0, 1, 2]), rng.choice([None, *range(50)]), k) for k in range(600)]
    right = [(rng.choice([None, 0, 0, 3, 2]), rng.choice([None, *range(0, 50, 3)]), rng.choice([None, *range(9)]), str(k % 3)) for k in range(200)]
    a, b = spark.createDataFrame(left, "k long, t long, id long"), spark.createDataFrame(right, "k long, t long, w long, s string")
    made = as_of(a, b, "t", ["k"], ["w", "s"], tasks)
    got = {r.id: (r.w, r.s) for r in made.collect()}
    rank = lambda w: (w is not None, w or 0)
    for key, t, k in left:
        found = [(at, rank(w), s, w) for own, at, w, s in right if own == key and at is not None and t is not None and at <= t]
        assert got[k] == ((max(found)[3], max(found)[2]) if found else (None, None))
    assert len(got) == 600 and made.columns == ["k", "t", "id", "w", "s"]
    plan = plan_of(made)
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert [r.w for r in as_of(a, b.limit(0), "t", ["k"], ["w"], tasks).limit(3).collect()] == [None] * 3
    assert as_of(a.limit(0), b, "t", ["k"], ["w"], tasks).count() == 0


def test_local_times_have_no_zone(spark):
    """Hours of a day on which clocks change are as long as others."""
    from modeloom.operators.ranges import ticks

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("select timestamp_ntz'2024-03-10 01:30:00' a, timestamp_ntz'2024-03-10 03:30:00.000001' b, timestamp_ntz'1969-12-31 23:59:59' c")
        a, b, c = df.select(*[ticks(F.col(x), df.schema[x].dataType) for x in "abc"]).first()
        assert b - a == 7_200_000_001 and c == -1_000_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_latest_before_without_keys(spark):
    a, b = spark.createDataFrame([(k, k) for k in range(40)], "t long, id long"), spark.createDataFrame([(t, 10 * t) for t in (5, 6, 30)], "t long, w long")
    for tasks in (1, 6):
        got = {r.id: r.w for r in as_of(a, b, "t", [], ["w"], tasks).collect()}
        assert got == {k: None if k < 5 else 50 if k < 6 else 60 if k < 30 else 300 for k in range(40)}


# -- along an ordered label


def series(spark, seed=3, n=900, kind=None):
    rng = random.Random(seed)
    d = {(rng.randrange(3), rng.randrange(-300, 700)): rng.randint(-5, 9) for _ in range(n)}
    df = spark.createDataFrame([(g, x, v) for (g, x), v in d.items()], "g long, x long, v long")
    if kind == "dates":
        df = df.withColumn("x", F.expr("date_from_unix_date(cast(x as int))"))
    return d, Tensor(df, ("g", "x"))


def place(x, kind):
    import datetime

    return (x - datetime.date(1970, 1, 1)).days if kind == "dates" else x


@pytest.mark.parametrize("block", [1, 2, 64, 4096])
@pytest.mark.parametrize("kind", [None, "dates"])
def test_stencils_and_moving_sums(spark, block, kind):
    d, t = series(spark, kind=kind)
    weights = {-2: 1, -1: -4, 0: 6, 1: -4, 2: 1}
    got = {(r.g, place(r.x, kind)): r.v for r in stencil(t, "x", weights, block).df.collect()}
    assert got == {(g, x): sum(w * d.get((g, x + o), 0) for o, w in weights.items()) for g, x in d}
    for low, high, add, fn in ((-6, 0, F.sum, sum), (0, 9, F.max, max), (-5, -5, F.sum, sum), (3, 150, F.sum, sum)):
        got = {(r.g, place(r.x, kind)): r.v for r in moving(t, "x", low, high, add, block).df.collect()}
        near = {(g, x): [d[g, y] for y in range(x + low, x + high + 1) if (g, y) in d] for g, x in d}
        assert got == {k: fn(v) if v else None for k, v in near.items()}


def test_only_the_rims_of_blocks_are_sent_again(spark):
    """A row goes to a second block only within the band's width of a border; blocks are bounded."""
    t = Tensor(spark.range(0, 10_000).select(F.lit(1).alias("g"), F.col("id").alias("x"), F.lit(1).cast("long").alias("v")), ("g", "x"))
    rows = dealt_along(t, "x", -2, 2, 512)
    again = rows.where(~F.col("__own"))
    borders = 10_000 // 512
    assert rows.where("__own").count() == 10_000 and again.count() <= 4 * borders + 4
    assert max(r["count"] for r in rows.groupBy("__block").count().collect()) == 512 + 4
    plan = plan_of(stencil(t, "x", {-2: 1, 2: 1}, 512).df)
    assert plan.count("Exchange") == 1 and "Join" not in plan
    with pytest.raises(ValueError):
        stencil(t, "x", {0: 1}, 100)
    with pytest.raises(ValueError):
        stencil(t, "y", {0: 1})
    assert stencil(Tensor(t.df.limit(0), t.modes), "x", {0: 1}).df.collect() == []


# -- marginals


def test_marginals(spark):
    rng = random.Random(1)
    d = Counter()
    for _ in range(4000):
        d[rng.randrange(2), rng.choice([None, *range(300)]), rng.randrange(5), rng.randrange(40)] += rng.randint(1, 9)
    t = Tensor(spark.createDataFrame([(*k, v) for k, v in d.items()], "a long, b long, c long, d long, v long"), tuple("abcd"))
    with marginals(t) as run:
        assert len(run) == 16 and [x.modes for x in run[:2]] == [tuple("abcd"), tuple("abc")]
        for x in run:
            want = Counter()
            for k, v in d.items():
                want[tuple(k["abcd".index(m)] for m in x.modes)] += v
            assert {tuple(r)[:-1]: r.v for r in x.df.collect()} == dict(want)
        # a set without the widest label is never made from one with it, if a smaller one is there
        above = {"".join(sorted(s)): "".join(sorted(p)) for s, p in run.above.items()}
        assert above["ac"] == "acd" and above["cd"] == "acd" and above["a"] == "ac" and above[""] in ("a", "c")
        assert len(run.kept) < 9
    with marginals(t, [("d", "a"), ()], "max") as run:
        assert [x.modes for x in run] == [("d", "a"), ()] and run[1].df.collect()[0].v == max(d.values())
    assert run.kept == []
    with marginals(Tensor(t.df.limit(0), t.modes), [("a",), ()]) as run:
        assert run[0].df.collect() == [] and run[1].df.collect()[0].v is None
    with pytest.raises(ValueError):
        marginals(t, [("a", "a")])


# -- masks and diagonals


def test_only_masked_elements_are_summed(spark):
    x, tx = relation(spark, 1, 3000, (80, 60), "ik")
    y, ty = relation(spark, 2, 3000, (60, 90), "kj")
    mask = sorted({(random.Random(k).randrange(80), random.Random(k + 999).randrange(95)) for k in range(70)})
    tm = Tensor(spark.createDataFrame([(i, j, 0) for i, j in mask] * 2, "i long, j long, v long"), ("i", "j"))
    want = {(i, j): sum(x[i, k] * y[k, j] for k in range(60) if (i, k) in x and (k, j) in y) for i, j in mask}
    products = sum((i, k) in x and (k, j) in y for i, j in mask for k in range(60))
    made = contract_masked(tx, ty, tm)
    assert {(r.i, r.j): r.v for r in made.df.collect()} == {k: v for k, v in want.items() if v}
    every = contract(tx, ty, ("i", "j")).df.count()
    assert made.joined.count() == products < 0.03 * sum((i, k) in x and (k, j) in y for i in range(80) for k in range(60) for j in range(90)) and every > 50 * len(mask)
    turned = contract_masked(tx, ty, tm.permute("j", "i"))
    assert turned.modes == ("j", "i") and {(r.i, r.j): r.v for r in turned.df.collect()} == {k: v for k, v in want.items() if v}
    assert contract_masked(tx, ty, Tensor(tm.df.limit(0), tm.modes)).df.collect() == []
    with pytest.raises(ValueError):
        contract_masked(tx, ty, tm.as_("i", "q"))


def test_diagonals(spark, tmp_path):
    rng = random.Random(2)
    d = {(rng.randrange(9), rng.randrange(9), rng.randrange(4)): rng.randint(1, 9) for _ in range(200)}
    spark.createDataFrame([(*k, v) for k, v in d.items()], "a long, b long, c long, v long").write.parquet(str(tmp_path / "t"))
    t = Tensor(spark.read.parquet(str(tmp_path / "t")), tuple("abc"), "v", {"a": 9, "b": 12, "c": 4})
    made = diagonal(t, "i", "i", "k")
    assert {(r.i, r.k): r.v for r in made.df.collect()} == {(a, c): v for (a, b, c), v in d.items() if a == b} and made.extents == {"i": 9, "k": 4}
    scan = next(line for line in made.df._jdf.queryExecution().executedPlan().toString().splitlines() if "Scan parquet" in line)
    assert "(a#" in scan.split("DataFilters:")[1] and "= b#" in scan.split("DataFilters:")[1]
    assert {tuple(r) for r in diagonal(t, "i", "i", "i").df.collect()} == {(a, v) for (a, b, c), v in d.items() if a == b == c}
    assert {tuple(r) for r in diagonal(t, "x", "y", "z").df.collect()} == {(*k, v) for k, v in d.items()}
    assert trace(t, "i", "i", "k").df.collect()[0].v == sum(v for (a, b, _), v in d.items() if a == b)
    assert {r.k: r.v for r in trace(t, "i", "i", "k", out=["k"]).df.collect()} == Counter({c: sum(v for (a, b, q), v in d.items() if a == b and q == c) for c in range(4)})
    assert trace(Tensor(t.df.limit(0), t.modes), "i", "i", "k").df.collect()[0].v == 0
    for bad in (("i", "i"), ("v", "v", "k")):
        with pytest.raises(ValueError):
            diagonal(t, *bad)


# -- states


def test_reductions_with_states(spark):
    rng = np.random.default_rng(4)
    values = 1e9 + rng.normal(size=5000)
    keys = rng.integers(0, 40, 5000)
    rows = [(f"k{k}" if k else None, int(k) % 3, float(v)) for k, v in zip(keys, values)] + [("none", 0, None)]
    t = Tensor(spark.createDataFrame(rows, "a string, b long, v double").repartition(5), ("a", "b"))
    got = {r.a: r.v for r in reduce_with(t, ["a"], VARIANCE).df.collect()}
    assert set(got) == {f"k{k}" if k else None for k in set(keys)}
    for k in set(keys.tolist()):
        np.testing.assert_allclose(got[f"k{k}" if k else None], values[keys == k].var(), rtol=1e-6)
    whole = reduce_with(t, [], VARIANCE).df.collect()
    np.testing.assert_allclose(whole[0].v, values.var(), rtol=1e-6)
    far = Tensor(spark.createDataFrame([(k % 2, float(x)) for k, x in enumerate([1000, -1000, 1001, -1001, 999, -5000])], "a long, v double"), ("a",))
    got = {r.a: r.v for r in reduce_with(far, ["a"], LOG_SUM_EXP).df.collect()}
    np.testing.assert_allclose([got[0], got[1]], [1001 + np.log(1 + np.exp(-1) + np.exp(-2)), -1000 + np.log(1 + np.exp(-1))])
    plan = plan_of(reduce_with(t, ["a"], VARIANCE).df)
    assert plan.count("MapInArrow") == 2 and plan.count("Exchange") <= 2
    assert plan.index("MapInArrow") < plan.index("Exchange") < plan.rindex("MapInArrow")
    assert reduce_with(Tensor(t.df.limit(0), t.modes), ["a"], VARIANCE).df.collect() == []
    with pytest.raises(ValueError):
        reduce_with(t, ["q"], VARIANCE)


def test_variance_is_stable_over_a_million_rows(spark):
    """Values of 1e9 with deviations of a few units: sums of squares would lose them all."""
    rows = spark.range(1_000_000).select((F.col("id") % 4).alias("a"), (F.lit(1e9) + (F.col("id") * 7919 % 101) / 10).alias("v"))
    t = Tensor(rows, ("a",))
    i = np.arange(1_000_000)
    for r in reduce_with(t, ["a"], VARIANCE).df.collect():
        np.testing.assert_allclose(r.v, ((i[i % 4 == r.a] * 7919 % 101) / 10).var(), rtol=1e-6)


def test_states_are_sent_on_before_they_fill_a_task(spark, monkeypatch):
    from modeloom.operators import reductions

    monkeypatch.setattr(reductions, "HELD", 50)
    t = Tensor(spark.range(3000).select((F.col("id") % 700).alias("a"), F.col("id").cast("double").alias("v")), ("a",))
    got = {r.a: r.v for r in reduce_with(t, ["a"], VARIANCE).df.collect()}
    assert len(got) == 700
    for a in (0, 5, 699):
        np.testing.assert_allclose(got[a], np.arange(a, 3000, 700).var())


def test_combine_refuses_repeated_coordinates_and_weights_out_of_range(spark):
    a, b, c = (Tensor(spark.createDataFrame([(0, k)], "i long, v long"), ("i",)) for k in (1, 2, 3))
    twice = Tensor(spark.createDataFrame([(0, 1), (0, 5)], "i long, v long"), ("i",))
    assert [tuple(r) for r in combine(("i",), [a, b, c], lambda i, x, y, z: x + 10 * y + 100 * z, "outer").df.collect()] == [(0, 321)]
    with pytest.raises(Exception, match="occurs twice"):
        combine(("i",), [a, twice, c], lambda i, x, y, z: x + y + z, "outer").df.collect()
    wide = Tensor(spark.range(5).selectExpr("id as i", "id as v"), ("i",), extents={"i": 3})
    with pytest.raises(Exception, match="outside of the extents"):
        combine(("i",), [a], lambda i, v, w: v * w, "outer", weights=[wide]).df.collect()


# -- the best of each key, and stored blocks


@pytest.mark.parametrize("held", [40, 200_000])
def test_best_products(spark, monkeypatch, held):
    from modeloom.operators import best

    monkeypatch.setattr(best, "HELD", held)
    rng = random.Random(7)
    x = {(rng.choice([None, *range(30)]), rng.randrange(200)): rng.randint(-9, 9) for _ in range(3000)}
    y = {(rng.randrange(220), rng.choice("abc")): rng.randint(-5, 20) for _ in range(400)}
    tx = Tensor(spark.createDataFrame([(*k, v) for k, v in x.items()] + [(1, 500, None)], "s long, p long, v long"), ("s", "p"))
    ty = Tensor(spark.createDataFrame([(*k, v) for k, v in y.items()], "p long, c string, w long"), ("p", "c"), "w")
    made = contract_best(tx, ty, ["s"], 4)
    every = [(s, p, c, v * y[p, c]) for (s, p), v in x.items() for c in "abc" if (p, c) in y]
    want = []
    for key in {r[0] for r in every}:
        want += sorted([r for r in every if r[0] == key], key=lambda r: (-r[3], r[1], r[2]))[:4]
    assert sorted(map(tuple, made.df.collect()), key=str) == sorted(want, key=str)
    plan = plan_of(made.df)
    assert "Window" not in plan and "TakeOrdered" not in plan
    assert made.joined.count() < 0.5 * len(every)
    assert sorted(map(tuple, contract_best(tx, ty, [], 3).df.collect()), key=str) == sorted(sorted(every, key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))[:3], key=str)
    assert contract_best(Tensor(tx.df.limit(0), tx.modes), ty, ["s"], 4).df.collect() == []
    with pytest.raises(ValueError):
        contract_best(tx, ty, ["c"], 4)
    with pytest.raises(ValueError):
        contract_best(tx, ty, ["s"], 0)


def test_stored_tensors_meet_without_a_shuffle(spark):
    from modeloom.sources.blocks import contract_stored, store_blocks, stored

    x, tx = relation(spark, 1, 3000, (80, 60), "ik")
    y, ty = relation(spark, 2, 3000, (60, 90), "kj")
    for name in ("left_blocks", "right_blocks"):
        spark.sql(f"drop table if exists {name}")
    try:
        store_blocks(tx, "left_blocks", ["k"], 4, {"i": 16})
        store_blocks(ty, "right_blocks", ["k"], 4)
        a, b = stored(spark, "left_blocks", "ik"), stored(spark, "right_blocks", "kj")
        made = contract_stored(a, b, ("i", "j"))
        plan = plan_of(made.df)
        assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan  # the one of the sums
        assert {tuple(r) for r in made.df.collect()} == {tuple(r) for r in contract(tx, ty, ("i", "j")).df.collect()}
        some = stored(spark, "left_blocks", "ik", {"i": [2]})
        assert {tuple(r) for r in some.df.collect()} == {(i, k, v) for (i, k), v in x.items() if i // 16 == 2}
        files = some.df.inputFiles()
        assert files and all("i_block=2" in f for f in files) and len(files) < len(a.df.inputFiles())
        with pytest.raises(ValueError):
            stored(spark, "right_blocks", "kj", {"k": [0]})
        with pytest.raises(ValueError):
            store_blocks(tx, "other_blocks", ["q"], 4)
    finally:
        for name in ("left_blocks", "right_blocks"):
            spark.sql(f"drop table if exists {name}")
