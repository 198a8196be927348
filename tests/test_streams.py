"""Two streams against all pairs of their rows: late rows, eviction, and a restart in the middle."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from modeloom.streaming.pairs import added_up, contract_streams

SCHEMA = "u long, i string, t timestamp, v long"


def rows_of(seed, n, begin, end, users=5):
    rng = random.Random(seed)
    return [(rng.choice([None, *range(users)]), rng.choice([None, "x", "y"]), rng.randrange(begin, end), rng.randint(1, 5)) for _ in range(n)]


def put(spark, folder, number, rows):
    df = spark.createDataFrame(rows, "u long, i string, s long, v long").select("u", "i", F.timestamp_seconds("s").alias("t"), "v")
    df.coalesce(1).write.mode("append").parquet(f"{folder}/{number}")


def stream(spark, folder, name):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*").withColumnRenamed("i", name)


def pairs(left, right, within):
    out = Counter()
    for u, i, t, v in left:
        for w, j, s, x in right:
            if u is not None and u == w and abs(t - s) <= within:
                out[i, j] += v * x
    return dict(out)


def changes(spark, tmp_path, within="100 seconds", lateness="1 hour"):
    return contract_streams(stream(spark, tmp_path / "a", "i"), ["u", "i"], stream(spark, tmp_path / "b", "j"), ["u", "j"], "t", within, lateness, out=("j", "i"))


def test_every_pair_is_made_once(spark, tmp_path):
    left, right = [rows_of(k, 60, 1000 * k, 1000 * k + 1500) for k in range(3)], [rows_of(k + 9, 60, 1000 * k, 1000 * k + 1500) for k in range(3)]
    for k in range(3):
        put(spark, tmp_path / "a", k, left[k])
        put(spark, tmp_path / "b", k, right[k])
    sums, late = added_up(changes(spark, tmp_path), str(tmp_path / "out"), ["i", "j"])
    want = pairs(sum(left, []), sum(right, []), 100)
    assert {(r.i, r.j): r.v for r in sums.collect()} == want and late == 0 and len(want) > 5


def test_a_restart_gives_the_same(spark, tmp_path):
    left, right = [rows_of(k, 40, 500 * k, 500 * k + 900) for k in range(4)], [rows_of(k + 9, 40, 500 * k, 500 * k + 900) for k in range(4)]
    for k in range(4):
        put(spark, tmp_path / "a", k, left[k])
        put(spark, tmp_path / "b", k, right[k])
        if k % 2:
            sums, late = added_up(changes(spark, tmp_path), str(tmp_path / "out"), ["i", "j"])
    assert {(r.i, r.j): r.v for r in sums.collect()} == pairs(sum(left, []), sum(right, []), 100) and late == 0


def test_late_rows_are_left_out_and_counted_and_state_ends(spark, tmp_path):
    """The second run brings rows far ahead, the third rows far behind them, which are late, and one in time."""
    first, ahead = [(1, "x", 100, 2), (2, "x", 100, 2)], [(1, "x", 50_000, 3), (3, "y", 50_000, 1)]
    put(spark, tmp_path / "a", 0, first)
    put(spark, tmp_path / "b", 0, [(1, "y", 150, 5)])
    assert [r.v for r in added_up(changes(spark, tmp_path, lateness="10 seconds"), str(tmp_path / "out"))[0].collect()] == [10]
    put(spark, tmp_path / "a", 1, ahead)
    put(spark, tmp_path / "b", 1, [(3, "y", 50_090, 7)])
    sums, late = added_up(changes(spark, tmp_path, lateness="10 seconds"), str(tmp_path / "out"))
    assert [r.v for r in sums.collect()] == [17] and late == 0
    put(spark, tmp_path / "a", 2, [(1, "x", 160, 9), (2, "x", 200, 9)])
    put(spark, tmp_path / "b", 2, [(1, "y", 50_050, 4), (2, "y", 120, 4)])
    query = changes(spark, tmp_path, lateness="10 seconds")
    sums, late = added_up(query, str(tmp_path / "out"))
    assert [r.v for r in sums.collect()] == [17 + 12] and late == 3


def test_wrong_streams(spark, tmp_path):
    put(spark, tmp_path / "a", 0, rows_of(1, 5, 0, 10))
    a = stream(spark, tmp_path / "a", "i")
    with pytest.raises(ValueError):
        contract_streams(a, ["u", "i"], a, ["w", "j"], "t", "1 second", "1 second")
