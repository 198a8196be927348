import numpy as np
import pytest
from pyspark.sql import functions as F

from dense import fill, from_numpy, to_numpy
from modeloom.operators import Blocked, apply_hook, combine, combine_multi, contract, contract_blocked, contract_many, delinearise, einsum, linearise, outer, reduce_modes, regroup, reshape, scalar, slice_modes, subview_tile, tile_view, untile
from modeloom.operators.contract import chain_order
from modeloom.sources import from_array_column, from_function, from_table, read, write, write_all
from modeloom.tensor import Tensor

A, B = fill((6, 4, 3), 1, 2, 3), fill((4, 3, 5), 3, 1, 2, mod=4, scale=0.25)


@pytest.mark.parametrize(
    "ma,mb,out", [("ijk", "jkl", "il"), ("ijk", "jkl", "li"), ("jik", "kjl", "li"), ("kij", "jlk", "il")]
)
def test_contraction_by_name(spark, ma, mb, out):
    a = from_numpy(spark, A.transpose(["ijk".index(m) for m in ma]), ma)
    b = from_numpy(spark, B.transpose(["jkl".index(m) for m in mb]), mb)
    got = contract(a, b, out)
    assert got.modes == tuple(out) and got.dense
    np.testing.assert_allclose(to_numpy(got), np.einsum(f"ijk,jkl->{out}", A, B))


def test_chains_nest_on_either_side(spark):
    d = fill((5, 2), 1, 2, mod=3)
    a, b, dd = from_numpy(spark, A, "ijk"), from_numpy(spark, B, "jkl"), from_numpy(spark, d, "lm")
    want = np.einsum("ijk,jkl,lm->im", A, B, d)
    np.testing.assert_allclose(to_numpy(contract(contract(a, b), dd)), want)
    np.testing.assert_allclose(to_numpy(contract(a, contract(b, dd))), want)
    np.testing.assert_allclose(to_numpy(einsum([a, b, dd], "im")), want)
    np.testing.assert_allclose(to_numpy(einsum([dd, a, b], "mi")), want.T)


def test_cheapest_order():
    # (10 x 1000) (1000 x 2) (2 x 50): the pair over 1000 goes first
    assert chain_order(["ab", "bc", "cd"], "ad", {"a": 10, "b": 1000, "c": 2, "d": 50}) in ((2, (0, 1)), ((0, 1), 2))


def test_sparse_operands_treat_missing_rows_as_zero(spark):
    a = A * (A > 1.5)
    t = from_numpy(spark, a, "ijk", dense=False)
    t = Tensor(t.df.where("v <> 0"), t.modes, "v", t.extents)
    got = contract(t, from_numpy(spark, B, "jkl"), "il")
    np.testing.assert_allclose(to_numpy(got), np.einsum("ijk,jkl->il", a, B))
    np.testing.assert_allclose(to_numpy(t.densify()), a)
    assert t.densify().df.count() == a.size


def test_extensions(spark):
    x, y = fill((4, 3), 1, 2), fill((4, 3), 2, 1, mod=3)
    a, b = from_numpy(spark, x, "ij"), from_numpy(spark, y, "ij")
    assert scalar(a, b).df.collect()[0]["v"] == pytest.approx((x * y).sum())
    np.testing.assert_allclose(to_numpy(reduce_modes(a, "i")), x.sum(0))
    np.testing.assert_allclose(to_numpy(contract(a, b, "ij", batch="ij")), x * y)
    np.testing.assert_allclose(to_numpy(contract(a, b.as_("k", "j"), "ik", semiring="max_plus")), (x[:, None, :] + y[None]).max(2))
    np.testing.assert_allclose(to_numpy(outer(a, b.as_("k", "l"))), np.einsum("ij,kl->ijkl", x, y))
    with pytest.raises(ValueError, match="share a label"):
        outer(a, b)


def test_hooks_see_declared_coordinates(spark):
    a = apply_hook(from_numpy(spark, A, "ijk").permute("k", "i", "j"), lambda k, i, j, v: v + 100 * k + 10 * i + j)
    k, i, j = np.indices((3, 6, 4))
    np.testing.assert_allclose(to_numpy(a), A.transpose(2, 0, 1) + 100 * k + 10 * i + j)
    got = contract(from_numpy(spark, A, "ijk"), from_numpy(spark, B, "jkl"), "il", lambda i, l, v: 100 * i + l)
    np.testing.assert_allclose(to_numpy(got), 100 * np.indices((6, 5))[0] + np.indices((6, 5))[1])
    assert apply_hook(a, None) is a
    with pytest.raises(ValueError, match="must take 4 arguments"):
        apply_hook(a, lambda v: v)


def test_combine(spark):
    x, y = fill((12, 8), 1, 2), fill((12, 8), 3, 1, mod=4, scale=0.25)
    a, b = from_numpy(spark, x, "ij"), from_numpy(spark, y.T.copy(), "ji")
    i, j = np.indices((12, 8))
    np.testing.assert_allclose(to_numpy(combine("ij", [a, b], lambda i, j, p, q: p * q + 100 * i + j)), x * y + 100 * i + j)
    w = from_function(spark, {"j": 8}, lambda j: j + 1)
    np.testing.assert_allclose(to_numpy(combine("ji", [a, b], lambda j, i, p, q, w: p + w * q, weights=[w])), (x + (j + 1) * y).T)
    one, two = combine_multi("ij", [a, b], lambda i, j, p, q: [p * q, p - q + (i - j)])
    np.testing.assert_allclose(to_numpy(one), x * y)
    np.testing.assert_allclose(to_numpy(two), x - y + i - j)
    # both outputs as operands again, and contracted together
    np.testing.assert_allclose(to_numpy(combine("ij", [one, two], lambda i, j, p, q: 2 * p - 3 * q)), 2 * x * y - 3 * (x - y + i - j))
    h = from_numpy(spark, fill((8, 3), 1, 2), "jl")
    for got, want in zip(contract_many([one, two], h), (x * y, x - y + i - j)):
        np.testing.assert_allclose(to_numpy(got), want @ fill((8, 3), 1, 2))


def test_combine_of_sparse_operands(spark):
    a = Tensor(spark.createDataFrame([(0, 0, 2.0)], "i long, j long, v double"), "ij", extents={"i": 2, "j": 2})
    b = Tensor(spark.createDataFrame([(1, 1, 3.0)], "i long, j long, v double"), "ij", extents={"i": 2, "j": 2})
    fn = lambda i, j, x, y: x + y + 1
    assert to_numpy(combine("ij", [a, b], fn)).tolist() == [[3, 1], [1, 4]]
    assert combine("ij", [a, b], fn, "outer").df.count() == 2
    assert combine("ij", [a, b], fn, "inner").df.count() == 0


def test_combine_guards(spark):
    a = from_numpy(spark, fill((2, 3), 1, 2), "ij")
    with pytest.raises(ValueError, match="has labels"):
        combine("ij", [a, a.as_("i", "k")], lambda i, j, x, y: x)
    with pytest.raises(ValueError, match="has extents"):
        combine("ij", [a, a.as_("j", "i")], lambda i, j, x, y: x)
    with pytest.raises(ValueError, match="must take 4"):
        combine("ij", [a, a], lambda i, j, x: x)
    with pytest.raises(ValueError, match="needs an operand"):
        combine("ij", [], lambda i, j: i)
    assert combine("ij", [a, a], lambda i, j, x, y: x).df.count() == 6


def test_handle_guards(spark):
    df = spark.createDataFrame([(0, 1, 1.0)], "i long, j long, v double")
    for modes, said in (("ii", "twice"), ("ik", "missing"), (("i", "v"), "both label and value")):
        with pytest.raises(ValueError, match=said):
            Tensor(df, modes)
    with pytest.raises(ValueError, match="needs all its extents"):
        Tensor(df, "ij", dense=True)
    with pytest.raises(ValueError, match="out of range"):
        Tensor(df, "ij", extents={"i": 1, "j": 1}).check()
    with pytest.raises(ValueError, match="twice"):
        Tensor(df.union(df), "ij").check()
    with pytest.raises(ValueError, match="has extents"):
        contract(Tensor(df, "ij", extents={"j": 2}), Tensor(df, "ij", extents={"i": 3}).as_("j", "k"))
    assert Tensor(df, "ij", extents={"i": 1, "j": 2}).check().rank == 2


def test_views(spark):
    a = from_numpy(spark, A, "ijk")
    tiled = tile_view(a, {"i": 4, "k": 2})
    assert tiled.modes == ("i_o", "i_i", "j", "k_o", "k_i") and tiled.extents == {"i_o": 2, "i_i": 4, "j": 4, "k_o": 2, "k_i": 2} and not tiled.dense
    np.testing.assert_allclose(to_numpy(untile(tiled, ["i", "k"], {"i": 6, "k": 3})), A)
    block = subview_tile(tiled, {"i": 1})
    assert block.df.count() == 2 * 4 * 3
    np.testing.assert_allclose(to_numpy(slice_modes(a, {"i": 2, "k": 1})), A[2, :, 1])
    np.testing.assert_allclose(to_numpy(a.permute("k", "i", "j")), A.transpose(2, 0, 1))
    np.testing.assert_allclose(to_numpy(linearise(a)), A.ravel())
    np.testing.assert_allclose(to_numpy(linearise(a, "n", "kij")), A.transpose(2, 0, 1).ravel())
    np.testing.assert_allclose(to_numpy(reshape(a, {"p": 8, "q": 9})), A.reshape(8, 9))
    np.testing.assert_allclose(to_numpy(reshape(a, {"p": 5 + 7, "q": 6}, "kij")), A.transpose(2, 0, 1).reshape(12, 6))
    np.testing.assert_allclose(to_numpy(regroup(a, 1)), A.reshape(6, 12))
    np.testing.assert_allclose(to_numpy(regroup(a, 2)), A.reshape(24, 3))
    for bad, said in ((lambda: reshape(a, {"p": 7}), "elements asked"), (lambda: linearise(a, "n", "ij"), "none of the labels"), (lambda: slice_modes(a, {"i": 6}), "outside"), (lambda: slice_modes(a, {"x": 0}), "no label"), (lambda: regroup(a, 3), "side empty"), (lambda: delinearise(a, {"p": 72}), "rank 1"), (lambda: tile_view(a, {"i": 0}), "block of 0")):
        with pytest.raises(ValueError, match=said):
            bad()


def test_slice_reaches_the_scan(spark, tmp_path):
    write(from_numpy(spark, A, "ijk"), str(tmp_path / "t"))
    t = read(spark, str(tmp_path / "t"), "ijk", extents={"i": 6, "j": 4, "k": 3}, dense=True)
    plan = slice_modes(contract(t, from_numpy(spark, B, "jkl"), "il"), {"i": 3}).df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(i,3)" in plan


@pytest.mark.parametrize("sizes", [{}, {"i": 4, "j": 2, "k": 2, "l": 2}, {"i": 1, "l": 5}])
def test_blocks(spark, sizes):
    a, b = (Blocked.of(from_numpy(spark, x, m), {k: v for k, v in sizes.items() if k in m}) for x, m in ((A, "ijk"), (B, "jkl")))
    np.testing.assert_allclose(to_numpy(a.to_tensor()), A)
    np.testing.assert_allclose(to_numpy(contract_blocked(a, b, "li")), np.einsum("ijk,jkl->li", A, B))


def test_blocks_must_agree(spark):
    a, b = Blocked.of(from_numpy(spark, A, "ijk"), {"j": 2}), Blocked.of(from_numpy(spark, B, "jkl"), {"j": 4})
    with pytest.raises(ValueError, match="blocked differently"):
        contract_blocked(a, b)


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "a", 3.0), (None, "b", 4.0), (2, None, 5.0), (2, "b", None)], "x int, y string, z double")
    assert sorted(map(tuple, from_table(df, {"i": "x", "j": "y"}, "z").df.collect()), key=str) == [(1, "a", 5.0), (2, "b", None)]
    assert from_table(df, {"i": "x"}).df.where("i = 1").collect()[0]["v"] == 2
    assert from_table(df, {"i": "x"}, agg="one").df.where("i = 1").collect()[0]["v"] == 1
    rows = spark.createDataFrame([(7, [1.0, 2.0])], "k long, a array<double>")
    assert sorted(map(tuple, from_array_column(rows, {"w": "k"}, "a", "n", 2).df.collect())) == [(7, 0, 1.0), (7, 1, 2.0)]
    t = from_function(spark, {"i": 2, "j": 3}, lambda i, j: 10 * i + j)
    for kind in ("parquet", "json", "orc"):
        write(t, str(tmp_path / kind), "j", "i", format=kind)
        np.testing.assert_allclose(to_numpy(read(spark, str(tmp_path / kind), "ij", format=kind), (2, 3)), [[0, 1, 2], [10, 11, 12]])
    write_all({"one": t, "two": t}, str(tmp_path / "all"))
    assert spark.read.parquet(str(tmp_path / "all" / "two")).count() == 6


def test_empty_tensor(spark):
    e = Tensor(spark.createDataFrame([], "i long, j long, v double"), "ij", extents={"i": 2, "j": 2})
    assert contract(e, e.as_("j", "k")).df.count() == 0
    assert to_numpy(e.densify()).tolist() == [[0, 0], [0, 0]]
    assert scalar(e, e).df.collect()[0]["v"] == 0
    assert e.df.select(F.sum("v")).collect()[0][0] is None


def test_many_operands_meet_in_one_aggregate(spark):
    xs = [np.arange(12.0).reshape(3, 4) * (k + 1) % 7 for k in range(9)]
    ts = [from_numpy(spark, x, "ij") for x in xs]
    got = combine("ij", ts, lambda i, j, a, b, c, d, e, f, g, h, k: a - b + c - d + e - f + g - h + k + i)
    want = sum((-1) ** k * x for k, x in enumerate(xs)) + np.arange(3)[:, None]
    np.testing.assert_allclose(to_numpy(got), want)
    plan = got.df._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan.replace("Join=", "") and plan.count("Aggregate(") == 2  # before and after one shuffle
    sparse = [Tensor(t.df.where(F.col("i") != k), "ij", t.value, t.extents) for k, t in enumerate(ts[:3])]
    keep = lambda x, k: np.where(np.arange(3)[:, None] == k, 0, x)
    add = lambda i, j, a, b, c: a + 10 * b + 100 * c
    for how in ("outer", "dense"):
        np.testing.assert_allclose(to_numpy(combine("ij", sparse, add, join=how)), keep(xs[0], 0) + 10 * keep(xs[1], 1) + 100 * keep(xs[2], 2))
    assert combine("ij", sparse, add, join="inner").df.count() == 0
    assert combine("ij", [ts[0], ts[1], sparse[1]], add, join="inner").df.count() == 8


def test_a_broadcast_side_keeps_to_its_extents(spark):
    wide = spark.range(100).select("id", F.lit(1.0).alias("v"))
    big = Tensor(spark.range(50).select((F.col("id") % 10).alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v")), "ij")
    assert contract(big, Tensor(wide.withColumnRenamed("id", "i").where("i < 10"), "i", extents={"i": 10}), "j").df.count() == 50
    with pytest.raises(Exception, match="outside of the extents"):
        contract(big, Tensor(wide.withColumnRenamed("id", "i"), "i", extents={"i": 10}), "j").df.count()
    with pytest.raises(ValueError, match="prove it small"):
        contract(big, Tensor(wide.withColumnRenamed("id", "k"), "k"))


def test_strict_reshape():
    from modeloom.operators.views import common_factors

    assert common_factors([4, 6], [8, 3]) == [4, 2, 3]
    assert common_factors([2, 3, 4], [24]) == [2, 3, 4]
    for source, target, said in (([2, 3], [3, 2], "no common"), ([2, 3], [7], "asked"), ([2] * 20, [2] * 20, "the most")):
        with pytest.raises(ValueError, match=said):
            common_factors(source, target)


def test_dot(spark):
    from modeloom.functions import dot

    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0]), ([], []), (None, [1.0]), ([1.0, None], [1.0, 1.0])], "x array<double>, y array<double>")
    assert [r[0] for r in df.select(dot("x", "y")).collect()] == [11.0, 0.0, None, None]
    with pytest.raises(Exception, match="different lengths"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "x array<double>, y array<double>").select(dot("x", "y")).collect()


def test_blocks_are_bounded(spark):
    from modeloom.operators import Blocked

    t = Tensor(spark.range(5).select(F.col("id").alias("i"), F.lit(1.0).alias("v")), "i", extents={"i": 1 << 22})
    with pytest.raises(ValueError, match="are the most"):
        Blocked.of(t, {})
