import numpy as np
import pytest
from pyspark.sql import functions as F

from dense import fill, from_numpy, to_numpy
from modeloom.plans import Dag, Graph, LabelTile, LabelTiles, LabelWhole, LevelGraph, Timings, combination, contraction, input_node, slot, stage
from modeloom.plans.stiffness import fixture, fixture_columns, quadrature, stiffness, stiffness_graph

a, b, e, f = (0.1 * fill(s, 7, 3, mod=11) for s in ((8, 4), (4, 6), (6, 6), (6, 6)))
f = f + np.arange(36).reshape(6, 6)


def nodes(spark):
    return [input_node(from_numpy(spark, x, m)) for x, m in ((a, "ik"), (b, "kl"), (e, "lm"), (f, "lm"))]


def test_trees_and_graphs_agree(spark):
    na, nb, ne, nf = nodes(spark)
    tree = combination([contraction(contraction(na, nb, "il"), ne, "im"), contraction(contraction(na, nb, "il"), nf, "im")], lambda i, m, p, q: 2 * p - 3 * q)
    g, h = Graph().ops(tree)
    want = 2 * (a @ b @ e) - 3 * (a @ b @ f)
    np.testing.assert_allclose(to_numpy(g.execute()[0]), want)
    d, ab = Dag().add(contraction(na, nb, "il"))
    d, p = d.add(contraction(ab.read(), ne, "im"))
    d, q = d.add(contraction(ab.read(), nf, "im"))
    d, out = d.add(combination([p.read(), q.read()], lambda i, m, p, q: 2 * p - 3 * q))
    for persist in (False, True):
        with d.outputs(out, ab).execute(persist) as run:
            np.testing.assert_allclose(to_numpy(run[0]), want)
            np.testing.assert_allclose(to_numpy(run[1]), a @ b)
            assert len(run.kept) == persist
    assert h.modes == ("i", "m") and abs(want).max() > 1


def test_outputs_share_one_pass(spark):
    na, *_ = nodes(spark)
    d, plus, minus = Dag().add(combination([na], lambda i, k, v: [v + i, v - k], outputs=2))
    d, out = d.add(combination([minus.as_("i", "k"), plus.as_("i", "k")], lambda i, k, x, y: x * y))
    i, k = np.indices(a.shape)
    np.testing.assert_allclose(to_numpy(d.outputs(out).execute()[0]), (a - k) * (a + i))
    d, turned = d.add(combination([plus.as_("k", "i")], lambda k, i, v: v))
    np.testing.assert_allclose(to_numpy(d.outputs(turned).execute()[0]), a + i)


def test_liveness():
    n = lambda s, *r: combination([slot(x, "i", {"i": 4}) for x in r] or [slot(0, "i")], lambda *x: x[0])
    from modeloom.plans.graph import Node

    leaf = Node("input", ("i",), {"i": 4})
    d, s0 = Dag().add(leaf)
    for k in range(3):
        d, last = d.add(n(k, k))
    d = d.outputs(last)
    assert d.live() == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert d.pools() == [0, 1, 0, 1] and d.estimate() == {"slots": 128, "pools": 64, "num_pools": 2, "operands": 32, "all": 96}
    assert d.readers() == [1, 1, 1, 0]


def test_a_shared_result_is_made_once(spark, tmp_path):
    """Each table is read once, and what was kept is let go with the DataFrame that holds it."""
    import gc

    from modeloom import queries

    cached = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    gc.collect()
    before = cached()
    df = queries.dag_diamond(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InMemoryTableScan") == 2  # both readers find the shared result
    df.collect()
    assert cached() == before + 1
    assert spark.sparkContext._jsc.getPersistentRDDs().size() >= 1
    del df
    gc.collect()
    assert cached() == before


def test_results_are_released_after_their_last_reader(spark):
    na, nb, ne, _ = nodes(spark)
    d, last = Dag().add(contraction(na, nb, "il"))
    want = a @ b
    for k in range(5):
        d, last = d.add(combination([last.read()], lambda i, l, v: v + 1))
        want = want + 1
    d, out = d.add(contraction(last.read(), ne, "im"))
    d = d.outputs(out)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    with d.execute(release=True) as run:
        np.testing.assert_allclose(to_numpy(run[0]), want @ e)
        assert run.most_kept == d.estimate()["num_pools"] == 2 and len(run.kept) == 1
        assert spark.sparkContext._jsc.getPersistentRDDs().size() == before + 1
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_tasks_of_a_run(spark):
    na, nb, *_ = nodes(spark)
    d, x = Dag().add(stage(na))
    d, out = d.add(combination([x.read()], lambda i, k, v: 2 * v))
    for n in (1, 3):
        with d.outputs(out).tasks(n).execute() as run:
            assert run[0].df.rdd.getNumPartitions() == n
            np.testing.assert_allclose(to_numpy(run[0]), 2 * a)
    with pytest.raises(ValueError, match="0 tasks"):
        d.tasks(0)


def test_levels_work_within_their_tasks(spark):
    """Staged inputs are dealt by the label that is cut; nothing after that is shuffled."""
    h = 0.1 + 0.3 * np.indices((5, 5))[0]
    u = fill((6, 5, 5), 1, 2, 3, mod=7, scale=0.1)
    g = LevelGraph(LabelTiles(LabelTile("e", 2), *[LabelWhole(x, 5) for x in "abq"]))
    g, nu = g.add(stage(from_numpy(spark, u, "eab")))
    g, ga, gb = g.add(contraction(nu.as_("e", "a", "b"), input_node(from_numpy(spark, h, "qa")), "eqb"), contraction(nu.as_("e", "b", "a"), input_node(from_numpy(spark, h, "qa")), "ebq"))
    g, out = g.add(combination([ga.as_("e", "a", "b"), gb.as_("e", "a", "b")], lambda e, a, b, x, y: x + y))
    with g.outputs(ga).execute() as run:
        np.testing.assert_allclose(to_numpy(run[0]), np.einsum("qa,eab->eqb", h, u))
        ran = run[0].df._jdf.queryExecution().executedPlan().toString().split("\n+- == Initial Plan ==")[0]
        assert "ENSURE_REQUIREMENTS" not in ran and "REPARTITION_BY_NUM" in ran
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # joins, too
    with g.outputs(out).execute() as run:
        assert run.kept[0].rdd.getNumPartitions() == g.work_items() == 3
        np.testing.assert_allclose(to_numpy(run[0]), np.einsum("qa,eab->eqb", h, u) + np.einsum("qa,eba->ebq", h, u))
        ran = run[0].df._jdf.queryExecution().executedPlan().toString().split("\n+- == Initial Plan ==")[0]
        assert "ENSURE_REQUIREMENTS" not in ran and "REPARTITION_BY_NUM" in ran
    spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")


def test_flat_blocks(spark):
    na, nb, ne, _ = nodes(spark)
    g, _ = Graph().ops(contraction(contraction(na, nb, "il"), ne.as_("l", "m"), "im", lambda i, m, v: v + i))
    outer_, inner = {"i": 4, "l": 3, "m": 2}, {"i": 4, "k": 3, "l": 3}
    np.testing.assert_allclose(to_numpy(g.execute_flat([outer_, inner])), a @ b @ e + np.arange(8)[:, None])
    for bad, said in (([outer_], "more contractions"), ([outer_, inner, inner], "left over")):
        with pytest.raises(ValueError, match=said):
            g.execute_flat(bad)
    with pytest.raises(ValueError, match="not combine"):
        Graph().ops(combination([na], lambda i, k, v: v))[0].execute_flat([{}])


def test_graph_guards(spark):
    na, *_ = nodes(spark)
    with pytest.raises(ValueError, match="before it is made"):
        Dag().add(combination([slot(0, "ik")], lambda i, k, v: v))
    with pytest.raises(ValueError, match="no outputs"):
        Dag().add(na)[0].execute()
    with pytest.raises(ValueError, match="rank 2"):
        Dag().add(na)[1].as_("i")
    with pytest.raises(ValueError, match="announced"):
        g, *_ = Graph().ops(combination([na], lambda i, k, v: [v], outputs=2))
        g.execute()
    assert Dag().add(na)[1].as_("x", "y").modes == ("x", "y")


def test_levels(spark):
    h = 0.1 + 0.3 * np.indices((5, 5))[0] - 0.2 * np.indices((5, 5))[1] + 0.05 * np.prod(np.indices((5, 5)), 0)
    u = fill((4, 5, 5), 1, 2, 3, mod=7, scale=0.1)
    g = LevelGraph(LabelTiles(LabelTile("e", 3), *[LabelWhole(x, 5) for x in "abq"]))
    g, nu, nh = g.add(stage(from_numpy(spark, u, "eab")), stage(from_numpy(spark, h, "qa")))
    g, ga, gb = g.add(contraction(nu.as_("e", "a", "b"), nh.read(), "eqb"), contraction(nu.as_("e", "b", "a"), nh.read(), "ebq"))
    g, out = g.add(combination([ga.as_("e", "a", "b"), gb.as_("e", "a", "b")], lambda e, a, b, x, y: 2 * x + y + 1000 * e + 10 * a + b))
    i, x, y = np.indices(u.shape)
    want = 2 * np.einsum("qa,eab->eqb", h, u) + np.einsum("qa,eba->ebq", h, u) + 1000 * i + 10 * x + y
    with g.outputs(out).execute() as run:
        np.testing.assert_allclose(to_numpy(run[0]), want)
    assert g.grid() == {"e": 2} and g.work_items() == 2


def test_level_guards(spark):
    na, nb, *_ = nodes(spark)
    tiles = LabelTiles(*[LabelWhole(x, 9) for x in "iklm"])
    g = LevelGraph(tiles)
    with pytest.raises(ValueError, match="empty"):
        g.add()
    with pytest.raises(ValueError, match="mixes"):
        g.add(stage(na), combination([na], lambda i, k, v: v))
    with pytest.raises(ValueError, match="iteration space"):
        g.add(combination([na], lambda i, k, v: v), combination([nb], lambda k, l, v: v))
    with pytest.raises(ValueError, match="later one makes"):
        g.add(combination([slot(0, "ik", {"i": 8, "k": 4})], lambda i, k, v: v))
    with pytest.raises(ValueError, match="not in the map"):
        LevelGraph(LabelTiles(LabelTile("i", 2))).add(stage(na))
    with pytest.raises(ValueError, match="more than 3"):
        LevelGraph(LabelTiles(LabelWhole("i", 3), LabelWhole("k", 4))).add(stage(na))
    with pytest.raises(ValueError, match="twice"):
        LabelTiles(LabelTile("i", 2), LabelWhole("i", 2))
    assert len(g.add(stage(na), stage(nb))) == 3


@pytest.mark.parametrize("axes", [["x", "z"], ["i", "j", "k"]])
def test_stiffness_against_numpy(spark, axes):
    n, points, elements = len(axes), 4, 3
    fields, *matrices = fixture(spark.range(elements).withColumnRenamed("id", "e"), points, axes)
    got = stiffness(fields, "e", axes, *matrices)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = got.toPandas()
    grid = dict(zip(["e", *axes], np.indices((elements, *[points] * n))))
    calc = lambda text: np.array(eval(text, {}, grid), float)
    v = {k: np.broadcast_to(calc(x), grid["e"].shape) for k, x in fixture_columns(axes).items()}
    _, w, h = quadrature(points)
    move = lambda m, x, d: np.moveaxis(np.tensordot(m, x, (1, d + 1)), 0, d + 1)
    grad = np.array([[move(h, v[f"u{c}"], d) for d in range(n)] for c in range(n)])
    metric = np.array([[v[f"m{d}{x}"] for x in range(n)] for d in range(n)])
    ds = np.einsum("cd...,dx...->cx...", grad, metric)
    lam = v["modulus"] - 2 * v["mu"]
    sigma = v["mu"] * (ds + ds.swapaxes(0, 1))
    trace = sum(ds[c, c] for c in range(n))
    for c in range(n):
        sigma[c, c] = v["modulus"] * ds[c, c] + lam * (trace - ds[c, c])
    flux = v["jac"] * np.einsum("cx...,dx...->dc...", sigma, metric)
    at = tuple(got[x].to_numpy() for x in ["e", *axes])
    for c in range(n):
        want = 0
        for d in range(n):
            t = move((h * w[:, None]).T, flux[d, c], d)
            for k in range(n):
                if k != d:
                    t = t * w.reshape([-1 if x == k + 1 else 1 for x in range(n + 1)])
            want = want + t
        np.testing.assert_allclose(got[f"f{c}"], want[at], rtol=1e-9)


@pytest.mark.parametrize("points", [2, 3, 5, 8])
def test_quadrature(points):
    """Weights integrate, and the matrix differentiates, polynomials exactly."""
    x, w, h = quadrature(points)
    for k in range(points):
        np.testing.assert_allclose(h @ x**k, k * x ** max(k - 1, 0), atol=1e-9)
    for k in range(2 * points - 2):
        np.testing.assert_allclose(w @ x**k, (1 + (-1) ** k) / (k + 1), atol=1e-9)


def test_the_stiffness_graph_gives_the_same_by_rows_and_by_elements(spark):
    axes = ["x", "z"]
    fields, *matrices = fixture(spark.range(3).withColumnRenamed("id", "e"), 3, axes)
    graph = stiffness_graph(fields, "e", axes, *matrices, elements=3)
    assert [len(x) for x in graph.levels] == [2 + 4 + 3 + 2, 4, 1, 4, 2]
    local = {tuple(r[:3]): r[3:] for r in map(tuple, graph.execute_local(["f0", "f1"]).collect())}
    with graph.execute() as run:
        for c, t in enumerate(run):
            rows = {tuple(r[m] for m in ("e", *axes)): r[t.value] for r in t.df.collect()}
            assert rows.keys() == local.keys()
            for at, v in rows.items():
                np.testing.assert_allclose(v, local[at][c], rtol=1e-9, atol=1e-12)


def test_stiffness_refuses_wrong_coordinates(spark):
    axes = ["x", "z"]
    fields, *matrices = fixture(spark.range(3).withColumnRenamed("id", "e"), 4, axes)
    moved = fields.withColumn("z", F.when((F.col("e") == 1) & (F.col("x") == 0), F.col("z") + 1).otherwise(F.col("z")))
    with pytest.raises(Exception, match="outside of 4 points"):
        stiffness(moved, "e", axes, *matrices).collect()
    with pytest.raises(Exception, match="occurs twice"):
        stiffness(fields.unionByName(fields.where("e = 2 and x = 1 and z = 1")), "e", axes, *matrices).collect()
    some = stiffness(fields.where("not (e = 1 and x = 2)"), "e", axes, *matrices)
    assert some.count() == 3 * 16 and stiffness(fields.limit(0), "e", axes, *matrices).count() == 0


@pytest.mark.parametrize("name", ["sem2d_force", "sem3d_force"])
def test_elements_are_dealt_before_their_points_are_made(spark, name):
    from modeloom import queries

    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("Sort [") == 1 and 0 < plan.index("Generate") < plan.index("Sort [") < plan.index("Exchange")
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_dealt_elements(spark):
    """The same forces, to the last bit, as from points that are shuffled; order and repeats are tested."""
    from modeloom.plans.local import deal

    axes = ["x", "z"]
    elements = spark.range(0, 4000, 7).select((1000 - F.col("id")).alias("e"), (F.col("id") % 25).cast("int").alias("kind"))
    fields, *matrices = fixture(elements, 8, axes, kind="kind")
    dealt = lambda rows: stiffness(fixture(deal(rows, "e"), 8, axes, kind="kind")[0], "e", axes, *matrices, dealt=True)
    want, got = (x.orderBy("e", *axes).toPandas() for x in (stiffness(fields, "e", axes, *matrices), dealt(elements)))
    assert len(got) == 572 * 64 and got.equals(want)
    assert dealt(elements.limit(0)).count() == 0
    with pytest.raises(Exception, match="occurs twice"):
        dealt(elements.union(elements.where("e = -1772"))).collect()
    for rows in (fields.coalesce(1).orderBy(F.desc("e")), fields.coalesce(1).orderBy("x", "z", "e")):
        with pytest.raises(Exception, match="not in the order of 'e'"):
            stiffness(rows, "e", axes, *matrices, dealt=True).collect()


@pytest.mark.parametrize("axes", [["x", "z"], ["i", "j", "k"]])
def test_fields_are_those_of_decimals(spark, axes):
    elements = spark.range(-30, 40).select(F.col("id").alias("e"), (F.col("id") % 25).cast("int").alias("kind"))
    fields = fixture(elements, 5, axes, kind="kind")[0]
    columns = fixture_columns(axes, kind="kind")
    decimals = elements.join(fields.select("e", *axes), "e").select("e", *axes, *[F.expr(f"cast({x} as double)").alias(k) for k, x in columns.items()])
    got, want = (x.orderBy("e", *axes).toPandas() for x in (fields, decimals))
    assert len(got) == 70 * 5 ** len(axes) and got.equals(want) and (got.dtypes[list(columns)] == float).all()


def test_local_graphs(spark):
    """Hooks, coordinates, shared results, label orders and captured weights, on arrays as on rows."""
    from modeloom.plans.local import columns_of
    from modeloom.tensor import Tensor

    rng = np.random.default_rng(1)
    x, y, m, w = rng.normal(size=(7, 3, 4)), rng.normal(size=(7, 3, 4)), rng.normal(size=(5, 4)), rng.normal(size=3)
    rows = [(int(e) * 10 - 20, int(i), int(k), float(x[e, i, k]), float(y[e, i, k])) for e, i, k in np.ndindex(7, 3, 4)]
    df = spark.createDataFrame(rows, "e long, i long, k long, x double, y double").repartition(3)
    tx, ty = columns_of(df, ["e", "i", "k"], ["x", "y"], {"i": 3, "k": 4})
    g = LevelGraph(LabelTiles(LabelTile("e", 2), LabelWhole("i", 3), LabelWhole("k", 4), LabelWhole("j", 5)))
    g, a, b, c = g.add(stage(input_node(tx, lambda e, i, k, v: v + e * i - k)), stage(ty), stage(from_numpy(spark, m, "jk")))
    g, p, q = g.add(contraction(a.read(), c.read(), ("e", "j", "i"), lambda e, j, i, v: v * (j + 1) + e), contraction(c.read(), b.read(), ("e", "j", "i")))
    g, r, s = g.add(combination([p.read(), q.read()], lambda e, j, i, u, v, t: [u * t + v, u - i * v], outputs=2, weights=[from_numpy(spark, w, "i")]))
    g, out = g.add(combination([r.as_("e", "j", "i"), s.read(), p.read()], lambda e, i, j, u, v, t: u * v - t + j, out=("e", "i", "j")))
    got = {tuple(v[:3]): v[3] for v in map(tuple, g.outputs(out).execute_local(["v"]).collect())}
    e, i, k = np.arange(7) * 10 - 20, np.arange(3), np.arange(4)
    pa_ = np.einsum("eik,jk->eji", x + e[:, None, None] * i[:, None] - k, m) * (np.arange(5) + 1)[:, None] + e[:, None, None]
    qa = np.einsum("eik,jk->eji", y, m)
    want = ((pa_ * w + qa) * (pa_ - i * qa) - pa_ + np.arange(5)[:, None]).swapaxes(1, 2)
    assert len(got) == want.size
    for at in np.ndindex(want.shape):
        np.testing.assert_allclose(got[at[0] * 10 - 20, at[1], at[2]], want[at], rtol=1e-9)
    with pytest.raises(ValueError, match="one table"):
        other = Tensor(df.select("e", "i", "k", F.col("y").alias("v")), ("e", "i", "k"), "v", {"i": 3, "k": 4})
        h, a, b = LevelGraph(g.tiles).add(stage(tx), stage(other))
        h, out = h.add(combination([a.read(), b.read()], lambda e, i, k, u, v: u + v))
        h.outputs(out).execute_local(["v"])
    with pytest.raises(ValueError, match="sums the label"):
        h, a, b = LevelGraph(g.tiles).add(stage(tx), stage(ty))
        h, out = h.add(contraction(a.read(), b.as_("e", "j", "k"), ("i", "j")))
        h.outputs(out).execute_local(["v"])


def test_stream(spark, tmp_path):
    from modeloom.streaming import contract_stream
    from modeloom.tensor import Tensor

    rows = spark.range(60).select((F.col("id") % 5).alias("u"), (F.col("id") % 3).alias("t"), F.lit(1).cast("long").alias("v"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    w = Tensor(spark.createDataFrame([(0, 1), (1, 10), (2, 100)], "t long, v long"), ("t",), extents={"t": 3})
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for kind, extra in (("plain", {}), ("windowed", {"event_time": "ts", "window": "30 minutes"})):
        if kind == "plain":
            from modeloom.streaming import settled

            assert dict(settled(contract_stream(stream, ("u", "t"), w, ("u",))).collect()) == {u: sum(10 ** (k % 3) for k in range(60) if k % 5 == u) for u in range(5)}
        q = contract_stream(stream, ("u", "t"), w, ("u",), **extra).writeStream.format("memory").queryName(kind).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination()
        got = dict(spark.table(kind).groupBy("u").agg(F.sum("v")).collect())
        assert got == {u: sum(10 ** (k % 3) for k in range(60) if k % 5 == u) for u in range(5)}


def test_timings():
    t = Timings()
    for _ in range(2):
        with t.scope("x"):
            pass
    assert t.report()["x"]["count"] == 2 and t.report()["x"]["min"] <= t.report()["x"]["max"]
