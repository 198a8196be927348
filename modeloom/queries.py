"""Registered queries over the supplied tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modeloom.operators import (
    Blocked,
    apply_hook,
    combine,
    combine_multi,
    contract,
    contract_blocked,
    delinearise,
    einsum,
    linearise,
    outer,
    reduce_modes,
    regroup,
    reshape,
    scalar,
    slice_modes,
    subview_tile,
    tile_view,
    untile,
)
from modeloom.functions import dot
from modeloom.plans import Dag, Graph, LabelTile, LabelTiles, LabelWhole, LevelGraph, combination, contraction, input_node, kept, stage
from modeloom.plans.local import deal
from modeloom.plans.stiffness import fixture, stiffness, stiffness_sql
from modeloom.sources import from_array_column, from_function, from_table
from modeloom.streaming import contract_stream, settled
from modeloom.tensor import Tensor

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


# -- tensors of the tables, and the same as SQL


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def quantity(spark, sf) -> Tensor:
    return from_table(table(spark, sf, "lineitem"), {"s": "l_suppkey", "p": "l_partkey"}, "l_quantity", kind="bigint")


def sizes(spark, sf) -> Tensor:
    return from_table(table(spark, sf, "part"), {"p": "p_partkey", "z": "p_size"})


def brands(spark, sf) -> Tensor:
    return from_table(table(spark, sf, "part"), {"p": "p_partkey", "b": "p_brand"})


def supplier_nations(spark, sf) -> Tensor:
    return from_table(table(spark, sf, "supplier"), {"s": "s_suppkey", "n": "s_nationkey"})


def flags(spark, sf) -> Tensor:
    return from_table(table(spark, sf, "lineitem"), {"p": "l_partkey", "rf": "l_returnflag", "ls": "l_linestatus"}, "l_quantity", kind="bigint")


def customers(spark, sf) -> Tensor:
    return from_table(table(spark, sf, "customer"), {"c": "c_custkey", "n": "c_nationkey"})


def priorities(spark, sf) -> Tensor:
    return from_table(table(spark, sf, "orders"), {"c": "o_custkey", "pri": "o_orderpriority"})


def regions(spark, sf) -> Tensor:
    return from_table(table(spark, sf, "nation"), {"n": "n_nationkey", "r": "n_regionkey"})


BOX = {"m": 12, "d": 7}


def months(spark, sf, value="l_quantity", agg="sum") -> Tensor:
    """Quantity (or another value) by month and line number: a small box of coordinates."""
    rows = table(spark, sf, "lineitem").where("l_linenumber between 1 and 7")
    return from_table(rows, {"m": (F.month("l_shipdate") - 1).cast("long"), "d": (F.col("l_linenumber") - 1).cast("long")}, value, agg, "bigint", BOX)


def embeddings(spark, sf) -> Tensor:
    return from_array_column(table(spark, sf, "embeddings"), {"w": "vec_id"}, "embedding", "k", 64)


def dense_embeddings(spark, sf) -> Tensor:
    rows = table(spark, sf, "embeddings")
    n = rows.agg(F.max("vec_id")).first()[0] + 1
    t = from_array_column(rows, {"w": "vec_id"}, "embedding", "k", 64, extents={"w": n})
    return Tensor(t.df, t.modes, t.value, t.extents)


Q = "(SELECT l_suppkey AS s, l_partkey AS p, CAST(SUM(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY ALL)"
Z = "(SELECT p_partkey AS p, p_size AS z, COUNT(*) AS v FROM part GROUP BY ALL)"
BR = "(SELECT p_partkey AS p, p_brand AS b, COUNT(*) AS v FROM part GROUP BY ALL)"
S = "(SELECT s_suppkey AS s, s_nationkey AS n, COUNT(*) AS v FROM supplier GROUP BY ALL)"
FL = "(SELECT l_partkey AS p, l_returnflag AS rf, l_linestatus AS ls, CAST(SUM(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY ALL)"
CN = "(SELECT c_custkey AS c, c_nationkey AS n, COUNT(*) AS v FROM customer GROUP BY ALL)"
OP = "(SELECT o_custkey AS c, o_orderpriority AS pri, COUNT(*) AS v FROM orders GROUP BY ALL)"
RG = "(SELECT n_nationkey AS n, n_regionkey AS r, COUNT(*) AS v FROM nation GROUP BY ALL)"
EM = "(SELECT vec_id AS w, CAST(unnest(range(len(embedding))) AS BIGINT) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
GRID = "(SELECT a.m, b.d FROM range(12) a(m) CROSS JOIN range(7) b(d))"


def month_sql(value: str) -> str:
    """A dense box of an aggregate by month and line number."""
    return f"(SELECT m, d, COALESCE(v, 0) AS v FROM {GRID} LEFT JOIN (SELECT CAST(month(l_shipdate) - 1 AS BIGINT) AS m, CAST(l_linenumber - 1 AS BIGINT) AS d, CAST({value} AS BIGINT) AS v FROM lineitem WHERE l_linenumber BETWEEN 1 AND 7 GROUP BY ALL) USING (m, d))"


A, B, C = month_sql("SUM(l_quantity)"), month_sql("COUNT(*)"), month_sql("MAX(l_quantity)")
TOTAL = "CAST(SUM({}) AS BIGINT) AS v"
PRODUCT = TOTAL.format("x.v * y.v")


# -- contraction


@query(f"SELECT s, z, {PRODUCT} FROM {Q} x JOIN {Z} y USING (p) GROUP BY ALL")
def contract_matmul(spark, sf):
    return contract(quantity(spark, sf), sizes(spark, sf), ("s", "z")).to_df()


@query(f"SELECT p, ln, {PRODUCT} FROM {FL} x JOIN (SELECT l_returnflag AS rf, l_linestatus AS ls, l_linenumber AS ln, COUNT(*) AS v FROM lineitem GROUP BY ALL) y USING (rf, ls) GROUP BY ALL")
def contract_multi_label(spark, sf):
    lines = from_table(table(spark, sf, "lineitem"), {"rf": "l_returnflag", "ls": "l_linestatus", "ln": "l_linenumber"})
    return contract(flags(spark, sf), lines, ("p", "ln")).to_df()


@query(f"SELECT rf, ls, b, {PRODUCT} FROM {FL} x JOIN {BR} y USING (p) GROUP BY ALL")
def contract_multi_free(spark, sf):
    return contract(flags(spark, sf), brands(spark, sf)).to_df()


@query(f"SELECT ls, b, rf, {PRODUCT} FROM {FL} x JOIN {BR} y USING (p) GROUP BY ALL")
def contract_permuted(spark, sf):
    return contract(brands(spark, sf).permute("b", "p"), flags(spark, sf).permute("ls", "p", "rf"), ("ls", "b", "rf")).to_df()


@query(f"SELECT z, s, {PRODUCT} FROM {Q} x JOIN {Z} y USING (p) GROUP BY ALL")
def contract_output_order(spark, sf):
    return contract(quantity(spark, sf), sizes(spark, sf), ("z", "s")).to_df()


CHAIN = f"SELECT n, b, {PRODUCT} FROM (SELECT s, b, SUM(x.v * y.v) AS v FROM {Q} x JOIN {BR} y USING (p) GROUP BY ALL) x JOIN {S} y USING (s) GROUP BY ALL"


@query(CHAIN)
def contract_chain(spark, sf):
    return contract(contract(quantity(spark, sf), brands(spark, sf), ("s", "b")), supplier_nations(spark, sf), ("n", "b")).to_df()


@query(f"SELECT n, c, {PRODUCT} FROM (SELECT n, p, SUM(x.v * y.v) AS v FROM {S} x JOIN {Q} y USING (s) GROUP BY ALL) x JOIN (SELECT p, c, SUM(x.v * y.v) AS v FROM {Z} x JOIN (SELECT z, z % 7 AS c, 1 AS v FROM range(51) r(z)) y USING (z) GROUP BY ALL) y USING (p) GROUP BY ALL")
def contract_both_nested(spark, sf):
    groups = Tensor(spark.range(51).select(F.col("id").alias("z"), (F.col("id") % 7).alias("c"), F.lit(1).cast("long").alias("v")), ("z", "c"), extents={"z": 51, "c": 7})
    left = contract(supplier_nations(spark, sf), quantity(spark, sf), ("n", "p"))
    return contract(left, contract(sizes(spark, sf), groups, ("p", "c")), ("n", "c")).to_df()


@query(f"SELECT x.k, y.k AS l, ROUND(SUM(x.x * y.x), 6) AS v FROM {EM} x JOIN {EM} y USING (w) GROUP BY ALL")
def gram_embeddings(spark, sf):
    e = embeddings(spark, sf)
    return contract(e, e.as_("w", "l"), ("k", "l"), lambda k, l, v: F.round(v, 6)).to_df()


@query(f"SELECT label AS c, k, ROUND(SUM(x), 6) AS v FROM {EM} e JOIN embeddings ON e.w = vec_id GROUP BY ALL")
def contract_one_hot(spark, sf):
    onehot = from_table(table(spark, sf, "embeddings"), {"w": "vec_id", "c": "label"})
    return contract(onehot, embeddings(spark, sf), ("c", "k"), lambda c, k, v: F.round(v, 6)).to_df()


# -- hooks


@query(f"SELECT s, z, {TOTAL.format('3 * x.v * y.v')} FROM {Q} x JOIN {Z} y USING (p) GROUP BY ALL")
def hook_input_scale(spark, sf):
    a = input_node(quantity(spark, sf), lambda s, p, v: v * 3)
    return Graph().ops(contraction(a, input_node(sizes(spark, sf)), ("s", "z")))[0].execute()[0].to_df()


@query(f"SELECT s, z, {TOTAL.format('(x.v + x.p % 10) * y.v')} FROM {Q} x JOIN {Z} y USING (p) GROUP BY ALL")
def hook_input_coord(spark, sf):
    a = input_node(quantity(spark, sf), lambda s, p, v: v + p % 10)
    return Graph().ops(contraction(a, input_node(sizes(spark, sf)), ("s", "z")))[0].execute()[0].to_df()


@query(f"SELECT s, z, 100 * s + z + v AS v FROM (SELECT s, z, {PRODUCT} FROM {Q} x JOIN {Z} y USING (p) GROUP BY ALL)")
def hook_store(spark, sf):
    node = contraction(input_node(quantity(spark, sf)), input_node(sizes(spark, sf)), ("s", "z"), lambda s, z, v: 100 * s + z + v)
    return Graph().ops(node)[0].execute()[0].to_df()


@query(f"SELECT z, s, {TOTAL.format('x.v * (y.v + 1000 * y.z)')} FROM {Q} x JOIN {Z} y USING (p) GROUP BY ALL")
def hook_permuted(spark, sf):
    return contract(quantity(spark, sf), apply_hook(sizes(spark, sf).permute("z", "p"), lambda z, p, v: v + 1000 * z), ("z", "s")).to_df()


# -- combination


@query(f"SELECT m, d, x.v * y.v + 100 * m + d AS v FROM {A} x JOIN {B} y USING (m, d)")
def combine_binary(spark, sf):
    return combine(("m", "d"), [months(spark, sf), months(spark, sf, None)], lambda m, d, x, y: x * y + 100 * m + d).to_df()


@query(f"SELECT d, m, x.v + y.v AS v FROM {A} x JOIN (SELECT m AS d, d AS m, v FROM {B} WHERE m < 7 AND d < 7) y USING (m, d)")
def combine_permuted(spark, sf):
    a = months(spark, sf).densify()
    b = Tensor(months(spark, sf, None).densify().df.where("m < 7"), ("m", "d"), extents={"m": 7, "d": 7}, dense=True).as_("d", "m")
    cut = Tensor(a.df.where("m < 7"), ("m", "d"), extents={"m": 7, "d": 7}, dense=True)
    return combine(("d", "m"), [cut, b], lambda d, m, x, y: x + y).to_df()


@query(f"SELECT m, d, x.v * y.v + z.v + 100 * m + d AS v FROM {A} x JOIN {B} y USING (m, d) JOIN {C} z USING (m, d)")
def combine_ternary(spark, sf):
    parts = [months(spark, sf), months(spark, sf, None).permute("d", "m"), months(spark, sf, agg="max")]
    return combine(("m", "d"), parts, lambda m, d, x, y, z: x * y + z + 100 * m + d).to_df()


@query(f"SELECT s, p, 2 * v + 5 AS v FROM {Q}")
def combine_unary(spark, sf):
    return combine(("s", "p"), [quantity(spark, sf)], lambda s, p, v: 2 * v + 5, "inner").to_df()


@query(f"SELECT m, d, 1000 * m + 10 * d + v % 10 AS v FROM {A}")
def combine_coord(spark, sf):
    return combine(("m", "d"), [months(spark, sf)], lambda m, d, v: 1000 * m + 10 * d + v % 10).to_df()


@query(f"SELECT m, d, x.v * y.v AS v0, x.v - y.v + (m - d) AS v1 FROM {A} x JOIN {B} y USING (m, d)")
def combine_multi_output(spark, sf):
    return combine_multi(("m", "d"), [months(spark, sf), months(spark, sf, None)], lambda m, d, x, y: [x * y, x - y + (m - d)])[0].frame


SZ = f"(SELECT s, z, CAST(SUM(x.v * y.v) AS BIGINT) AS v, CAST(SUM(y.v) AS BIGINT) AS w FROM {Q} x JOIN {Z} y USING (p) GROUP BY ALL)"


@query(f"SELECT z, s, v - 10 * w AS v FROM {SZ}")
def combine_over_contraction(spark, sf):
    p, z = quantity(spark, sf), sizes(spark, sf)
    ones = apply_hook(p, lambda s, p, v: F.lit(1).cast("long"))
    return combine(("z", "s"), [contract(p, z, ("s", "z")), contract(ones, z, ("z", "s"))], lambda z, s, a, b: a - 10 * b, "outer").to_df()


@query(f"SELECT s, b, {TOTAL.format('(x.v * x.v + x.p % 3) * y.v')} FROM {Q} x JOIN {BR} y USING (p) GROUP BY ALL")
def contraction_over_combine(spark, sf):
    squared = combine(("s", "p"), [quantity(spark, sf)], lambda s, p, v: v * v + p % 3, "inner")
    return contract(squared, brands(spark, sf), ("s", "b")).to_df()


@query(f"SELECT m, d, (x.v + y.v) * z.v - m AS v FROM {A} x JOIN {B} y USING (m, d) JOIN {C} z USING (m, d)")
def combine_over_combine(spark, sf):
    inner = combine(("m", "d"), [months(spark, sf), months(spark, sf, None)], lambda m, d, x, y: x + y)
    return combine(("m", "d"), [inner, months(spark, sf, agg="max")], lambda m, d, x, z: x * z - m).to_df()


@query(f"SELECT m, d, v * (3 * d + 2) AS v FROM {A}")
def combine_captured_weights(spark, sf):
    w = from_function(spark, {"d": 7}, lambda d: 3 * d + 2, "bigint")
    return combine(("m", "d"), [months(spark, sf)], lambda m, d, v, w: v * w, weights=[w]).to_df()


# -- density


@query(f"SELECT m, d, v FROM {A}")
def densify(spark, sf):
    return months(spark, sf).densify().to_df()


@query("SELECT COALESCE(x.c, y.c) AS c, COALESCE(x.v, 0) - COALESCE(y.v, 0) AS v FROM (SELECT c_custkey AS c, COUNT(*) AS v FROM customer GROUP BY ALL) x FULL JOIN (SELECT o_custkey AS c, COUNT(*) AS v FROM orders GROUP BY ALL) y ON x.c = y.c")
def combine_outer(spark, sf):
    a = from_table(table(spark, sf, "customer"), {"c": "c_custkey"})
    b = from_table(table(spark, sf, "orders"), {"c": "o_custkey"})
    return combine(("c",), [a, b], lambda c, x, y: x - y, "outer").to_df()


@query(f"SELECT m, d, x.v + 7 * (y.v + m) AS v FROM {month_sql('SUM(l_quantity)').replace('lineitem', '(SELECT * FROM lineitem WHERE l_discount > 0.09 AND l_quantity > 49)')} x JOIN {month_sql('COUNT(*)').replace('lineitem', '(SELECT * FROM lineitem WHERE l_tax > 0.07 AND l_quantity < 2)')} y USING (m, d)")
def combine_dense_outer(spark, sf):
    rows = table(spark, sf, "lineitem").where("l_linenumber between 1 and 7")
    labels = {"m": (F.month("l_shipdate") - 1).cast("long"), "d": (F.col("l_linenumber") - 1).cast("long")}
    a = from_table(rows.where("l_discount > 0.09 and l_quantity > 49"), labels, "l_quantity", kind="bigint", extents=BOX)
    b = from_table(rows.where("l_tax > 0.07 and l_quantity < 2"), labels, extents=BOX)
    return combine(("m", "d"), [a, b], lambda m, d, x, y: x + 7 * (y + m)).to_df()


# -- views


@query(f"SELECT w, k // 8 AS k_o, k % 8 AS k_i, x FROM {EM}")
def view_tile(spark, sf):
    return tile_view(embeddings(spark, sf), {"k": 8}).to_df(value="x")


@query(f"SELECT w, k % 5 AS k_i, x FROM {EM} WHERE k // 5 = 12")
def view_subview_tile(spark, sf):
    return subview_tile(tile_view(embeddings(spark, sf), {"k": 5}), {"k": 12}).to_df(value="x")


@query(f"SELECT w, k, x FROM {EM}")
def view_untile(spark, sf):
    return untile(tile_view(embeddings(spark, sf), {"k": 5}), ["k"], {"k": 64}).to_df(value="x")


@query(f"SELECT w * 64 + k AS n, x FROM {EM}")
def view_reshape_flat(spark, sf):
    return linearise(dense_embeddings(spark, sf), "n").to_df(value="x")


@query(f"SELECT w, k // 8 AS i, k % 8 AS j, x FROM {EM}")
def view_reshape_split(spark, sf):
    e = dense_embeddings(spark, sf)
    return reshape(e, {"w": e.extents["w"], "i": 8, "j": 8}).to_df(value="x")


@query(f"SELECT (k * n + w) // 16 AS a, (k * n + w) % 16 AS b, x FROM {EM}, (SELECT MAX(vec_id) + 1 AS n FROM embeddings)")
def view_reshape_order(spark, sf):
    e = dense_embeddings(spark, sf)
    return reshape(e, {"a": e.extents["w"] * 4, "b": 16}, ("k", "w")).to_df(value="x")


@query(f"SELECT w * 8 + k // 8 AS \"row\", k % 8 AS col, x FROM {EM}")
def view_regroup_matrix(spark, sf):
    return regroup(tile_view(dense_embeddings(spark, sf), {"k": 8}), 2).to_df(value="x")


@query(f"SELECT w, x FROM {EM} WHERE k = 17")
def view_slice_one(spark, sf):
    return slice_modes(embeddings(spark, sf), {"k": 17}).to_df(value="x")


@query(f"SELECT rf, v FROM {FL} WHERE p = 11 AND ls = 'F'")
def view_slice_two(spark, sf):
    return slice_modes(flags(spark, sf), {"p": 11, "ls": "F"}).to_df()


@query(f"SELECT p, s, v FROM {Q}")
def view_transpose(spark, sf):
    return quantity(spark, sf).permute("p", "s").to_df()


@query(f"SELECT d * 12 + m AS n, v FROM {A}")
def view_linearise(spark, sf):
    return linearise(months(spark, sf).densify(), "n", ("d", "m")).to_df()


@query(f"SELECT (m * 7 + d) // 21 AS a, (m * 7 + d) // 3 % 7 AS b, (m * 7 + d) % 3 AS c, v FROM {A}")
def view_delinearise(spark, sf):
    return delinearise(linearise(months(spark, sf).densify(), "n"), {"a": 4, "b": 7, "c": 3}).to_df()


# -- graphs


@query(CHAIN)
def dag_chain(spark, sf):
    g, sb = Dag().add(contraction(input_node(quantity(spark, sf)), input_node(brands(spark, sf)), ("s", "b")))
    g, nb = g.add(contraction(sb.read(), input_node(supplier_nations(spark, sf)), ("n", "b")))
    return g.outputs(nb).execute()[0].to_df()


@query("WITH q AS (SELECT CAST(month(l_shipdate) - 1 AS BIGINT) AS m, l_suppkey AS s, CAST(SUM(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY ALL), " f"mn AS (SELECT m, n, SUM(x.v * y.v) AS v FROM q x JOIN {S} y USING (s) GROUP BY ALL) SELECT m, r, CAST(2 * SUM(x.v * y.v) - 3 * SUM(x.v * (n % 4)) AS BIGINT) AS v FROM mn x JOIN {RG} y USING (n) GROUP BY ALL")
def dag_diamond(spark, sf):
    q = from_table(table(spark, sf, "lineitem"), {"m": (F.month("l_shipdate") - 1).cast("long"), "s": "l_suppkey"}, "l_quantity", kind="bigint")
    rg = regions(spark, sf)
    g, mn = Dag().add(contraction(input_node(q), input_node(supplier_nations(spark, sf)), ("m", "n")))
    g, p = g.add(contraction(mn.read(), input_node(rg), ("m", "r")))
    g, w = g.add(contraction(mn.read(), input_node(rg, lambda n, r, v: (v * (n % 4)).cast("long")), ("m", "r")))
    g, out = g.add(combination([p.read(), w.read()], lambda m, r, a, b: 2 * a - 3 * b, join="outer"))
    return kept(g.outputs(out).execute(), lambda run: run[0].to_df())


@query(f"SELECT m, d, (x.v + y.v) * 2 + (x.v - y.v) AS v FROM {A} x JOIN {B} y USING (m, d)")
def dag_multi_output_two_consumers(spark, sf):
    a, b = (input_node(months(spark, sf, v).densify()) for v in ("l_quantity", None))
    g, plus, minus = Dag().add(combination([a, b], lambda m, d, x, y: [x + y, x - y], outputs=2))
    g, twice = g.add(combination([plus.read()], lambda m, d, v: 2 * v))
    g, out = g.add(combination([twice.read(), minus.read()], lambda m, d, x, y: x + y))
    return kept(g.outputs(out).execute(), lambda run: run[0].to_df())


@query(f"SELECT 'sb' AS root, CAST(s AS VARCHAR) AS a, b, {PRODUCT} FROM {Q} x JOIN {BR} y USING (p) GROUP BY ALL UNION ALL SELECT 'nb', CAST(n AS VARCHAR), b, v FROM ({CHAIN})")
def dag_two_roots(spark, sf):
    g, sb = Dag().add(contraction(input_node(quantity(spark, sf)), input_node(brands(spark, sf)), ("s", "b")))
    g, nb = g.add(contraction(sb.read(), input_node(supplier_nations(spark, sf)), ("n", "b")))
    part = lambda t, name: t.df.select(F.lit(name).alias("root"), F.col(t.modes[0]).cast("string").alias("a"), "b", "v")
    return kept(g.outputs(sb, nb).execute(), lambda run: part(run[0], "sb").unionByName(part(run[1].permute("n", "b"), "nb")))


@query(f"SELECT r, b, CAST(SUM(x.v * y.v) AS BIGINT) AS v FROM ({CHAIN}) x JOIN {RG} y USING (n) GROUP BY ALL")
def dag_released(spark, sf):
    """A chain of three contractions whose results are made in order and let go after their last reader."""
    g, sb = Dag().add(contraction(input_node(quantity(spark, sf)), input_node(brands(spark, sf)), ("s", "b")))
    g, nb = g.add(contraction(sb.read(), input_node(supplier_nations(spark, sf)), ("n", "b")))
    g, rb = g.add(contraction(nb.read(), input_node(regions(spark, sf)), ("r", "b")))
    return kept(g.outputs(rb).execute(release=True), lambda run: run[0].to_df())


H3 = "(SELECT q, a, 3 * q - 2 * a + q * a AS v FROM range(7) x(q) CROSS JOIN range(7) y(a))"
CUBE = "(SELECT CAST(month(l_shipdate) - 1 AS BIGINT) AS e, CAST(l_linenumber - 1 AS BIGINT) AS b, CAST(CAST(l_quantity AS BIGINT) % 7 AS BIGINT) AS c, COUNT(*) AS v FROM lineitem WHERE l_linenumber BETWEEN 1 AND 7 GROUP BY ALL)"
DENSE_CUBE = f"(SELECT e, b, c, COALESCE(v, 0) AS v FROM (SELECT e, b, c FROM range(12) x(e) CROSS JOIN range(7) y(b) CROSS JOIN range(7) z(c)) LEFT JOIN {CUBE} USING (e, b, c))"


def cube(spark, sf) -> Tensor:
    rows = table(spark, sf, "lineitem").where("l_linenumber between 1 and 7")
    labels = {"e": (F.month("l_shipdate") - 1).cast("long"), "b": (F.col("l_linenumber") - 1).cast("long"), "c": (F.col("l_quantity").cast("long") % 7).cast("long")}
    return from_table(rows, labels, extents={"e": 12, "b": 7, "c": 7}).densify()


def gradients(spark, sf):
    """A level graph with the gradients of a cube along two labels, and handles of both."""
    h = from_function(spark, {"q": 7, "a": 7}, lambda q, a: 3 * q - 2 * a + q * a, "bigint")
    g = LevelGraph(LabelTiles(LabelTile("e", 4), *[LabelWhole(x, 7) for x in "bcqa"]))
    g, u, hh = g.add(stage(cube(spark, sf)), stage(h))
    g, gb, gc = g.add(contraction(u.as_("e", "a", "c"), hh.read(), ("e", "q", "c")), contraction(u.as_("e", "b", "a"), hh.read(), ("e", "b", "q")))
    return g, gb, gc


GB = f"(SELECT e, q AS b, c, CAST(SUM(u.v * h.v) AS BIGINT) AS v FROM {DENSE_CUBE} u JOIN {H3} h ON u.b = h.a GROUP BY ALL)"
GC = f"(SELECT e, b, q AS c, CAST(SUM(u.v * h.v) AS BIGINT) AS v FROM {DENSE_CUBE} u JOIN {H3} h ON u.c = h.a GROUP BY ALL)"


@query(f"SELECT e, b, c, x.v + 10 * y.v AS v FROM {GB} x JOIN {GC} y USING (e, b, c)")
def level_combine(spark, sf):
    g, gb, gc = gradients(spark, sf)
    g, out = g.add(combination([gb.as_("e", "b", "c"), gc.as_("e", "b", "c")], lambda e, b, c, x, y: x + 10 * y))
    return kept(g.outputs(out).execute(), lambda run: run[0].to_df())


@query(f"SELECT 'b' AS root, e, b, c, v FROM {GB} UNION ALL SELECT 'c', e, b, c, v FROM {GC}")
def level_gradients(spark, sf):
    g, gb, gc = gradients(spark, sf)
    part = lambda t, name: t.as_("e", "b", "c").df.select(F.lit(name).alias("root"), "e", "b", "c", "v")
    return kept(g.outputs(gb, gc).execute(), lambda run: part(run[0], "b").unionByName(part(run[1], "c")))


@query(f"SELECT e, b, c, 2 * x.v + e AS v0, 3 * y.v - c AS v1 FROM {GB} x JOIN {GC} y USING (e, b, c)")
def level_multi_output(spark, sf):
    g, gb, gc = gradients(spark, sf)
    g, one, two = g.add(combination([gb.as_("e", "b", "c"), gc.as_("e", "b", "c")], lambda e, b, c, x, y: [2 * x + e, 3 * y - c], outputs=2))
    return kept(g.outputs(one, two).execute(), lambda run: run[0].frame)


@query(f"SELECT c, e, b, v FROM {GB}")
def level_declared_order(spark, sf):
    h = from_function(spark, {"q": 7, "a": 7}, lambda q, a: 3 * q - 2 * a + q * a, "bigint")
    g = LevelGraph(LabelTiles(LabelTile("e", 4), *[LabelWhole(x, 7) for x in "bcqa"]))
    g, u, hh = g.add(stage(cube(spark, sf)), stage(h))
    g, out = g.add(contraction(u.as_("e", "a", "c"), hh.read(), ("c", "e", "q")))
    return kept(g.outputs(out).execute(), lambda run: run[0].as_("c", "e", "b").to_df())


@query(f"SELECT e, b, c, v FROM {GB}")
def flat_tiles(spark, sf):
    """A tree run by blocks, with one map of block sizes for each of its contractions."""
    h = from_function(spark, {"q": 7, "a": 7}, lambda q, a: 3 * q - 2 * a + q * a, "bigint")
    u = cube(spark, sf).as_("e", "a", "c")
    g, out = Graph().ops(contraction(input_node(u), input_node(h), ("e", "q", "c"), value="bigint"))
    return g.execute_flat([{"e": 4, "a": 7, "c": 7, "q": 7}]).as_("e", "b", "c").to_df()


NINE = "(SELECT CAST(month(l_shipdate) - 1 AS BIGINT) AS m, CAST(l_linenumber - 1 AS BIGINT) AS d, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem WHERE l_linenumber = {k} OR l_linenumber = 1 GROUP BY ALL)"


@query("SELECT m, d, " + " + ".join(f"{k} * COALESCE(t{k}.v, 0)" for k in range(1, 10)) + f" AS v FROM {NINE.format(k=1)} t1 " + " ".join(f"FULL JOIN {NINE.format(k=k)} t{k} USING (m, d)" for k in range(2, 10)))
def combine_nine(spark, sf):
    """Nine operands that meet in one aggregate."""
    def part(k):
        rows = table(spark, sf, "lineitem").where((F.col("l_linenumber") == k) | (F.col("l_linenumber") == 1))
        return from_table(rows, {"m": (F.month("l_shipdate") - 1).cast("long"), "d": (F.col("l_linenumber") - 1).cast("long")}, "l_quantity", kind="bigint")

    return combine(("m", "d"), [part(k) for k in range(1, 10)], lambda m, d, a, b, c, e, f, g, h, i, j: a + 2 * b + 3 * c + 4 * e + 5 * f + 6 * g + 7 * h + 8 * i + 9 * j, join="outer").to_df()


@query("SELECT x.vec_id AS k, ROUND(list_inner_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 9) AS v FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1")
def array_dot(spark, sf):
    """Inner products of neighbouring rows' arrays, as one expression."""
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return rows.join(other, "vec_id").select(F.col("vec_id").alias("k"), F.round(dot("x", "y"), 9).alias("v"))


# -- elastic stiffness


MESH2 = "SELECT c_custkey AS e, c_nationkey AS kind FROM customer"
MESH3 = "SELECT s_suppkey AS e, s_nationkey AS kind FROM supplier"


def forces(elements, points, axes):
    """Forces on a mesh with an element for each row; they are rounded for comparison.  Elements are dealt, not their points."""
    fields, *matrices = fixture(deal(elements, "e"), points, axes, kind="kind")
    out = stiffness(fields, "e", axes, *matrices, dealt=True)
    return out.select("e", *axes, *[F.round(f"f{c}", 6).alias(f"f{c}") for c in range(len(axes))])


@query(stiffness_sql(MESH2, 8, ["x", "z"], kind="kind"))
def sem2d_force(spark, sf):
    return forces(table(spark, sf, "customer").selectExpr("cast(c_custkey as long) e", "c_nationkey kind"), 8, ["x", "z"])


@query(stiffness_sql(MESH3, 5, ["i", "j", "k"], kind="kind"))
def sem3d_force(spark, sf):
    return forces(table(spark, sf, "supplier").selectExpr("cast(s_suppkey as long) e", "s_nationkey kind"), 5, ["i", "j", "k"])


# -- blocks and order


@query(f"SELECT x.k, y.k AS l, ROUND(SUM(x.x * y.x), 6) AS v FROM {EM} x JOIN {EM} y USING (w) GROUP BY ALL")
def blocked_gram(spark, sf):
    e = dense_embeddings(spark, sf)
    t = contract_blocked(Blocked.of(e, {"w": 256, "k": 16}), Blocked.of(e.as_("w", "l"), {"w": 256, "l": 16}), ("k", "l"))
    return apply_hook(t, lambda k, l, v: F.round(v, 6)).to_df()


REGION_PRIORITY = f"SELECT r, pri, CAST(SUM(x.v * y.v * z.v) AS BIGINT) AS v FROM {RG} x JOIN {CN} y USING (n) JOIN {OP} z USING (c) GROUP BY ALL"


@query(REGION_PRIORITY)
def chain_reordered(spark, sf):
    return einsum([regions(spark, sf), customers(spark, sf), priorities(spark, sf)], ("r", "pri")).to_df()


# -- extensions: beyond the reference


@query("SELECT n, r, v * w AS v FROM (SELECT n_nationkey AS n, COUNT(*) AS v FROM nation GROUP BY ALL) CROSS JOIN (SELECT r_regionkey AS r, 2 * COUNT(*) AS w FROM region GROUP BY ALL)")
def outer_product(spark, sf):
    a = from_table(table(spark, sf, "nation"), {"n": "n_nationkey"}, extents={"n": 25})
    b = apply_hook(from_table(table(spark, sf, "region"), {"r": "r_regionkey"}, extents={"r": 5}), lambda r, v: 2 * v)
    return outer(a, b).to_df()


@query(f"SELECT {PRODUCT} FROM {A} x JOIN {B} y USING (m, d)")
def scalar_contract(spark, sf):
    return scalar(months(spark, sf), months(spark, sf, None)).to_df()


@query(f"SELECT ls, b, rf, {PRODUCT} FROM {FL} x JOIN (SELECT l_partkey AS p, l_returnflag AS rf, l_linenumber AS b, COUNT(*) AS v FROM lineitem GROUP BY ALL) y USING (p, rf) GROUP BY ALL")
def batch_contract(spark, sf):
    lines = from_table(table(spark, sf, "lineitem"), {"p": "l_partkey", "rf": "l_returnflag", "b": "l_linenumber"})
    return contract(flags(spark, sf), lines, ("ls", "b", "rf"), batch=["rf"]).to_df()


@query(f"SELECT n, z, b, CAST(SUM(x.v * y.v * w.v * t.v) AS BIGINT) AS v FROM {Q} x JOIN {Z} y USING (p) JOIN {BR} w USING (p) JOIN {S} t USING (s) GROUP BY ALL")
def einsum_nary(spark, sf):
    return einsum([quantity(spark, sf), sizes(spark, sf), brands(spark, sf), supplier_nations(spark, sf)], ("n", "z", "b")).to_df()


@query(f"SELECT s, z, CAST(MAX(x.v + y.v) AS BIGINT) AS v FROM {Q} x JOIN {Z} y USING (p) GROUP BY ALL")
def semiring_maxplus(spark, sf):
    return contract(quantity(spark, sf), sizes(spark, sf), ("s", "z"), semiring="max_plus").to_df()


@query(f"SELECT p, ls, CAST(SUM(v) AS BIGINT) AS v FROM {FL} GROUP BY ALL")
def reduce_mode(spark, sf):
    return reduce_modes(flags(spark, sf), "rf").to_df()


@query("SELECT user_id AS u, CAST(SUM(w) AS BIGINT) AS v FROM events JOIN (SELECT event_type, length(event_type) AS w FROM (SELECT DISTINCT event_type FROM events)) USING (event_type) GROUP BY ALL")
def stream_contract(spark, sf):
    """Events as a stream, contracted with a weight for each type; the result once all is read."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    kinds = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("t")).distinct()
    weights = Tensor(kinds.select("t", F.length("t").cast("long").alias("v")), ("t",), extents={})
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet").select(F.col("user_id").alias("u"), F.col("event_type").alias("t"), F.lit(1).cast("long").alias("v"))
    return settled(contract_stream(stream, ("u", "t"), weights, ("u",)))


import modeloom.queries_joins  # noqa: E402, F401  (registers its queries)
