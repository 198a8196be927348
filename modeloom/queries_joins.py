"""Registered queries beyond the plain contraction: cycles, frequent labels, intervals, bands, marginals, masks, diagonals, states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modeloom.operators import LOG_SUM_EXP, VARIANCE, apply_hook, as_of, contract_best, contract_masked, contract_skewed, contract_within, diagonal, einsum, einsum_shares, moving, reduce_with, stencil, trace
from modeloom.plans import kept, marginals
from modeloom.queries import BR, S, brands, quantity, query, sizes, supplier_nations, table
from modeloom.sources import from_table
from modeloom.streaming.pairs import added_up, contract_streams
from modeloom.tensor import Tensor


def ordered(spark, sf) -> DataFrame:
    """Line items with the customer of their order."""
    return table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


LO = "(SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


# -- cycles


@query(
    f"""WITH cp AS (SELECT o_custkey AS c, l_partkey AS p, CAST(SUM(l_quantity) AS BIGINT) AS v FROM {LO} GROUP BY ALL),
    ps AS (SELECT l_partkey AS p, l_suppkey AS s, COUNT(*) AS v FROM lineitem GROUP BY ALL), sc AS (SELECT l_suppkey AS s, o_custkey AS c, COUNT(*) AS v FROM {LO} GROUP BY ALL)
    SELECT s, CAST(SUM(cp.v * ps.v * sc.v) AS BIGINT) AS v FROM cp JOIN ps USING (p) JOIN sc USING (s, c) GROUP BY ALL"""
)
def cyclic_triangles(spark, sf):
    """For each supplier: what its customers bought of the parts that it supplies, from anyone; three labels in a cycle."""
    rows = ordered(spark, sf)
    cp = from_table(rows, {"c": "o_custkey", "p": "l_partkey"}, "l_quantity", kind="bigint")
    ps = from_table(table(spark, sf, "lineitem"), {"p": "l_partkey", "s": "l_suppkey"})
    sc = from_table(rows, {"s": "l_suppkey", "c": "o_custkey"})
    return einsum_shares([cp, ps, sc], ("s",)).to_df()


@query(
    f"""WITH nb AS (SELECT n, b, SUM(x.v * y.v * z.v) AS v FROM {S} x JOIN (SELECT l_suppkey AS s, l_partkey AS p, COUNT(*) AS v FROM lineitem GROUP BY ALL) y USING (s) JOIN {BR} z USING (p) GROUP BY ALL),
    bm AS (SELECT p_brand AS b, CAST(month(l_shipdate) AS BIGINT) AS m, COUNT(*) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
    mf AS (SELECT CAST(month(l_shipdate) AS BIGINT) AS m, l_returnflag AS f, COUNT(*) AS v FROM lineitem GROUP BY ALL),
    fn AS (SELECT l_returnflag AS f, s_nationkey AS n, COUNT(*) % 7 AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
    SELECT CAST(SUM(nb.v % 5 * (bm.v % 5) * (mf.v % 5) * fn.v) AS BIGINT) AS v FROM nb JOIN bm USING (b) JOIN mf USING (m) JOIN fn USING (f, n)"""
)
def cyclic_square(spark, sf):
    """A number: four tensors in a cycle of nation, brand, month and return flag."""
    lines, fifth = table(spark, sf, "lineitem"), lambda t: Tensor(t.df.withColumn("v", F.col("v") % 5), t.modes)
    month = F.month("l_shipdate").cast("long")
    counts = from_table(lines, {"s": "l_suppkey", "p": "l_partkey"})
    nb = fifth(einsum([supplier_nations(spark, sf), counts, brands(spark, sf)], ("n", "b")))
    bm = fifth(from_table(lines.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")), {"b": "p_brand", "m": month}))
    mf = fifth(from_table(lines, {"m": month, "f": "l_returnflag"}))
    fn = from_table(lines.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")), {"f": "l_returnflag", "n": "s_nationkey"})
    fn = Tensor(fn.df.withColumn("v", F.col("v") % 7), fn.modes)
    return einsum_shares([nb, bm, mf, fn], ()).to_df()


# -- frequent labels


CF = f"(SELECT o_custkey AS c, l_returnflag AS f, CAST(SUM(l_quantity) AS BIGINT) AS v FROM {LO} GROUP BY ALL)"


@query(f"SELECT c, z, CAST(SUM(x.v * y.v) AS BIGINT) AS v FROM {CF} x JOIN (SELECT l_returnflag AS f, p_size AS z, COUNT(*) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) y USING (f) GROUP BY ALL")
def skewed_contract(spark, sf):
    """Customers by part size over the return flag, of which there are three values."""
    cf = from_table(ordered(spark, sf), {"c": "o_custkey", "f": "l_returnflag"}, "l_quantity", kind="bigint")
    fz = from_table(table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")), {"f": "l_returnflag", "z": "p_size"})
    return contract_skewed(cf, fz, ("c", "z"), part=200).to_df()


@query("SELECT x.s, y.s AS o, CAST(SUM(x.v * y.v) AS BIGINT) AS v FROM (SELECT l_suppkey AS s, l_linenumber AS k, COUNT(*) AS v FROM lineitem GROUP BY ALL) x JOIN (SELECT l_suppkey AS s, l_linenumber AS k, COUNT(*) AS v FROM lineitem GROUP BY ALL) y USING (k) GROUP BY ALL")
def skewed_gram(spark, sf):
    """Suppliers by suppliers over the line number: a product of a tensor with itself, all of whose summed values are frequent."""
    t = from_table(table(spark, sf, "lineitem"), {"s": "l_suppkey", "k": "l_linenumber"})
    return contract_skewed(t, t.as_("o", "k"), ("s", "o"), part=50).to_df()


# -- intervals and the latest before


@query(
    """SELECT pri, rf, CAST(SUM(x.v * y.w) AS BIGINT) AS v FROM (SELECT CAST(l_shipdate AS DATE) AS t, l_returnflag AS rf, CAST(SUM(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY ALL) x
    JOIN (SELECT o_orderpriority AS pri, CAST(o_orderdate AS DATE) AS b, CAST(o_orderdate AS DATE) + CAST(1 + o_custkey % 90 AS INTEGER) AS e, o_orderkey % 5 AS w FROM orders) y ON t >= b AND t < e GROUP BY ALL"""
)
def interval_contract(spark, sf):
    """Quantities shipped while orders were open, by priority of the order and return flag; orders are open for 1 to 90 days."""
    shipped = from_table(table(spark, sf, "lineitem"), {"t": F.to_date("l_shipdate"), "rf": "l_returnflag"}, "l_quantity", kind="bigint")
    open_ = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("pri"), F.to_date("o_orderdate").alias("b"), F.date_add(F.to_date("o_orderdate"), (1 + F.col("o_custkey") % 90).cast("int")).alias("e"), (F.col("o_orderkey") % 5).alias("w"))
    return contract_within(shipped, "t", open_, "b", "e", "w", out=("pri", "rf")).to_df()


@query("SELECT x.event_type AS first, y.event_type AS then, COUNT(*) AS v FROM events x JOIN events y ON x.user_id = y.user_id AND y.ts >= x.ts AND y.ts < x.ts + INTERVAL 6 HOURS GROUP BY ALL")
def interval_by_user(spark, sf):
    """How often events of one type follow those of another within six hours, of the same user; the user is shared as well."""
    events = table(spark, sf, "events")
    points = from_table(events, {"u": "user_id", "t": "ts", "then": "event_type"})
    spans = events.select(F.col("user_id").alias("u"), F.col("event_type").alias("first"), F.col("ts").alias("b"), F.expr("ts + interval 6 hours").alias("e"), F.lit(1).cast("long").alias("w"))
    return contract_within(points, "t", spans, "b", "e", "w", ["u"], ("first", "then")).to_df()


@query(
    """WITH l AS (SELECT user_id, ts, event_id FROM events WHERE event_type <> 'click'), r AS (SELECT user_id, MAX(CAST(ROUND(value * 100) AS BIGINT)) AS cents, ts FROM events WHERE event_type = 'click' GROUP BY user_id, ts)
    SELECT l.event_id, l.user_id, COALESCE(r.cents, -1) AS cents FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts"""
)
def as_of_latest(spark, sf):
    """Each event but clicks with the value of the latest click of its user, -1 before the first."""
    events = table(spark, sf, "events")
    left = events.where("event_type <> 'click'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'click'").select("user_id", "ts", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return as_of(left, right, "ts", ["user_id"], ["cents"]).select("event_id", "user_id", F.coalesce("cents", F.lit(-1).cast("long")).alias("cents"))


# -- along an ordered label


DAYS = "(SELECT CAST(l_shipdate AS DATE) - DATE '1990-01-01' AS d, l_returnflag AS f, CAST(SUM(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY ALL)"


def shipped_by_day(spark, sf) -> Tensor:
    day = F.date_diff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date")).cast("long")
    return from_table(table(spark, sf, "lineitem"), {"d": day, "f": "l_returnflag"}, "l_quantity", kind="bigint")


@query("SELECT d, f, CAST(" + " + ".join(f"{w} * COALESCE(SUM(v) OVER (PARTITION BY f ORDER BY d RANGE BETWEEN {abs(o)} {k} AND {abs(o)} {k}), 0)" for o, w, k in ((-2, 1, "PRECEDING"), (-1, -4, "PRECEDING"), (0, 6, "FOLLOWING"), (1, -4, "FOLLOWING"), (2, 1, "FOLLOWING"))) + f" AS BIGINT) AS v FROM {DAYS}")
def sliding_stencil(spark, sf):
    """Fourth differences of quantities by day, for each return flag."""
    return stencil(shipped_by_day(spark, sf), "d", {-2: 1, -1: -4, 0: 6, 1: -4, 2: 1}, block=256).to_df()


@query(f"SELECT d, f, CAST(SUM(v) OVER (PARTITION BY f ORDER BY d RANGE BETWEEN 29 PRECEDING AND CURRENT ROW) AS BIGINT) AS v FROM {DAYS}")
def sliding_sum(spark, sf):
    """Quantities of the last thirty days at each day with any, for each return flag."""
    return moving(shipped_by_day(spark, sf), "d", -29, 0, block=256).to_df()


# -- marginals, masks, diagonals, states


@query(
    """SELECT CAST(GROUPING(rf, ls, m, k) AS INTEGER) AS g, COALESCE(rf, '*') AS rf, COALESCE(ls, '*') AS ls, COALESCE(CAST(m AS VARCHAR), '*') AS m, COALESCE(CAST(k AS VARCHAR), '*') AS k, CAST(SUM(l_quantity) AS BIGINT) AS v
    FROM (SELECT l_returnflag AS rf, l_linestatus AS ls, month(l_shipdate) AS m, p_size % 7 AS k, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY CUBE (rf, ls, m, k)"""
)
def marginals_cube(spark, sf):
    """All sixteen marginals of a join by four labels."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    labels = {"rf": "l_returnflag", "ls": "l_linestatus", "m": F.month("l_shipdate"), "k": F.col("p_size") % 7}
    t = from_table(rows, labels, "l_quantity", kind="bigint")

    def union(run):
        parts = []
        for x in run:
            lacks = sum((m not in x.modes) << (3 - k) for k, m in enumerate(labels))
            parts.append(x.df.select(F.lit(lacks).alias("g"), *[F.col(m).cast("string").alias(m) if m in x.modes else F.lit("*").alias(m) for m in labels], "v"))
        return reduce(DataFrame.unionByName, parts)

    return kept(marginals(t), union)


@query(
    """WITH q AS (SELECT l_suppkey AS s, l_partkey AS p, CAST(SUM(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY ALL), z AS (SELECT p_partkey AS p, p_size AS z, COUNT(*) AS v FROM part GROUP BY ALL),
    m AS (SELECT DISTINCT l_suppkey AS s, p_size AS z FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 97 = 0)
    SELECT s, z, CAST(SUM(q.v * z.v) AS BIGINT) AS v FROM q JOIN z USING (p) JOIN m USING (s, z) GROUP BY ALL"""
)
def contract_on_mask(spark, sf):
    """Suppliers by part size, at the coordinates of one order in 97."""
    lines = table(spark, sf, "lineitem").where("l_orderkey % 97 = 0").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    mask = from_table(lines, {"s": "l_suppkey", "z": "p_size"}, agg="one")
    return contract_masked(quantity(spark, sf), sizes(spark, sf), mask).to_df()


@query("SELECT n, b, CAST(SUM(v) AS BIGINT) AS v FROM (SELECT s_nationkey AS n, c_nationkey AS n2, p_brand AS b, COUNT(*) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL) WHERE n = n2 GROUP BY ALL")
def diagonal_nations(spark, sf):
    """Lines whose customer and supplier are of one nation, by nation and brand: the diagonal of a tensor with the nation twice."""
    rows = ordered(spark, sf).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return diagonal(from_table(rows, {"n": "s_nationkey", "n2": "c_nationkey", "b": "p_brand"}), "n", "n", "b").to_df()


@query("SELECT CAST(COUNT(*) AS BIGINT) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey = c_nationkey")
def trace_nations(spark, sf):
    """How many lines stay within a nation: a trace."""
    rows = ordered(spark, sf).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return trace(from_table(rows, {"n": "s_nationkey", "n2": "c_nationkey"}), "n", "n").to_df()


@query("SELECT l_returnflag AS rf, l_linenumber AS k, ROUND(VAR_POP(l_extendedprice) / 1e6, 4) AS v FROM lineitem GROUP BY ALL")
def reduce_variance(spark, sf):
    """Variance of prices (in millions) from counts, means and squared deviations that are merged."""
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("rf"), F.col("l_linenumber").alias("k"), F.col("l_extendedprice").alias("v"))
    return apply_hook(reduce_with(Tensor(rows, ("rf", "k")), ("rf", "k"), VARIANCE), lambda rf, k, v: F.round(v / 1e6, 4)).to_df()


@query("SELECT l_suppkey AS s, ROUND(LN(SUM(EXP(l_quantity / 10))), 6) AS v FROM lineitem GROUP BY ALL")
def reduce_log_sum_exp(spark, sf):
    """log(sum(exp(quantity / 10))) by supplier."""
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s"), (F.col("l_quantity") / 10).alias("v"))
    return apply_hook(reduce_with(Tensor(rows, ("s",)), ("s",), LOG_SUM_EXP), lambda s, v: F.round(v, 6)).to_df()


# -- the best of each key


@query(
    """WITH q AS (SELECT l_suppkey AS s, l_partkey AS p, CAST(SUM(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY ALL)
    SELECT s, p, v FROM (SELECT s, p, v * CAST(ROUND(p_retailprice * 100) AS BIGINT) AS v, ROW_NUMBER() OVER (PARTITION BY s ORDER BY v * CAST(ROUND(p_retailprice * 100) AS BIGINT) DESC, p) AS n FROM q JOIN part ON p = p_partkey) WHERE n <= 10"""
)
def best_parts(spark, sf):
    """The ten parts of each supplier with the greatest quantity times price."""
    price = from_table(table(spark, sf, "part"), {"p": "p_partkey"}, F.round(F.col("p_retailprice") * 100).cast("long"), "max")
    return contract_best(quantity(spark, sf), price, ["s"], 10).to_df()


@query(
    """SELECT n, p, b, v FROM (SELECT n, p, b, x.v * y.v AS v, ROW_NUMBER() OVER (PARTITION BY n ORDER BY x.v * y.v DESC, n, p, b) AS k
    FROM (SELECT s_nationkey AS n, l_partkey AS p, CAST(SUM(l_quantity) AS BIGINT) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL) x
    JOIN (SELECT l_partkey AS p, l_returnflag AS b, COUNT(*) AS v FROM lineitem GROUP BY ALL) y USING (p)) WHERE k <= 5"""
)
def best_pairs(spark, sf):
    """For each nation the five pairs of part and return flag with the greatest product of quantity there and count anywhere."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    a = from_table(lines, {"n": "s_nationkey", "p": "l_partkey"}, "l_quantity", kind="bigint")
    return contract_best(a, from_table(table(spark, sf, "lineitem"), {"p": "l_partkey", "b": "l_returnflag"}), ["n"], 5).to_df()


# -- two streams


@query("SELECT x.event_id % 3 AS i, y.event_id % 4 AS j, CAST(SUM(CAST(ROUND(x.value * 100) AS BIGINT)) AS BIGINT) AS v FROM events x JOIN events y ON x.user_id = y.user_id AND y.ts BETWEEN x.ts - INTERVAL 3 HOURS AND x.ts + INTERVAL 3 HOURS WHERE x.event_type = 'click' AND y.event_type = 'purchase' GROUP BY ALL")
def stream_pairs(spark, sf):
    """Clicks and purchases as two streams: pairs of one user at most three hours apart, added up once all is read."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    clicks = events.where("event_type = 'click'").select(F.col("user_id").alias("u"), (F.col("event_id") % 3).alias("i"), "ts", F.round(F.col("value") * 100).cast("long").alias("v"))
    bought = events.where("event_type = 'purchase'").select(F.col("user_id").alias("u"), (F.col("event_id") % 4).alias("j"), "ts", F.lit(1).cast("long").alias("v"))
    return added_up(contract_streams(clicks, ["u", "i"], bought, ["u", "j"], "ts", "3 hours", "40 days"), out=["i", "j"])[0]
