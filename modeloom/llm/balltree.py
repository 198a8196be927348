"""Exact largest inner products by branch and bound over ball trees.

Vectors are dealt to shards that lie together in space (median splits fitted on a bounded
sample), and each shard is put in the order of a ball tree: consecutive rows are a leaf,
consecutive leaves a node.  No vector of a ball has a larger inner product with a query
than ``q.c + |q| r``, so a search opens nodes in order of that bound and leaves out those
that can't reach the kth score it has.

Shards are searched in waves: each query first in the shard of its greatest bound, then in
the next 4, the next 16 and so on.  After each wave the kth score that a query has by then
goes with it to all shards of the next, and shards whose bound is below it are never
opened.  Nothing is approximate: a search ends when no bound is left that reaches its kth score.

Equal vectors are folded to their ``k + 1`` smallest ids, which is all that a result can show of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modeloom.llm.common import discard, table, written

#: Rows of a leaf; bytes of a shard's vectors; queries that meet a shard in one task.
LEAF, SHARD_BYTES, ASKED = 64, 4 << 20, 4096
#: Vectors, and their bytes, of the sample on which shards are fitted; bytes of the shards' balls that are broadcast at once.
SAMPLE, SAMPLE_BYTES, DIRECTORY_BYTES = 32_768, 16 << 20, 32 << 20
LOWEST = 1 - 2**63


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=-1))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers as int64; raises where they might not fit."""
    most = float(lengths(q).max(initial=0) * lengths(x).max(initial=0))
    if most < 2**52:
        return (q @ x.T).astype(np.int64)
    if most >= 2**62:
        raise ValueError("an inner product may exceed 64 bits")
    return q.astype(np.int64) @ x.astype(np.int64).T


def split_direction(x: np.ndarray) -> np.ndarray:
    """From one far point to another."""
    a = x[lengths(x - x[0]).argmax()]
    b = x[lengths(x - a).argmax()]
    return b - a


class Cells:
    """Median splits of space, a heap of directions and cuts; fitted on a sample, they send any vector to one of ``count`` cells."""

    def __init__(self, sample: np.ndarray, count: int):
        self.depth = max(0, count - 1).bit_length()
        self.count = 1 << self.depth
        self.directions, self.cuts = np.zeros((self.count, sample.shape[1])), np.zeros(self.count)
        groups = {1: sample}
        for node in range(1, self.count):
            own = groups.pop(node)
            if len(own):
                self.directions[node] = split_direction(own)
                at = own @ self.directions[node]
                self.cuts[node] = np.median(at)
                right = at > self.cuts[node]
            else:
                right = np.zeros(0, bool)
            groups[2 * node], groups[2 * node + 1] = own[~right], own[right]

    def of(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + ((x * self.directions[node]).sum(axis=1) > self.cuts[node])
        return node - self.count


def tree_order(x: np.ndarray) -> np.ndarray:
    """An order of the rows in which every 2**i leaves from a multiple of 2**i on are a node."""
    out, stack = [], [np.arange(len(x))]
    while stack:
        own = stack.pop()
        if len(own) <= LEAF:
            out.append(own)
            continue
        half = LEAF << ((-(-len(own) // LEAF) - 1).bit_length() - 1)
        order = np.argpartition(x[own] @ split_direction(x[own]), half - 1)
        stack += [own[order[half:]], own[order[:half]]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def ball(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Center, radius and greatest length of rows."""
    c = x.mean(axis=0)
    return c, float(lengths(x - c).max()), float(lengths(x).max())


def bound(q: np.ndarray, norms: np.ndarray, centers: np.ndarray, radii: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """What no inner product of a query with a vector of a ball exceeds, with room for rounding (arrays of pairs)."""
    by_ball = (q * centers).sum(axis=-1) + norms * radii
    return np.minimum(by_ball, norms * longest) + 1e-9 * norms * (lengths(centers) + radii) + 0.5


class BallTree:
    """Balls over rows in tree order, leaves first; searched for many queries at a time."""

    def __init__(self, x: np.ndarray, ids: list[np.ndarray]):
        self.x = x
        counts = np.array([len(i) for i in ids])
        self.ids, self.begin = np.concatenate(ids), np.concatenate([[0], np.cumsum(counts)])
        self.owner = np.repeat(np.arange(len(x)), counts)
        self.levels, width, norms = [], LEAF, lengths(x)
        while True:
            starts = np.arange(0, len(x), width)
            size = np.diff(np.append(starts, len(x)))
            c = np.add.reduceat(x, starts, axis=0) / size[:, None]
            far = lengths(x - np.repeat(c, size, axis=0))
            self.levels.append((c, np.maximum.reduceat(far, starts), np.maximum.reduceat(norms, starts)))
            if len(starts) == 1:
                break
            width *= 2

    def bounds(self, q: np.ndarray, norms: np.ndarray, at: np.ndarray, level: int, nodes: np.ndarray) -> np.ndarray:
        return bound(q[at], norms[at], *[v[nodes] for v in self.levels[level]])

    def search(self, q: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score): what of the ``k`` best of each query is here and reaches ``kth`` (ties too)."""
        self.scores, self.found, self.opened = np.full((len(q), k), LOWEST), np.full((len(q), k), 2**63 - 1), 0
        norms, k_now = lengths(q), kth.copy()
        # queries without a score begin in the leaf that the greatest bounds lead to
        fresh = np.flatnonzero(kth == LOWEST)
        node = np.zeros(len(fresh), np.int64)
        for level in range(len(self.levels) - 2, -1, -1):
            other = np.minimum(2 * node + 1, len(self.levels[level][0]) - 1)
            better = self.bounds(q, norms, fresh, level, other) > self.bounds(q, norms, fresh, level, 2 * node)
            node = np.where(better, other, 2 * node)
        self.visit(q, fresh, node, k_now, k)
        first = np.full(len(q), -1)
        first[fresh] = node
        # from the root down, a node whose bound is below the kth score is left out
        at, nodes = np.arange(len(q)), np.zeros(len(q), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            if level < len(self.levels) - 1:
                at, nodes = np.repeat(at, 2), np.repeat(2 * nodes, 2) + np.tile([0, 1], len(nodes))
                real = nodes < len(self.levels[level][0])
                at, nodes = at[real], nodes[real]
            most = self.bounds(q, norms, at, level, nodes)
            good = most >= k_now[at]
            at, nodes, most = at[good], nodes[good], most[good]
        good = nodes != first[at]
        at, nodes, most = at[good], nodes[good], most[good]
        # leaves by bound, the greatest first: one of each query, then two, then four ...
        order = np.lexsort((-most, at))
        at, nodes, most = at[order], nodes[order], most[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        low, high = 0, 1
        while (rank >= low).any():
            now = (rank >= low) & (rank < high) & (most >= k_now[at])
            self.visit(q, at[now], nodes[now], k_now, k)
            low, high = high, 2 * high + 1
        rows, columns = np.nonzero((self.found < 2**63 - 1) & (self.scores >= kth[:, None]))
        return rows, self.found[rows, columns], self.scores[rows, columns]

    def visit(self, q: np.ndarray, at: np.ndarray, nodes: np.ndarray, kth: np.ndarray, k: int) -> None:
        """Scores queries ``at`` on leaves ``nodes``, leaf by leaf, and raises their kth scores."""
        order = np.argsort(nodes, kind="stable")
        at, nodes = at[order], nodes[order]
        self.opened += len(at)
        for own in np.split(np.arange(len(at)), np.flatnonzero(np.diff(nodes)) + 1) if len(at) else []:
            a, b = LEAF * nodes[own[0]], min(LEAF * (nodes[own[0]] + 1), len(self.x))
            some = at[own]
            s = products(q[some], self.x[a:b])
            keep = s.max(axis=1) >= kth[some]
            some, s = some[keep], s[keep]
            if not len(some):
                continue
            i, j = self.begin[a], self.begin[b]
            s = np.concatenate([self.scores[some], s[:, self.owner[i:j] - a]], axis=1)
            ids = np.concatenate([self.found[some], np.broadcast_to(self.ids[i:j], (len(some), j - i))], axis=1)
            best = np.lexsort((ids, -s), axis=1)[:, :k]
            self.scores[some], self.found[some] = np.take_along_axis(s, best, 1), np.take_along_axis(ids, best, 1)
            kth[some] = np.maximum(kth[some], np.where(self.found[some, -1] < 2**63 - 1, self.scores[some, -1], LOWEST))


# -- vectors and shards


def whole_numbers(vectors: DataFrame, scale: float = 256.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, vec): each component x as ``floor(scale * x)``; x as double.

    Rows without an id, and vectors that are null or hold a null or a value that is not finite, are left out; of several vectors under
    one id the least counts; a component of 2^53 or more is an error.  Vectors without components are kept.
    """
    v = F.col("vec")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vec"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    far = lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x)).otherwise(F.raise_error(F.lit("a component exceeds 53 bits")).cast("long"))
    return rows.groupBy("vec_id").agg(F.min("vec").alias("vec")).withColumn("vec", F.transform(v, lambda x: far(F.lit(scale) * x)))


def folded(rows: DataFrame, dim: int, k: int) -> DataFrame:
    """(vec, ids): each different vector, filled up with zeros, and its ``k + 1`` smallest ids."""
    first = Window.partitionBy("vec").orderBy("vec_id")
    filled = padded(rows, dim).withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k + 1)
    return filled.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def padded(rows: DataFrame, dim: int) -> DataFrame:
    short = F.concat("vec", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("vec")))
    return rows.withColumn("vec", F.when(F.size("vec") < dim, short).otherwise(F.col("vec")))


def sharded(classes: DataFrame, dim: int) -> DataFrame:
    """(shard, place, vec, ids), written: shards of about ``SHARD_BYTES``, numbered from 0, each in tree order.

    Cells are fitted on at most ``SAMPLE`` vectors, those of least hash; one that holds more than a shard is dealt into several by hash.
    """
    spark, n = classes.sparkSession, classes.count()
    rows = max(LEAF, SHARD_BYTES // (8 * dim))
    most = max(8, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    sample = classes.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(most).toArrow()["vec"]
    x = matrix(sample, dim)
    cells = spark.sparkContext.broadcast(Cells(x, max(1, min(-(-n // rows), len(x) // 8))))

    def route(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(cells.value.of(matrix(batch.column(0), dim))), *batch.columns], ["cell", "vec", "ids"])

    routed = classes.select("vec", "ids").mapInArrow(route, "cell long, vec array<long>, ids array<long>")
    counts = np.zeros(cells.value.count, np.int64)
    for r in routed.groupBy("cell").count().collect():  # at most SAMPLE / 8 numbers
        counts[r["cell"]] = r["count"]
    parts = -(-counts // rows)
    begin = spark.createDataFrame([(c, int(b), int(p)) for c, (b, p) in enumerate(zip(np.cumsum(parts) - parts, parts)) if p], "cell long, begin long, parts long")
    dealt = routed.join(F.broadcast(begin), "cell").select((F.col("begin") + F.pmod(F.xxhash64("vec"), "parts")).alias("shard"), "vec", "ids")

    def build(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(tree_order(matrix(t["vec"], dim))))
        return t.add_column(1, "place", pa.array(np.arange(t.num_rows)))

    return written(dealt.groupBy("shard").applyInArrow(build, "shard long, place long, vec array<long>, ids array<long>"), "shards")


def directory(shards: DataFrame, dim: int) -> DataFrame:
    """(shard, center, radius, longest), written: the ball of each shard."""

    def work(t: pa.Table) -> pa.Table:
        c, radius, longest = ball(matrix(t["vec"], dim))
        return pa.table({"shard": t["shard"].slice(0, 1), "center": pa.array([c]), "radius": [radius], "longest": [longest]})

    return written(shards.select("shard", "vec").groupBy("shard").applyInArrow(work, "shard long, center array<double>, radius double, longest double"), "balls")


# -- search


def routed(kinds: DataFrame, balls: DataFrame, dim: int, low: int, high: int) -> DataFrame:
    """(shard, q, vec, kth) of the shards of ranks ``low`` to ``high`` by bound, of each piece of the directory, whose bound reaches kth."""
    spark = kinds.sparkSession
    piece = max(1, DIRECTORY_BYTES // (8 * (dim + 3)))
    last = balls.agg(F.max("shard")).first()[0]
    made = []
    for a in range(0, last + 1, piece):
        own = balls.where((F.col("shard") >= a) & (F.col("shard") < a + piece)).toArrow()
        if own.num_rows <= low:
            continue
        numbers = own["shard"].to_numpy()
        held = spark.sparkContext.broadcast((numbers, matrix(own["center"], dim), own["radius"].to_numpy(), own["longest"].to_numpy()))

        def work(batches, held=held):
            numbers, centers, radii, longest = held.value
            reach = radii + 1e-9 * (lengths(centers) + radii)
            step = max(1, 2_000_000 // len(numbers))
            for batch in batches:
                q, kth = matrix(batch.column(1), dim), batch.column(2).to_numpy()
                for i in range(0, len(q), step):
                    x, norms = q[i : i + step], lengths(q[i : i + step])[:, None]
                    most = np.minimum(x @ centers.T + norms * reach, norms * (longest + 1e-9 * longest)) + 0.5
                    order = np.argsort(-most, axis=1, kind="stable")[:, low:high]
                    good = np.take_along_axis(most, order, 1) >= kth[i : i + step, None]
                    rows, columns = np.nonzero(good)
                    taken = [batch.column(c).take(pa.array(i + rows)) for c in range(3)]
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[order[rows, columns]]), *taken], ["shard", "q", "vec", "kth"])

        made.append(kinds.select("q", "vec", "kth").mapInArrow(work, "shard long, q long, vec array<long>, kth long"))
    if not made:
        return spark.createDataFrame([], "shard long, q long, vec array<long>, kth long")
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def searched(shards: DataFrame, pairs: DataFrame, dim: int, k: int) -> DataFrame:
    """(q, id, score) of what each pair finds; the queries of a shard are dealt to tasks of about ``ASKED``, each with the whole shard."""
    parts = pairs.groupBy("shard").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("parts"))
    left = shards.join(parts, "shard").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).select("shard", "part", "place", "vec", "ids")
    right = pairs.join(parts, "shard").select("shard", F.pmod(F.xxhash64("q"), "parts").cast("int").alias("part"), "q", "vec", "kth")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("q", "id", "score")})
        left = left.sort_by("place")
        ids = left["ids"].combine_chunks()
        ends = np.cumsum(ids.value_lengths().to_numpy())
        tree = BallTree(matrix(left["vec"], dim), np.split(ids.flatten().to_numpy(), ends[:-1]))
        at, found, scores = tree.search(matrix(right["vec"], dim), right["kth"].to_numpy().copy(), k)
        return pa.table({"q": right["q"].take(pa.array(at)), "id": found, "score": scores})

    return left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(meet, "q long, id long, score long")


def top_products(rows: DataFrame, queries: Column, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` others of largest inner product of each row that ``queries`` (over vec_id) selects.

    ``rows``: vec_id (unique), vec (array of long).  Largest first, ties to the smaller id; all others, if fewer.  Vectors of
    different lengths are filled up with zeros.  An empty table gives no row.
    """
    spark = rows.sparkSession
    out = "query_id long, rank int, vec_id long, score long"
    rows = written(rows.select("vec_id", "vec"), "vectors")
    longest = rows.agg(F.max(F.size("vec"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], out)
    dim = max(1, longest)
    classes = written(folded(rows, dim, k), "vector-classes")
    shards = sharded(classes, dim)
    balls = directory(shards, dim)
    count = balls.count()
    asked = padded(rows.where(queries), dim).join(classes, "vec").select("vec_id", F.element_at("ids", 1).alias("q"))
    asked = written(asked, "asked")
    kinds = classes.join(asked.select("q").distinct(), F.element_at("ids", 1) == F.col("q")).select("q", "vec")
    best: DataFrame | None = None
    low, high = 0, 1
    while low < count:
        if best is None:
            now = kinds.withColumn("kth", F.lit(LOWEST).cast("long"))
        else:
            kth = best.groupBy("q").agg(F.when(F.count("*") > k, F.min("score")).alias("kth"))
            now = kinds.join(kth, "q", "left").withColumn("kth", F.coalesce("kth", F.lit(LOWEST)))
        pairs = written(routed(now, balls, dim, low, high), "pairs")
        found = searched(shards, pairs, dim, k + 1)
        order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
        every = found if best is None else best.unionByName(found)
        last, best = best, written(every.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k + 1).drop("rn"), "best")
        discard(pairs, *[last] if last is not None else [])
        low, high = high, 4 * high + 1
    discard(rows, classes, shards, balls)
    if best is None:
        return spark.createDataFrame([], out)
    sorted_ = best.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("z"))
    others = F.slice(F.filter("z", lambda x: x["id"] != F.col("vec_id")), 1, k)
    met = asked.join(sorted_, "q").select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("rank", "x"))
    return met.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 others of largest integer inner product of every fiftieth vector; see :func:`whole_numbers` and :func:`top_products` for odd rows."""
    return top_products(whole_numbers(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0, 5)
