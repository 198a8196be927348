"""Nearest neighbours from balanced posting lists.

Centroids come from a bounded sample by k-means with a penalty on full lists.  Each vector
goes to the list of its nearest centroid and, when it lies near a boundary, to further ones
within a ratio of that distance.  A graph over the centroids, small enough for every
worker, finds lists by best-first search; a query opens the lists whose centroids are
within a ratio of its nearest one, few in dense places and many where all are far.  What
ratio the data need is measured: some queries are answered by a scan of all vectors, and
the ratio is raised until the lists hold the answers, all lists if need be.  A query that found
fewer neighbours than it asks for, as one far from all centroids of a dense cluster
may, is searched again with four times as many lists, until it has them or all lists are open.

Largest inner products are nearest neighbours once every vector is given one coordinate
more, the square root of what its squared length lacks to the greatest one.  A query's length
does not matter to the order of its products; it is brought to the greatest one.

Equal vectors are folded first: a class keeps its vector and its ``k + 1`` smallest ids,
which is all that a result of ``k`` others can show of it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modeloom.llm.common import table, written

SAMPLE, MOST_LISTS = 32_768, 16_384
LIST_ROWS, LIST_PROBES = 50_000, 20_000  # vectors and queries of a list that meet in one task
TRIED, AIM = 256, 0.98


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :], 0)


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k-means whose distances grow with the fill of a list, so that dense places get more centroids."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    aim, price = len(x) / k, np.zeros(k, np.float32)
    for _ in range(rounds):
        size, total, scale = np.zeros(k), np.zeros(c.shape), 0.0
        for a in range(0, len(x), 4096):
            d = squared(x[a : a + 4096], c)
            scale += float(d.min(axis=1).sum())
            own = (d + price).argmin(axis=1)
            np.add.at(total, own, x[a : a + 4096])
            size += np.bincount(own, minlength=k)
        full = size > 0
        c[full] = total[full] / size[full, None]
        order = np.argsort(-size)
        empty = np.flatnonzero(~full)
        c[empty] = c[order[: len(empty)]] + rng.normal(0, 1e-3, (len(empty), c.shape[1]))  # split the fullest
        price = (0.5 * scale / len(x) * np.clip(size / aim - 1, -0.5, 2)).astype(np.float32)
    return c.astype(np.float32)


class CentroidGraph:
    """Centroids and, for each, its nearest others; searched best first for many vectors at a time."""

    def __init__(self, centroids: np.ndarray, degree: int = 24):
        self.c, k = centroids, len(centroids)
        near = np.zeros((k, min(degree, k - 1) if k > 1 else 0), np.int32)
        for a in range(0, k, 1024):
            d = squared(centroids[a : a + 1024], centroids)
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            near[a : a + 1024] = np.argsort(d, axis=1)[:, : near.shape[1]]
        ring = np.stack([np.roll(np.arange(k), 1), np.roll(np.arange(k), -1)], axis=1).astype(np.int32)  # keeps the graph connected
        self.near = np.concatenate([near, ring], axis=1)
        self.entries = np.unique(np.linspace(0, k - 1, min(k, 16)).astype(np.int32))

    def search(self, x: np.ndarray, beam: int, ratio: float, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Up to ``beam`` centroids of each vector, nearest first, and their distances (inf: none).

        A vector's search ends when all that is left to expand is farther than its beam, or
        than ``ratio`` (and a margin) times its nearest centroid and ``least`` found ones.
        """
        n, k = len(x), len(self.c)
        beam, least = min(beam, k), min(least, beam, k)
        seen = np.zeros((n, k), bool)
        norm = (x * x).sum(1)
        cnorm = (self.c * self.c).sum(1)
        ids = np.broadcast_to(self.entries, (n, len(self.entries))).copy()
        seen[:, self.entries] = True
        dist = squared(x, self.c[self.entries])
        opened = np.zeros(ids.shape, bool)
        step = 4
        live = np.arange(n)
        while len(live):
            waiting = np.where(opened[live], np.inf, dist[live])
            pick = np.argpartition(waiting, min(step, waiting.shape[1]) - 1, axis=1)[:, :step]
            at = np.take_along_axis(waiting, pick, 1)
            near, enough, edge = (np.partition(dist[live], m - 1, axis=1)[:, m - 1] if dist.shape[1] >= m else np.inf for m in (1, least, beam))
            limit = np.minimum(np.maximum(near * (1.1 * ratio) ** 2, enough), edge)
            good = np.isfinite(at) & (at <= limit[:, None])
            more = good.any(axis=1)
            live, pick, good = live[more], pick[more], good[more]
            if not len(live):
                break
            opened[live[:, None], pick] |= good
            new = np.where(good[:, :, None], self.near[ids[live[:, None], pick]], -1).reshape(len(live), -1)
            new.sort(axis=1)
            fresh = new >= 0
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
            fresh &= ~seen[live[:, None], new]
            seen[live[:, None], np.where(fresh, new, self.entries[0])] = True
            width = int(fresh.sum(axis=1).max())
            if not width:
                continue
            order = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
            new, fresh = np.take_along_axis(new, order, 1), np.take_along_axis(fresh, order, 1)
            d = norm[live, None] + cnorm[new] - 2 * np.einsum("nd,nwd->nw", x[live], self.c[new])
            d = np.where(fresh, np.maximum(d, 0), np.inf)
            pad_i, pad_d = np.zeros((n, width), np.int32), np.full((n, width), np.inf, dist.dtype)
            pad_i[live], pad_d[live] = new, d
            ids, dist = np.concatenate([ids, pad_i], 1), np.concatenate([dist, pad_d], 1)
            opened = np.concatenate([opened, ~np.isfinite(pad_d)], 1)
            if ids.shape[1] > 2 * beam + 64:
                keep = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
                ids, dist, opened = (np.take_along_axis(v, keep, 1) for v in (ids, dist, opened))
        order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        return np.take_along_axis(ids, order, 1), np.sqrt(np.take_along_axis(dist, order, 1))


class Index:
    def __init__(self, graph: CentroidGraph, longest: float, dim: int):
        self.graph, self.longest, self.dim = graph, longest, dim

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        """float32 vectors with the coordinate more (0 for queries, which get the greatest length)."""
        if query:
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = x * (self.longest / np.sqrt((x * x).sum(1)))[:, None]
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0))
        return np.concatenate([x, more[:, None]], axis=1).astype(np.float32)

    def lists(self, x: np.ndarray, query: bool, ratio: float, most: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of the vector, list) pairs; ``most`` lists of a vector that is stored.

        A query gets every list within ``ratio``: while the ``most`` nearest all are, it is searched again with twice as many.
        """
        rows, lists, k = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], len(self.graph.c)
        waiting = np.arange(len(x))
        while len(waiting):
            again, step = [], min(512, max(16, 4_000_000 // k))
            for a in range(0, len(waiting), step):
                own = waiting[a : a + step]
                ids, d = self.graph.search(self.lift(x[own], query), most, ratio, least)
                take = (d <= d[:, :1] * ratio + 1e-6) | (np.arange(d.shape[1]) < least)
                full = (take & np.isfinite(d)).all(axis=1) & (query and most < k)
                again.append(own[full])
                r, c = np.nonzero(take & np.isfinite(d) & ~full[:, None])
                rows.append(own[r])
                lists.append(ids[r, c])
            waiting, most = np.concatenate(again), 2 * most
        return np.concatenate(rows), np.concatenate(lists)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, int]:
    """(vec_id, vec, h1, h2) of the vectors that take part, and their dimension.

    Left out are vectors that are null, zero or empty, hold a null or a value that is not
    finite, have no id, or differ in dimension from the most frequent one.
    """
    v = F.col("vec")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vec"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0))
    dims = rows.groupBy(F.size(v).alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = dims[0]["dim"] if dims else 0
    plain = F.transform(v, lambda x: x + F.lit(0.0))  # -0.0 becomes 0.0
    return rows.where(F.size(v) == dim).withColumn("vec", plain).withColumns({"h1": F.xxhash64(v), "h2": F.xxhash64(F.lit(7), v)}), dim


def build(classes: DataFrame, dim: int) -> Index:
    """Fits centroids and graph on at most ``SAMPLE`` classes, those of least hash; every class is indexed later."""
    n, longest = classes.agg(F.count("*"), F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))).first()
    sample = classes.select("h1", "vec").orderBy("h1").limit(SAMPLE).toPandas()
    x = np.array(sample["vec"].tolist(), np.float64).reshape(-1, dim)
    index = Index(None, longest or 0.0, dim)
    k = max(1, min(MOST_LISTS, len(x) // 2, round(n**0.5)))
    index.graph = CentroidGraph(balanced_centroids(index.lift(x, False), k))
    return index


def true_neighbours(classes: DataFrame, asked: np.ndarray, k: int) -> list:
    """(query, h1, h2, vec) of the ``k`` classes of largest inner product with each row of ``asked``, by a scan of all."""
    dim = asked.shape[1]

    def scan(batches):
        kept: list[pa.Table] = [None] * len(asked)
        for batch in batches:
            t, x = pa.Table.from_batches([batch]), matrix(batch.column(2), dim)
            if not len(x):
                continue
            s = asked @ x.T
            m = min(k, len(x))
            for q, at in enumerate(np.argpartition(-s, m - 1, axis=1)[:, :m]):
                best = t.take(pa.array(at)).append_column("score", pa.array(s[q, at]))
                best = best if kept[q] is None else pa.concat_tables([kept[q], best])
                kept[q] = best.take(pa.array(np.argsort(-best["score"].to_numpy(), kind="stable")[:k]))
        for q, best in enumerate(kept):
            if best is not None:
                yield from best.append_column("query", pa.array(np.full(best.num_rows, q, np.int32))).select(["query", "score", "h1", "h2", "vec"]).combine_chunks().to_batches()

    found = classes.select("h1", "h2", "vec").mapInArrow(scan, "query int, score double, h1 long, h2 long, vec array<double>")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "h1", "h2")
    return found.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).select("query", "h1", "h2", "vec").collect()


def calibrate(index: Index, classes: DataFrame, asked: DataFrame, k: int, near: float, replicas: int, ratio: float, least: int, beam: int) -> tuple[float, int]:
    """``ratio`` and ``least``, raised until the lists that ``TRIED`` of the asked classes open hold ``AIM`` of their true neighbours.

    When ``least`` has reached the number of lists, all are open and all neighbours found.
    """
    tried = asked.orderBy("h2", "h1").limit(TRIED).select("h1", "h2", "vec").collect()
    if not tried:
        return ratio, least
    x, lists = np.array([r["vec"] for r in tried]), len(index.graph.c)
    true = [r for r in true_neighbours(classes, x, k + 1) if (r["h1"], r["h2"]) != (tried[r["query"]]["h1"], tried[r["query"]]["h2"])]
    if not true:
        return ratio, least
    stands = np.zeros((len(true), lists), bool)
    stands[index.lists(np.array([r["vec"] for r in true]), False, near, replicas, 1)] = True
    query = np.array([r["query"] for r in true])
    while True:
        opened = np.zeros((len(x), lists), bool)
        opened[index.lists(x, True, ratio, beam, least)] = True
        if least >= lists or (stands & opened[query]).any(axis=1).mean() >= AIM:
            return ratio, least
        ratio, least = 1 + 1.2 * (ratio - 1), least + 1 + least // 5


def nearest(vectors: DataFrame, queries, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", replicas: int = 4, near: float = 1.15, ratio: float = 1.13, least: int = 12, beam: int = 192) -> DataFrame:
    """For each row that the Column ``queries`` (over vec_id) selects, its ``k`` nearest others.

    Returns query_id, rank, vec_id, score (inner product in double precision), nearest first, ties
    to the smaller id.  An empty table gives no row; repeated rows count once; other columns
    are ignored.  A vector stands in at most ``replicas`` lists, those within ``near`` times its
    least distance; a query opens the lists within ``ratio``, ``least`` at least, both raised
    where :func:`calibrate` finds too few true neighbours in them, and more where it finds fewer than ``k``
    of any kind; its search begins with ``beam`` lists.
    A list of more than ``LIST_ROWS`` vectors or ``LIST_PROBES`` queries is dealt out to several tasks.
    """
    rows, dim = usable(vectors, vec_id, embedding)
    rows = rows.dropDuplicates(["vec_id", "h1", "h2"])
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    if not dim:
        return spark.createDataFrame([], out)
    first = Window.partitionBy("h1", "h2").orderBy("vec_id")
    classes = written(rows.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k + 1).groupBy("h1", "h2").agg(F.min_by("vec", "vec_id").alias("vec"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "vector-classes")
    fitted = build(classes, dim)
    index, lists_all = spark.sparkContext.broadcast(fitted), len(fitted.graph.c)

    def post(batches):
        for batch in batches:
            r, lists = index.value.lists(matrix(batch.column(0), dim), False, near, replicas, 1)
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), batch.column(0).take(pa.array(r)), batch.column(1).take(pa.array(r))], ["list", "vec", "ids"])

    posts = written(classes.select("vec", "ids").mapInArrow(post, "list int, vec array<double>, ids array<long>"), "posting-lists")
    asked = rows.where(queries).select("vec_id", "h1", "h2")
    kinds = classes.join(asked.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("vec", "h1", "h2")
    ratio, least = calibrate(fitted, classes, kinds, k, near, replicas, ratio, least, beam)
    wanted = min(k + 1, classes.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0])
    found, open_ = [], kinds
    while True:
        top = written(searched(posts, open_, index, dim, k, ratio, least, beam), "neighbours")
        short = F.size("ids") < wanted
        found.append(top if least >= lists_all else top.where(~short))
        if least >= lists_all or not top.where(short).limit(1).count():
            break
        open_ = kinds.join(top.where(short).select("h1", "h2"), ["h1", "h2"], "left_semi").select("vec", "h1", "h2")
        least = 4 * least
    top = reduce(DataFrame.unionByName, found)
    met = asked.join(top, ["h1", "h2"]).select("vec_id", F.arrays_zip("ids", "scores").alias("z"))
    others = F.slice(F.filter("z", lambda x: x["ids"] != F.col("vec_id")), 1, k)
    return met.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))


def parts_of(rows: DataFrame, lists: int, most: int) -> np.ndarray:
    """Into how many parts each list goes that ``most`` rows are to have; one number a list comes to the driver."""
    out = np.zeros(lists, np.int32)
    for r in rows.groupBy("list").count().collect():
        out[r["list"]] = -(-r["count"] // most)
    return out


def searched(posts: DataFrame, kinds: DataFrame, index: Broadcast, dim: int, k: int, ratio: float, least: int, beam: int) -> DataFrame:
    """(h1, h2, ids, scores): the ``k`` + 1 best ids of the lists that each query class (vec, h1, h2) opens.

    Both the vectors and the queries of a list are dealt into parts, and each part of the one meets each of the other in a task.
    """
    spark, lists_all = posts.sparkSession, len(index.value.graph.c)

    def open_lists(batches):
        for batch in batches:
            r, lists = index.value.lists(matrix(batch.column(0), dim), True, ratio, beam, least)
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), *[batch.column(i).take(pa.array(r)) for i in range(3)]], ["list", "vec", "h1", "h2"])

    probes = written(kinds.mapInArrow(open_lists, "list int, vec array<double>, h1 long, h2 long"), "probes")
    post_parts, probe_parts = (spark.sparkContext.broadcast(parts_of(df, lists_all, most)) for df, most in ((posts, LIST_ROWS), (probes, LIST_PROBES)))

    def deal(own: Broadcast, other: Broadcast, names: list[str]):
        """Each row goes to one part of its side, chosen by its place, and to all parts of the other."""

        def work(batches):
            for number, batch in enumerate(batches):
                lists = batch.column(0).to_numpy()
                mine = (np.arange(len(lists)) + number) % np.maximum(own.value[lists], 1)
                n = other.value[lists]
                r = np.repeat(np.arange(len(lists)), n)
                theirs = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
                both = dict(zip(names, (mine[r], theirs)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r)), *[pa.array(both[c].astype(np.int32)) for c in ("i", "j")], *[c.take(pa.array(r)) for c in batch.columns[1:]]], ["list", "i", "j", *batch.schema.names[1:]])

        return work

    left = posts.mapInArrow(deal(post_parts, probe_parts, ["i", "j"]), "list int, i int, j int, vec array<double>, ids array<long>")
    right = probes.mapInArrow(deal(probe_parts, post_parts, ["j", "i"]), "list int, i int, j int, vec array<double>, h1 long, h2 long")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        scores, found, qs = [], [], []
        if left.num_rows and right.num_rows:
            x, q = matrix(left.column("vec").combine_chunks(), dim), matrix(right.column("vec").combine_chunks(), dim)
            ids = left.column("ids").combine_chunks()
            counts = ids.value_lengths().to_numpy()
            flat, begin = ids.flatten().to_numpy(), np.cumsum(counts) - counts
            owner = np.repeat(np.arange(len(x)), counts)
            step = max(1, 4_000_000 // len(x))
            for a in range(0, len(q), step):
                s = q[a : a + step] @ x.T
                m = min(k + 1, len(x))
                edge = np.partition(s, len(x) - m, axis=1)[:, len(x) - m]
                for i, row in enumerate(s):
                    top = np.flatnonzero(row >= edge[i])  # ties at the edge included
                    members = np.concatenate([np.arange(begin[t], begin[t] + counts[t]) for t in top])
                    order = np.lexsort((flat[members], -row[owner[members]]))[: k + 1]
                    found.append(flat[members[order]])
                    scores.append(row[owner[members[order]]])
                    qs.append(a + i)
        n = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
        lists = lambda v, t: pa.ListArray.from_arrays(pa.array(n), pa.array(np.concatenate(v) if v else [], t))
        picked = right.select(["h1", "h2"]).take(pa.array(qs, pa.int64()))
        return pa.table({"h1": picked["h1"], "h2": picked["h2"], "ids": lists(found, pa.int64()), "scores": lists(scores, pa.float64())})

    pairs = left.groupBy("list", "i", "j").cogroup(right.groupBy("list", "i", "j")).applyInArrow(meet, "h1 long, h2 long, ids array<long>, scores array<double>")

    def best(batches):
        """Streams over rows sorted by query class; the best k + 1 of each."""
        key, ids, scores = None, [], []
        done: list[tuple] = []

        def close():
            i, s = np.concatenate(ids), np.concatenate(scores)
            order = np.lexsort((i, -s))
            i, s = i[order], s[order]
            _, one = np.unique(i, return_index=True)  # the same vector from several lists
            one = np.sort(one)[: k + 1]
            done.append((*key, i[one].tolist(), s[one].tolist()))

        def flush():
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
            out = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done), kinds)], ["h1", "h2", "ids", "scores"])
            done.clear()
            return out

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if row[:2] != key:
                    if key is not None:
                        close()
                    if len(done) >= 2000:
                        yield flush()
                    key, ids, scores = row[:2], [], []
                ids.append(np.array(row[2], np.int64))
                scores.append(np.array(row[3]))
        if key is not None:
            close()
        if done:
            yield flush()

    return pairs.repartition("h1", "h2").sortWithinPartitions("h1", "h2").mapInArrow(best, "h1 long, h2 long, ids array<long>, scores array<double>")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest others of every twentieth vector; see :func:`usable` for those that take no part."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
