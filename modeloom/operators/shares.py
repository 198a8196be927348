"""Sums of products over labels that form cycles, in one shuffle.

Nested binary joins of a cycle of tensors, such as X[a,b] Y[b,c] Z[c,a], make all paths before
the last operand closes them.  Here each label has a share: tasks are the cells of a grid with an axis
for each label, a row goes to the cells that agree with the hashes of its labels, along all
of the axes it has no label for, and each cell joins what it got, label after label: a label's values are
those that all operands that have it allow, found from the operand with the fewest by lookup in
the sorted others.  So no intermediate is larger than the largest possible result of its labels.

Shares are chosen from counts: the rows of each operand and of its most frequent values,
so that no cell is expected to get more than ``CELL_ROWS``, where a frequent value is spread along
the other labels.  Where the copies are more than ``COPIED`` rows, none is made: each row is stored once, in the block that the hashes of its
own labels name, and a cell reads one block of each operand, so what is stored grows with the rows only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from modeloom.labels import distinct, merge_extents
from modeloom.operators.skew import Summary
from modeloom.sources import scratch
from modeloom.tensor import Tensor

#: Copies of rows up to which they are sent to cells.
COPIED = 20_000_000
#: Rows that a cell is to get at most; partial results that a cell extends at a time; cells are 2 to this power at most.
CELL_ROWS, CHUNK, MOST = 1_000_000, 1 << 18, 30
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class Load:
    """Labels and rows of an operand, and for each label the rows of its most frequent value."""

    labels: tuple[str, ...]
    rows: int
    hot: dict[str, int]

    def cell(self, shares: dict[str, int]) -> float:
        """Rows that the fullest cell is expected to get: even parts, or those of the most frequent value, spread by the other labels."""
        whole = float(np.prod([shares[m] for m in self.labels]))
        return max([self.rows / whole, *[n * shares[m] / whole for m, n in self.hot.items()]])

    def copies(self, shares: dict[str, int]) -> int:
        out = 1
        for m, s in shares.items():
            out *= 1 if m in self.labels else s
        return out


def loads(tensors: Sequence[Tensor]) -> list[Load]:
    """Counts of the operands, and of the most frequent value of each label by mergeable summaries; no row is shuffled."""
    out = []
    for t in tensors:
        found = most_frequent(t.df, t.modes)
        out.append(Load(t.modes, max([n for n, _ in found.values()], default=0), {m: hot for m, (_, hot) in found.items()}))
    return out


def most_frequent(df: DataFrame, labels: Sequence[str]) -> dict[str, tuple[int, int]]:
    """For each label the number of rows and the most that any value has, as summaries of ``COUNTERS`` values tell (exact if there are no more)."""
    labels = list(labels)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = [Summary() for _ in labels], 0
        for batch in batches:
            n += batch.num_rows
            for k, summary in enumerate(own):
                summary.add(batch.column(k).to_numpy())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(labels), pa.array([n] * len(own)), pa.array([s.values for s in own]), pa.array([s.counts for s in own]), pa.array([s.lost for s in own])], ["m", "n", "h", "c", "lost"])

    def merged(t: pa.Table) -> pa.Table:
        whole, n = Summary(), 0
        for rows, h, c, lost in zip(*(t[x].to_pylist() for x in ("n", "h", "c", "lost"))):
            whole.add(np.array(h, np.int64), np.array(c, np.int64))
            whole.lost += lost
            n += rows
        return pa.table({"m": t["m"].slice(0, 1), "n": [n], "hot": [int(whole.counts.max(initial=0)) + whole.lost]})

    made = df.select(*[F.xxhash64(F.col(m)).alias(f"h{k}") for k, m in enumerate(labels)]).mapInArrow(work, "m string, n long, h array<long>, c array<long>, lost long")
    return {r["m"]: (r["n"], r["hot"]) for r in made.groupBy("m").applyInArrow(merged, "m string, n long, hot long").collect()}  # a row for each label


def choose_shares(known: Sequence[Load], least: int = 1, cell_rows: int | None = None) -> dict[str, int]:
    """The share of each label: powers of two with the least expected load for their product, which grows from ``least`` until the load fits."""
    labels = list(dict.fromkeys(m for x in known for m in x.labels))
    limit = cell_rows or CELL_ROWS
    for total in range(max(0, least - 1).bit_length(), MOST + 1):
        best = None
        for bars in combinations(range(total + len(labels) - 1), len(labels) - 1):
            edges = [-1, *bars, total + len(labels) - 1]
            shares = {m: 1 << (b - a - 1) for m, a, b in zip(labels, edges, edges[1:])}
            load = sum(x.cell(shares) for x in known), sum(x.rows * x.copies(shares) for x in known)
            if best is None or load < best[0]:
                best = load, shares
        if best[0][0] <= limit:
            return best[1]
    raise ValueError(f"no shares keep a cell within {limit} rows")


def replicated(tensors: Sequence[Tensor], shares: dict[str, int], value: str) -> DataFrame:
    """(cell, which, labels..., v): the rows of all operands, each in every cell that agrees with its labels."""
    kinds = {m: t.df.schema[m].dataType for t in tensors for m in t.modes}
    kinds = {m: T.LongType() if isinstance(k, WHOLE) else k for m, k in kinds.items()}
    parts = []
    for k, t in enumerate(tensors):
        cell, stride, missing = F.lit(0).cast("long"), 1, []
        for m, s in shares.items():
            if m in t.modes:
                cell = cell + F.pmod(F.xxhash64(F.col(m).cast(kinds[m])), F.lit(s)) * stride
            else:
                missing.append((s, stride))
            stride *= s
        rows = t.df.where(" and ".join(f"`{m}` is not null" for m in t.modes) or "true")
        rows = rows.withColumn("__cell", cell)
        copies = int(np.prod([s for s, _ in missing], dtype=np.int64)) if missing else 1
        if copies > 1:
            at, place = F.col("__at"), F.lit(0).cast("long")
            for s, step in missing:
                place, at = place + (at % s) * step, F.call_function("div", at, F.lit(s))
            rows = rows.withColumn("__at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long")))).withColumn("__cell", F.col("__cell") + place)
        labels = [F.col(m).cast(kinds[m]).alias(m) if m in t.modes else F.lit(None).cast(kinds[m]).alias(m) for m in shares]
        parts.append(rows.select(F.col("__cell").alias("cell"), F.lit(k).alias("which"), *labels, F.col(t.value).cast(value).alias("v")))
    return reduce(DataFrame.unionByName, parts)


def once(t: Tensor, shares: dict[str, int], value: str, kinds: dict[str, T.DataType]) -> tuple[str, list[tuple[int, int]]]:
    """Stores the rows of an operand by blocks of its labels' hashes; the path, and (stride in cells, share) of each axis of its blocks."""
    axes, block, stride, size = [], F.lit(0).cast("long"), 1, 1
    for m, s in shares.items():
        if m in t.modes:
            block = block + F.pmod(F.xxhash64(F.col(m).cast(kinds[m])), F.lit(s)) * size
            axes.append((stride, s))
            size *= s
        stride *= s
    path = scratch(t.df.sparkSession, "shares")
    rows = t.df.where(" and ".join(f"`{m}` is not null" for m in t.modes)).select(block.alias("__block"), *[F.col(m).cast(kinds[m]).alias(m) for m in t.modes], F.col(t.value).cast(value).alias("v"))
    rows.repartition(size, "__block").write.partitionBy("__block").parquet(path)
    return path, axes


def read_cell(cell: int, stored: Sequence[tuple[str, list[tuple[int, int]]]], schema: pa.Schema) -> pa.Table:
    """The blocks of a cell, one of each operand."""
    parts = []
    for k, (path, axes) in enumerate(stored):
        block, size = 0, 1
        for stride, s in axes:
            block, size = block + cell // stride % s * size, size * s
        files, folder = fs.FileSystem.from_uri(f"{path}/__block={block}")
        found = [f.path for f in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.path.endswith(".parquet")]
        for f in found:
            t = pq.ParquetFile(files.open_input_file(f)).read()
            columns = [pa.array(np.full(t.num_rows, k, np.int32)) if x.name == "which" else t[x.name].cast(x.type) if x.name in t.column_names else pa.nulls(t.num_rows, x.type) for x in schema]
            parts.append(pa.table(columns, schema=schema))
    return pa.concat_tables(parts) if parts else schema.empty_table()


class Trie:
    """An operand sorted by its labels in one order for all: on each level, the children of a node are neighbours."""

    def __init__(self, columns: list[np.ndarray], widths: list[int], values: np.ndarray):
        order = np.lexsort(columns[::-1]) if columns else np.arange(len(values))
        columns, values = [c[order] for c in columns], values[order]
        new = np.zeros(len(values), bool)
        new[:1] = True
        self.keys, self.values, self.begin, node = [], [], [], np.zeros(len(values), np.int64)
        self.widths = widths
        for c, w in zip(columns, widths):
            new[1:] |= c[1:] != c[:-1]
            at = np.flatnonzero(new)
            parents = 1 if not self.keys else len(self.keys[-1])
            self.begin.append(np.searchsorted(node[at], np.arange(parents + 1)))
            self.keys.append(node[at] * w + c[at])
            self.values.append(c[at])
            node = np.cumsum(new) - 1
        self.totals = np.add.reduceat(values, np.flatnonzero(new)) if len(values) else values

    def degree(self, level: int, node: np.ndarray) -> np.ndarray:
        return self.begin[level][node + 1] - self.begin[level][node]

    def find(self, level: int, node: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The child of each node with the value, or -1."""
        keys, want = self.keys[level], node * self.widths[level] + value
        at = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
        return np.where(keys[at] == want, at, -1) if len(keys) else np.full(len(want), -1)


class LocalJoin:
    """Joins the operands of a cell, label after label, some partial results at a time; ``widest``: most partial results of each number of labels."""

    def __init__(self, labels: Sequence[str], operands: Sequence[tuple[tuple[str, ...], list[np.ndarray], np.ndarray]], widths: dict[str, int], chunk: int = CHUNK):
        self.labels, self.chunk = list(labels), chunk
        self.places = [[m for m in self.labels if m in modes] for modes, _, _ in operands]
        self.tries = [Trie([columns[modes.index(m)] for m in place], [widths[m] for m in place], v) for place, (modes, columns, v) in zip(self.places, operands)]
        self.widest = [0] * (len(self.labels) + 1)

    def results(self) -> Iterator[tuple[dict[str, np.ndarray], list[np.ndarray]]]:
        """(codes by label, node of each operand) of all results, in pieces."""
        if any(not len(t.totals) for t in self.tries):
            return
        stack = [(0, {}, [np.zeros(1, np.int64) for _ in self.tries])]
        while stack:
            depth, bound, nodes = stack.pop()
            n = len(nodes[0])
            self.widest[depth] = max(self.widest[depth], n)
            if not n:
                continue
            if depth == len(self.labels):
                yield bound, nodes
                continue
            label = self.labels[depth]
            own = [k for k, place in enumerate(self.places) if label in place]
            level = {k: self.places[k].index(label) for k in own}
            degrees = np.stack([self.tries[k].degree(level[k], nodes[k]) for k in own])
            fewest = degrees.min(axis=0)
            upto = np.cumsum(fewest)
            if n > 1 and upto[-1] > self.chunk:
                m = max(1, int(np.searchsorted(upto, self.chunk, "right")))
                for a, b in ((m, n), (0, m)):
                    stack.append((depth, {x: v[a:b] for x, v in bound.items()}, [v[a:b] for v in nodes]))
                continue
            choice = degrees.argmin(axis=0)
            rows, values, found = [], [], []
            for i, k in enumerate(own):
                some = np.flatnonzero((choice == i) & (fewest > 0))
                count = fewest[some]
                r = np.repeat(some, count)
                at = np.repeat(self.tries[k].begin[level[k]][nodes[k][some]] - (np.cumsum(count) - count), count) + np.arange(len(r))
                value, good = self.tries[k].values[level[k]][at], np.ones(len(r), bool)
                children = {k: at}
                for j in own:
                    if j != k:
                        children[j] = self.tries[j].find(level[j], nodes[j][r], value)
                        good &= children[j] >= 0
                rows.append(r[good])
                values.append(value[good])
                found.append([children[j][good] for j in own])
            r = np.concatenate(rows)
            now = [v[r] for v in nodes]
            for i, k in enumerate(own):
                now[k] = np.concatenate([f[i] for f in found])
            stack.append((depth + 1, {**{x: v[r] for x, v in bound.items()}, label: np.concatenate(values)}, now))

    def sums(self, out: Sequence[str], widths: dict[str, int]) -> tuple[list[np.ndarray], np.ndarray]:
        """Codes of the labels of ``out`` and the sum of products of each."""
        columns, sums = [np.zeros(0, np.int64) for _ in out], np.zeros(0, self.tries[0].totals.dtype)
        waiting: list[tuple[list[np.ndarray], np.ndarray]] = []

        def settle():
            parts = [(columns, sums), *waiting]
            return grouped([np.concatenate([p[0][i] for p in parts]) for i in range(len(out))], np.concatenate([p[1] for p in parts]))

        for bound, nodes in self.results():
            product = reduce(lambda x, y: x * y, [t.totals[v] for t, v in zip(self.tries, nodes)])
            if product.dtype == np.int64:
                rough = reduce(lambda x, y: x * y, [np.abs(t.totals[v].astype(np.float64)) for t, v in zip(self.tries, nodes)])
                if rough.sum() >= 2**62:
                    raise OverflowError("a sum of products exceeds 64 bits")
            waiting.append(grouped([bound[m] for m in out], product))
            if sum(len(w[1]) for w in waiting) > 4 * self.chunk:
                columns, sums = settle()
                waiting = []
        return settle()


def grouped(columns: list[np.ndarray], values: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sums of values by their columns; without columns, one sum."""
    if not len(values):
        return columns, values
    if not columns:
        return columns, values.sum(keepdims=True)
    order = np.lexsort(columns[::-1])
    columns, values = [c[order] for c in columns], values[order]
    new = np.ones(len(values), bool)
    new[1:] = reduce(lambda x, y: x | y, [c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.add.reduceat(values, at)


def einsum_shares(tensors: Sequence[Tensor], out: Sequence[str], cell_rows: int | None = None) -> Tensor:
    """``C[out] = sum over all other labels of the product`` of any number of tensors, in one shuffle of their rows and one of partial sums.

    For operands whose labels form cycles; where they form a tree, ``einsum`` sends less.  Rows with a null label
    are left out, rows with equal coordinates are added up; whole numbers are summed as 64-bit integers
    (an overflow is an error), all others as doubles.  Blocks, where rows are stored in them, stay in the shared folder as long as the result is read.
    """
    out = distinct(out, "output")
    extents = merge_extents(*[t.extents for t in tensors])
    if lost := [m for m in out if m not in extents]:
        raise ValueError(f"output labels {lost} are in no operand")
    if any(not t.rank for t in tensors):
        raise ValueError("an operand without labels")
    df = tensors[0].df
    value = "bigint" if all(isinstance(t.df.schema[t.value].dataType, WHOLE) for t in tensors) else "double"
    known = loads(tensors)
    shares = choose_shares(known, df.sparkSession.sparkContext.defaultParallelism, cell_rows)
    modes = [t.modes for t in tensors]
    order = sorted(shares, key=lambda m: -sum(m in x for x in modes))
    kind = np.int64 if value == "bigint" else np.float64

    def local(t: pa.Table) -> pa.Table:
        which = t["which"].to_numpy()
        coded = {m: t[m].combine_chunks().dictionary_encode() for m in shares}
        widths = {m: max(1, len(c.dictionary)) for m, c in coded.items()}
        codes = {m: c.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for m, c in coded.items()}
        values = t["v"].to_numpy().astype(kind)
        operands = [(x, [codes[m][which == k] for m in x], values[which == k]) for k, x in enumerate(modes)]
        columns, sums = LocalJoin(order, operands, widths).sums(out, widths)
        return pa.table([*[coded[m].dictionary.take(pa.array(c)) for m, c in zip(out, columns)], pa.array(sums)], [*out, "v"])

    rows = replicated(tensors, shares, value)
    schema = T.StructType([*[T.StructField(m, rows.schema[m].dataType) for m in out], T.StructField("v", T.LongType() if value == "bigint" else T.DoubleType())])
    if sum(x.rows * x.copies(shares) for x in known) <= COPIED:
        met = rows.groupBy("cell").applyInArrow(local, schema)
    else:
        kinds = {m: rows.schema[m].dataType for m in shares}
        stored = [once(t, shares, value, kinds) for t in tensors]
        held = to_arrow_schema(rows.drop("cell").schema)
        cells = int(np.prod(list(shares.values())))

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for cell in batch.column(0).to_pylist():
                    yield from local(read_cell(cell, stored, held)).cast(to_arrow_schema(schema)).combine_chunks().to_batches()

        met = df.sparkSession.range(0, cells, 1, cells).mapInArrow(joined, schema)
    df = met.groupBy(*out).agg(F.sum("v").alias("v")) if out else met.agg(F.coalesce(F.sum("v"), F.lit(0).cast(value)).alias("v"))
    return Tensor(df, out, "v", {m: extents[m] for m in out})
