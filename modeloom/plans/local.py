"""Graphs whose operations are all local to one label, run on whole blocks of it as dense arrays.

Where every node keeps a label (such as the element of a mesh) and sums only others, the rows of
one value of that label are all that its results need.  The table is dealt by the label once;
tasks then take many whole values at a time, put them into dense arrays with an axis for each label,
and run the nodes on these: contractions as matrix products, combinations and hooks by the same
functions, called with arrays in place of columns.  Nothing else is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modeloom.labels import gather, plan_contraction
from modeloom.operators.contract import outputs
from modeloom.plans.graph import Dag, Node
from modeloom.tensor import Tensor


def columns_of(df: DataFrame, labels: Sequence[str], values: Sequence[str], extents: dict[str, int | None]) -> list[Tensor]:
    """Tensors of several value columns of one table."""
    return outputs(df, labels, list(values), {m: extents.get(m) for m in labels}, False)


def small_array(t: Tensor) -> np.ndarray:
    """A tensor whose extents prove it small, as an array on the driver; coordinates without a row are zeros, those out of range or repeated are an error."""
    if not t.small:
        raise ValueError(f"the extents {t.extents} do not prove that the tensor is small")
    shape = tuple(t.extents.values())
    rows = t.df.limit(t.size + 1).collect()
    at = np.array([tuple(r)[:-1] for r in rows], np.int64).reshape(len(rows), len(shape))
    return scattered(at.T, shape, [np.array([r[t.value] for r in rows], float)])[0]


def scattered(at: Sequence[np.ndarray], shape: Sequence[int], values: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Dense arrays of values at coordinates; raises for one that is out of range or occurs twice."""
    place = np.zeros(len(values[0]) if values else 0, np.int64)
    for x, n in zip(at, shape):
        if len(x) and (x.min() < 0 or x.max() >= n):
            raise ValueError(f"a coordinate lies outside of {n} points")
        place = place * n + x
    size = int(np.prod(shape))
    if len(place) and np.bincount(place, minlength=size).max() > 1:
        raise ValueError("a coordinate occurs twice")
    out = []
    for v in values:
        dense = np.zeros(size)
        dense[place] = v
        out.append(dense.reshape(shape))
    return out


def contracted(a: np.ndarray, a_modes: Sequence[str], b: np.ndarray, b_modes: Sequence[str], out: Sequence[str]) -> np.ndarray:
    """Sum of products over the labels of both, its axes as ``out`` says."""
    plan = plan_contraction(a_modes, b_modes, out)
    made = np.tensordot(a, b, ([list(a_modes).index(m) for m in plan.contracted], [list(b_modes).index(m) for m in plan.contracted]))
    return np.transpose(made, gather(plan.canonical, plan.out))


def spread(a: np.ndarray, modes: Sequence[str], out: Sequence[str]) -> np.ndarray:
    """``a`` with its axes in the order of ``out``, and axes of length 1 for labels that it lacks."""
    a = np.transpose(a, [list(modes).index(m) for m in out if m in modes])
    return a.reshape([a.shape[[x for x in out if x in modes].index(m)] if m in modes else 1 for m in out])


@dataclass
class Local:
    """What tasks need of a graph: its nodes without tables, their inputs by name of column, and the small arrays."""

    nodes: list
    roots: list[int]

    def run(self, fields: dict[str, np.ndarray], first: np.ndarray, by: str) -> list[np.ndarray]:
        """Arrays of the roots for whole values ``first`` of the label ``by``."""
        slots: list[np.ndarray] = []
        for node in self.nodes:
            slots += self._value(node, slots, fields, first, by)
        return [slots[s] for s in self.roots]

    def _value(self, node: tuple, slots: list, fields: dict, first: np.ndarray, by: str) -> list[np.ndarray]:
        kind, modes, operands, extra, fn = node
        parts = [self._value(x, slots, fields, first, by)[0] for x in operands]
        if kind == "field":
            return [hooked(fields[extra], modes, fn, first, by)]
        if kind == "small":
            return [hooked(extra, modes, fn, first, by)]
        if kind == "slot":
            return [slots[extra]]
        if kind in ("relabel", "stage"):
            return parts
        if kind == "contraction":
            return [hooked(contracted(parts[0], operands[0][1], parts[1], operands[1][1], modes), modes, fn, first, by)]
        values = [spread(p, x[1], modes) for p, x in zip(parts, operands)]
        shape = np.broadcast_shapes(*[v.shape for v in values])
        made = fn(*coordinates_of(modes, shape, first, by), *values, *[spread(w, m, modes) for w, m in extra])
        return [np.broadcast_to(v, shape) for v in (made if isinstance(made, (list, tuple)) else [made])]


def coordinates_of(modes: Sequence[str], shape: Sequence[int], first: np.ndarray, by: str) -> list[np.ndarray]:
    return [spread(first if m == by else np.arange(n), [m], modes) for m, n in zip(modes, shape)]


def hooked(a: np.ndarray, modes: Sequence[str], hook: Callable | None, first: np.ndarray, by: str) -> np.ndarray:
    return a if hook is None else np.broadcast_to(hook(*coordinates_of(modes, a.shape, first, by), a), a.shape)


def localised(dag: Dag, by: str) -> tuple[Local, list[Tensor]]:
    """The graph for tasks, and the inputs that have the label ``by``; raises where a node is not local to it."""
    inputs: list[Tensor] = []
    arrays: dict[int, np.ndarray] = {}

    def once(t: Tensor) -> np.ndarray:
        """A small tensor that several nodes read is collected once."""
        if id(t) not in arrays:
            arrays[id(t)] = small_array(t)
        return arrays[id(t)]

    def lower(node: Node) -> tuple:
        operands = tuple(lower(x) for x in node.operands)
        if node.kind == "input":
            t = node.source
            if by not in t.modes:
                return "small", t.modes, (), once(t), node.fn
            inputs.append(t)
            return "field", t.modes, (), t.value, node.fn
        if node.kind == "slot":
            return "slot", node.modes, (), node.slot, None
        if node.kind == "contraction" and all(by in x.modes for x in node.operands):
            raise ValueError(f"a contraction sums the label {by!r}")
        weights = tuple((once(w), w.modes) for w in node.weights)
        return node.kind, node.modes, operands, weights, node.fn

    nodes = [lower(n) for n in dag.nodes]
    if not dag.roots:
        raise ValueError("no outputs are designated")
    return Local(nodes, [h.slot for h in dag.roots]), inputs


def deal(df: DataFrame, by: str) -> DataFrame:
    """Rows dealt to as many tasks as the session has shuffle partitions by the label ``by``, whole numbers, and in its order there."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), by).sortWithinPartitions(by)


def execute_local(dag: Dag, by: str, names: Sequence[str], dealt: bool = False) -> DataFrame:
    """The roots of a graph as one DataFrame, its labels and a column for each root, from one shuffle by the label ``by``.

    ``dealt``: the table was made row by row of what :func:`deal` returned, so it is not shuffled again; where each value of the
    label becomes many rows, these are then made in as many tasks as read them and never sent.  Rows out of order are an error.

    All inputs with that label are columns of one table over the same labels; their other labels have known extents, and a
    coordinate without a row is a zero.  Roots have the same labels.  Functions of nodes are called with arrays, so they are made of
    operators that columns and arrays share.  A coordinate outside of the extents, or one that occurs twice, is an error.
    """
    graph, inputs = localised(dag, by)
    if not inputs:
        raise ValueError(f"no input has the label {by!r}")
    frame, labels = getattr(inputs[0], "frame", inputs[0].df), inputs[0].modes
    if any(getattr(t, "frame", t.df) is not frame or t.modes != labels for t in inputs):
        raise ValueError("inputs that are dealt must be columns of one table")
    inner = [m for m in labels if m != by]
    shape = [inputs[0].extents[m] for m in inner]
    if None in shape:
        raise ValueError("labels besides the one by which a graph is dealt need extents")
    values = list(dict.fromkeys(t.value for t in inputs))
    modes = [h.modes for h in dag.roots]
    if any(m != modes[0] for m in modes) or modes[0][0] != by:
        raise ValueError(f"roots must have the same labels, {by!r} first")
    order = [[by, *inner].index(m) for m in labels]
    schema = T.StructType([*[T.StructField(m, T.LongType()) for m in modes[0]], *[T.StructField(n, T.DoubleType()) for n in names]])

    def block(t: pa.Table) -> pa.RecordBatch:
        first, place = np.unique(t[by].to_numpy(), return_inverse=True)
        at = [place, *[t[m].to_numpy() for m in inner]]
        dense = scattered(at, [len(first), *shape], [t[v].to_numpy() for v in values])
        made = graph.run({v: np.transpose(x, order) for v, x in zip(values, dense)}, first, by)
        index = np.indices(made[0].shape).reshape(made[0].ndim, -1)
        columns = [first[index[0]], *index[1:], *[m.ravel() for m in made]]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], schema.names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            if (np.diff(ids) < 0).any() or (held and held[-1].column(0)[-1].as_py() > ids[0]):
                raise ValueError(f"rows are not in the order of {by!r}")
            whole = int(np.searchsorted(ids, ids[-1]))  # the last value may go on
            if whole or (held and held[-1].column(0)[-1].as_py() != ids[0]):
                made = pa.Table.from_batches([*held, batch.slice(0, whole)])
                if made.num_rows:
                    yield block(made)
                held = []
            held.append(batch.slice(whole))
        if held:
            yield block(pa.Table.from_batches(held))

    rows = frame.select(F.col(by).cast("long").alias(by), *[F.col(m).cast("long").alias(m) for m in inner], *[F.col(v).cast("double").alias(v) for v in values])
    return (rows if dealt else rows.repartition(by).sortWithinPartitions(by)).mapInArrow(work, schema)
