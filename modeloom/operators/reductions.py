"""Reductions with a state of several columns, given by three functions.

``lift`` makes the state of each element, ``merge`` that of two states (associative and
commutative), ``finish`` the result; all take and give arrays.  States are merged in each task before the
shuffle, and again behind it, so no more than a state for each coordinate and task is sent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modeloom.tensor import Tensor

State = tuple[np.ndarray, ...]
#: States that a task holds before it sends them on.
HELD = 200_000


@dataclass(frozen=True)
class Reduction:
    """``lift(values)`` and ``merge(x, y)`` give a tuple of ``width`` arrays of doubles, ``finish(*state)`` an array."""

    width: int
    lift: Callable[[np.ndarray], State]
    merge: Callable[[State, State], State]
    finish: Callable[..., np.ndarray]


def _log_sum_merge(x: State, y: State) -> State:
    most = np.maximum(x[0], y[0])
    shift = lambda m: np.where(m == most, 1.0, np.exp(np.minimum(m - most, 0)))
    return most, x[1] * shift(x[0]) + y[1] * shift(y[0])


def _moments_merge(x: State, y: State) -> State:
    n, apart = x[0] + y[0], y[1] - x[1]
    return n, x[1] + apart * y[0] / n, x[2] + y[2] + apart * apart * x[0] * y[0] / n


#: log(sum(exp(v))), which neither overflows nor underflows.
LOG_SUM_EXP = Reduction(2, lambda v: (v, np.ones(len(v))), _log_sum_merge, lambda m, s: m + np.log(s))
#: Population variance from counts, means and squared deviations.
VARIANCE = Reduction(3, lambda v: (np.ones(len(v)), v, np.zeros(len(v))), _moments_merge, lambda n, _, m2: m2 / n)


def merged(group: np.ndarray, state: State, merge: Callable[[State, State], State]) -> tuple[np.ndarray, State]:
    """One state for each group: neighbours of a group are merged in pairs, until one is left."""
    order = np.argsort(group, kind="stable")
    group, state = group[order], tuple(s[order] for s in state)
    while True:
        first = np.ones(len(group), bool)
        first[1:] = group[1:] != group[:-1]
        if first.all():
            return group, state
        at = np.arange(len(group)) - np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))
        right = np.flatnonzero(at % 2 == 1)
        both = merge(tuple(s[right - 1] for s in state), tuple(s[right] for s in state))
        state = tuple(s.copy() for s in state)
        for s, b in zip(state, both):
            s[right - 1] = b
        keep = at % 2 == 0
        group, state = group[keep], tuple(s[keep] for s in state)


def reduce_with(t: Tensor, out: Sequence[str], reduction: Reduction) -> Tensor:
    """``C[out]``: the reduction of all elements over the other labels, as doubles.

    Null values are left out; a coordinate without any has no row, nor has a tensor without rows; null labels are coordinates like others.
    """
    out = tuple(out)
    if lost := [m for m in out if m not in t.modes]:
        raise ValueError(f"the tensor has no labels {lost}")
    states = [f"s{i}" for i in range(reduction.width)]
    kinds = [T.StructField(m, t.df.schema[m].dataType) for m in out]
    schema = T.StructType([*kinds, *[T.StructField(s, T.DoubleType()) for s in states]])

    def grouped(table: pa.Table, state: State) -> pa.Table:
        group, width = np.zeros(table.num_rows, np.int64), 1
        for m in out:
            codes = table[m].combine_chunks().dictionary_encode(null_encoding="encode")
            if width * (len(codes.dictionary) + 1) >= 2**62:
                _, group = np.unique(group, return_inverse=True)
                width = int(group.max(initial=0)) + 1
            group, width = group * len(codes.dictionary) + codes.indices.to_numpy(zero_copy_only=False), width * max(1, len(codes.dictionary))
        kinds, first = np.unique(group, return_index=True)
        _, state = merged(group, state, reduction.merge)
        return pa.table([*[table[m].combine_chunks().take(pa.array(first)) for m in out], *map(pa.array, state)], [*out, *states])

    def step(lift: bool, last: bool):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.Table] = []
            for batch in batches:
                table = pa.Table.from_batches([batch])
                state = reduction.lift(table["__v"].to_numpy()) if lift else tuple(table[s].to_numpy() for s in states)
                held.append(grouped(table, state))
                if not last and sum(h.num_rows for h in held) > HELD or len(held) > 64:
                    held = [again(held)]
                    if not last and held[0].num_rows > HELD // 2:
                        yield from held[0].to_batches()
                        held = []
            if held:
                made = again(held)
                if last:
                    values = reduction.finish(*[made[s].to_numpy() for s in states])
                    made = pa.table([*[made[m] for m in out], pa.array(values)], [*out, "v"])
                yield from made.combine_chunks().to_batches()

        def again(held: list[pa.Table]) -> pa.Table:
            table = pa.concat_tables(held).combine_chunks()
            return grouped(table, tuple(table[s].to_numpy() for s in states))

        return work

    rows = t.df.where(F.col(t.value).isNotNull()).select(*out, F.col(t.value).cast("double").alias("__v"))
    partial = rows.mapInArrow(step(True, False), schema)
    dealt = partial.repartition(*out) if out else partial.repartition(1)
    df = dealt.mapInArrow(step(False, True), T.StructType([*kinds, T.StructField("v", T.DoubleType())]))
    return Tensor(df, out, "v", {m: t.extents[m] for m in out})
