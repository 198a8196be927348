"""Sums of products over shared labels, as join and aggregate.

The join is an equi-join on the summed labels; a side whose extents prove it small (the smaller
of two such) is broadcast, any other strategy is left to the optimiser and adaptive execution.  Products
are added up before the shuffle of the aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modeloom.labels import merge_extents, plan_contraction
from modeloom.operators.hooks import Hook, apply_hook
from modeloom.tensor import Tensor

#: (add, multiply) pairs.
SEMIRINGS: dict[str, tuple[Callable, Callable]] = {
    "sum_product": (F.sum, lambda x, y: x * y),
    "max_plus": (F.max, lambda x, y: x + y),
    "min_plus": (F.min, lambda x, y: x + y),
    "max_min": (F.max, lambda x, y: F.least(x, y)),
    "or_and": (F.max, lambda x, y: ((x != 0) & (y != 0)).cast("long")),
}


def sized(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def in_range(df: DataFrame, t: Tensor) -> DataFrame:
    """Rows of a side that is broadcast because of its extents; a label outside of them is an error when the side is read."""
    fine = F.lit(True)
    for m, n in t.extents.items():
        fine &= F.col(m).isNull() | F.col(m).between(0, n - 1)
    return df.where(F.when(fine, F.lit(True)).otherwise(F.raise_error(F.lit(f"a label lies outside of the extents {t.extents}")).cast("boolean")))


def contract(a: Tensor, b: Tensor, out: Sequence[str] | None = None, hook: Hook | None = None, semiring: str = "sum_product", batch: Sequence[str] = ()) -> Tensor:
    """``C[out] = sum over shared labels of A * B``; ``hook`` is applied to the result.

    Labels in ``batch`` are shared but kept (an extension, as are semirings other than the
    sum of products, and operands without a shared label).
    """
    return contract_many([a], b, out, [hook], semiring, batch)[0]


def contract_many(many: Sequence[Tensor], b: Tensor, out: Sequence[str] | None = None, hooks: Sequence[Hook | None] = (), semiring: str = "sum_product", batch: Sequence[str] = ()) -> list[Tensor]:
    """Contractions of several tensors, all values of one DataFrame, with ``b``: one join and one aggregate for all."""
    a = many[0]
    if any(t.modes != a.modes for t in many):
        raise ValueError("tensors contracted together must have the same labels")
    if len(many) > 1 and not all(hasattr(t, "frame") and t.frame is many[0].frame for t in many):
        raise ValueError("tensors contracted together must be outputs of one operation")
    batch = tuple(batch)
    if lost := [x for x in batch if x not in a.modes or x not in b.modes]:
        raise ValueError(f"batch labels {lost} are not in both operands")
    strip = lambda modes: tuple(m for m in modes if m not in batch)
    wanted = None if out is None else strip(out)
    plan = plan_contraction(strip(a.modes), strip(b.modes), wanted)
    out = batch + plan.out if out is None else tuple(out)
    extents = merge_extents(a.extents, b.extents)
    xs = [f"__x{i}" for i in range(len(many))]
    frame = many[0].frame if len(many) > 1 else a.df
    left = frame.select(*a.modes, *[F.col(t.value).alias(x) for t, x in zip(many, xs)])
    right = b.columns("__y")
    on = [*batch, *plan.contracted]
    if b.small and not (a.small and a.size < b.size):
        right = F.broadcast(in_range(right, b))
    elif a.small:
        left = F.broadcast(in_range(left, a))
    if not on and not (a.small or b.small):
        raise ValueError("operands without a shared label: the extents of one must prove it small")
    joined = left.join(right, on) if on else left.crossJoin(right)
    add, times = SEMIRINGS[semiring]
    names = ["v"] if len(many) == 1 else [f"v{i}" for i in range(len(many))]
    sums = [add(times(F.col(x), F.col("__y"))).alias(n) for x, n in zip(xs, names)]
    df = joined.groupBy(*out).agg(*sums) if out else joined.agg(*[F.coalesce(s, F.lit(0)).alias(n) for s, n in zip(sums, names)])
    dense = all(t.dense for t in many) and b.dense and 0 not in [extents[m] for m in plan.contracted]
    made = outputs(df, out, names, {m: extents[m] for m in out}, dense)
    return [apply_hook(t, h) for t, h in zip(made, [*hooks, *[None] * len(made)])]


def outputs(df: DataFrame, modes: Sequence[str], names: Sequence[str], extents: dict, dense: bool) -> list[Tensor]:
    """Handles of the value columns of one DataFrame."""
    out = [Tensor(df, modes, n, extents, dense) for n in names]
    for t in out:
        t.frame = df
    return out


def outer(a: Tensor, b: Tensor, out: Sequence[str] | None = None) -> Tensor:
    """Product without a shared label; a side must be small enough by its extents (extension)."""
    if set(a.modes) & set(b.modes):
        raise ValueError("operands of an outer product share a label")
    if not (a.small or b.small):
        raise ValueError("an outer product needs one operand whose extents prove it small")
    return contract(a, b, out)


def scalar(a: Tensor, b: Tensor) -> Tensor:
    """The sum over all labels: a tensor of rank 0 (extension)."""
    if set(a.modes) != set(b.modes):
        raise ValueError("label sets differ")
    return contract(a, b, ())


def reduce_modes(t: Tensor, *modes: str, add: Callable[[Column], Column] = F.sum) -> Tensor:
    """Sum (or another aggregate) over labels of one tensor (extension)."""
    if lost := [m for m in modes if m not in t.modes]:
        raise ValueError(f"the tensor has no labels {lost}")
    keep = [m for m in t.modes if m not in modes]
    return t.like(t.df.groupBy(*keep).agg(add(F.col(t.value)).alias(t.value)), keep, {m: t.extents[m] for m in keep})


def chain_order(labels: Sequence[Sequence[str]], out: Sequence[str], extents: dict[str, int | None]) -> tuple:
    """The cheapest nesting of contractions of up to a dozen tensors, by dynamic programming over subsets.

    Cost is the number of products, from extents (unknown ones count as 1000).  Returns nested
    pairs of positions.
    """
    n = len(labels)
    size = lambda names: float(math.prod(extents.get(x) or 1000 for x in names))
    best: dict[frozenset, tuple[float, object, frozenset]] = {frozenset([i]): (0.0, i, frozenset(x)) for i, x in enumerate(labels)}
    everything = frozenset(range(n))
    for k in range(2, n + 1):
        for group in map(frozenset, combinations(range(n), k)):
            outside = set(out).union(*[labels[i] for i in everything - group])
            for j in range(1, k // 2 + 1):
                for part in map(frozenset, combinations(sorted(group), j)):
                    (ca, ta, la), (cb, tb, lb) = best[part], best[group - part]
                    cost = ca + cb + size(la | lb)
                    if group not in best or cost < best[group][0]:
                        best[group] = (cost, (ta, tb), frozenset((la | lb) & outside))
    return best[everything][1]


def einsum(tensors: Sequence[Tensor], out: Sequence[str]) -> Tensor:
    """Contraction of many tensors, nested in the order that needs the fewest products (extension).

    A label is summed once no other tensor and no output needs it.
    """
    extents = merge_extents(*[t.extents for t in tensors])
    labels = [t.modes for t in tensors]
    order = chain_order(labels, out, extents) if len(tensors) > 1 else 0

    def build(node, needed: set[str]) -> Tensor:
        if isinstance(node, int):
            t = tensors[node]
            gone = [m for m in t.modes if m not in needed]
            return reduce_modes(t, *gone) if gone else t
        members = lambda x: [x] if isinstance(x, int) else members(x[0]) + members(x[1])
        a, b = node
        own = lambda x: set().union(*[labels[i] for i in members(x)])
        left, right = build(a, needed | own(b)), build(b, needed | own(a))
        shared = [m for m in left.modes if m in right.modes]
        keep = [m for m in (*left.modes, *right.modes) if m in needed]
        keep = list(dict.fromkeys(keep))
        return contract(left, right, keep, batch=[m for m in shared if m in needed])

    made = build(order, set(out))
    return made.permute(*out)
