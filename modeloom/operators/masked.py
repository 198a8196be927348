"""Contractions of which only some elements are wanted, and diagonals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from modeloom.labels import distinct, merge_extents, plan_contraction
from modeloom.operators.contract import SEMIRINGS, sized
from modeloom.tensor import Tensor


def contract_masked(a: Tensor, b: Tensor, mask: Tensor, semiring: str = "sum_product") -> Tensor:
    """The elements of the contraction of ``a`` and ``b`` at the coordinates of ``mask``; its labels are all free labels.

    Joins begin with the mask, so that no product is made whose element is not wanted: the mask meets ``a`` by its labels,
    and what that gives meets ``b`` by summed and masked labels at once.  Rows of ``b`` without a masked coordinate go before their
    shuffle where Spark's runtime filters see it pay.  The values of the mask are not read, repeated coordinates count once; a masked coordinate without products has no row.
    """
    plan = plan_contraction(a.modes, b.modes, mask.modes)
    extents = merge_extents(a.extents, b.extents, mask.extents)
    wanted = mask.df.select(*mask.modes).distinct()
    left, right = a.columns("__x"), b.columns("__y")
    if not plan.free_a and not a.small:
        raise ValueError("an operand without free labels: its extents must prove it small")
    one = wanted.join(sized(left, a.small), list(plan.free_a)) if plan.free_a else wanted.crossJoin(F.broadcast(left))
    if not plan.contracted and not plan.free_b:
        raise ValueError("the second operand shares no label with the mask or the first")
    met = one.join(sized(right, b.small), [*plan.contracted, *plan.free_b])
    add, times = SEMIRINGS[semiring]
    df = met.groupBy(*mask.modes).agg(add(times(F.col("__x"), F.col("__y"))).alias("v"))
    made = Tensor(df, mask.modes, "v", {m: extents[m] for m in mask.modes})
    made.joined = met
    return made


def diagonal(t: Tensor, *labels: str) -> Tensor:
    """The tensor under other labels, by position, of which some are the same: only elements whose coordinates agree there are left.

    ``diagonal(A, "i", "i", "k")`` is ``A[i,i,k]``.  The equality is a filter on the columns, evaluated where the table is read.
    """
    if len(labels) != t.rank:
        raise ValueError(f"{len(labels)} labels for a tensor of rank {t.rank}")
    df, first, extents = t.df, {}, {}
    for m, x in zip(t.modes, labels):
        n = t.extents[m]
        if x in first:
            df = df.where(F.col(first[x]) == F.col(m))
            n = n if extents[x] is None else extents[x] if n is None else min(n, extents[x])
        first.setdefault(x, m)
        extents[x] = n
    if t.value in first:
        raise ValueError(f"{t.value!r} is both label and value")
    df = df.select(*[F.col(m).alias(x) for x, m in first.items()], F.col(t.value))
    same = {t.extents[m] for m in t.modes}
    return Tensor(df, distinct(list(first), "diagonal"), t.value, extents, t.dense and len(same) == 1)


def trace(t: Tensor, *labels: str, out: Sequence[str] = ()) -> Tensor:
    """Sum of a diagonal over all labels that ``out`` does not name."""
    own = diagonal(t, *labels)
    if lost := [m for m in out if m not in own.modes]:
        raise ValueError(f"the diagonal has no labels {lost}")
    total = F.sum(own.value).alias("v")
    df = own.df.groupBy(*out).agg(total) if out else own.df.agg(F.coalesce(total, F.lit(0)).alias("v"))
    return Tensor(df, tuple(out), "v", {m: own.extents[m] for m in out})
