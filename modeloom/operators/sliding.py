"""Contractions with a band along an ordered label: stencils and moving sums.

The label is cut into blocks.  A row goes to its own block and to those whose results it enters across
a border, so beside the rows themselves only as many values of the label as the band is wide
are sent again at each border.  Within a block the band is a window with a range of values.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modeloom.operators.ranges import ticks
from modeloom.tensor import Tensor

#: Values of the label in a block.
BLOCK = 4096


def dealt_along(t: Tensor, along: str, low: int, high: int, block: int = BLOCK) -> DataFrame:
    """The rows of ``t`` with ``__x``, the label as a number, ``__block``, and ``__own``: whether the block is the row's own.

    A row is there for each block that holds a place from ``__x - high`` to ``__x - low``, and its own.
    """
    if along not in t.modes:
        raise ValueError(f"the tensor has no label {along!r}")
    if low > high:
        raise ValueError(f"a band from {low} to {high}")
    if block < 1:
        raise ValueError("a block of no values")
    x = ticks(F.col(along), t.df.schema[along].dataType)
    of = lambda c: F.floor(c / F.lit(block)) if block & (block - 1) else F.shiftright(c, block.bit_length() - 1)
    rows = t.df.where(F.col(along).isNotNull()).withColumn("__x", x).withColumn("__home", of(F.col("__x")))
    first, last = F.least("__home", of(F.col("__x") - high)), F.greatest("__home", of(F.col("__x") - low))
    near = F.array_distinct(F.concat(F.array("__home"), F.sequence(of(F.col("__x") - high), of(F.col("__x") - low))))
    blocks = F.when(first == last, F.array("__home")).otherwise(near)
    return rows.withColumn("__block", F.explode(blocks)).withColumn("__own", F.col("__block") == F.col("__home")).drop("__home")


def banded(t: Tensor, along: str, low: int, high: int, value: Callable, block: int) -> Tensor:
    others = [m for m in t.modes if m != along]
    window = Window.partitionBy(*others, "__block").orderBy("__x")
    made = dealt_along(t, along, low, high, block).withColumn("__v", value(window)).where("__own")
    return t.like(made.select(*t.modes, F.col("__v").alias(t.value)))


def stencil(t: Tensor, along: str, weights: Mapping[int, float], block: int = BLOCK) -> Tensor:
    """``C[..., x] = sum over offsets o of weights[o] * A[..., x + o]``, at the coordinates that ``t`` has.

    A neighbour without a row is a zero.  ``along``: whole numbers, dates (in days) or times (in microseconds); rows without it are left out.  Coordinates are unique.
    A block of one coordinate of the other labels has ``block`` rows at most, and as many more as the band is wide.
    """
    if not weights:
        raise ValueError("a stencil without weights")
    if block & (block - 1):
        raise ValueError("the block must be a power of two")
    kind = t.df.schema[t.value].dataType

    def value(window: Window) -> Column:
        at = lambda o: F.coalesce(F.sum(t.value).over(window.rangeBetween(o, o)), F.lit(0))
        terms = [at(o) * F.lit(w) for o, w in sorted(weights.items())]
        total = terms[0]
        for x in terms[1:]:
            total = total + x
        return total if any(isinstance(w, float) for w in weights.values()) else total.cast(kind)

    return banded(t, along, min(weights), max(weights), value, block)


def moving(t: Tensor, along: str, low: int, high: int, add: Callable[[str], Column] = F.sum, block: int = BLOCK) -> Tensor:
    """``C[..., x]``: the sum (or another aggregate) of ``A[..., y]`` for y from x + ``low`` to x + ``high``, at the coordinates that ``t`` has; rows as in :func:`stencil`."""
    if block & (block - 1):
        raise ValueError("the block must be a power of two")
    return banded(t, along, low, high, lambda window: add(t.value).over(window.rangeBetween(low, high)), block)
