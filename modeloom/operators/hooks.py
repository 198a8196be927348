"""Per-element functions."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from modeloom.tensor import Tensor

Hook = Callable[..., Column]


def arity(fn: Callable, n: int, what: str) -> None:
    """Raises unless ``fn`` can be called with ``n`` positional arguments."""
    try:
        inspect.signature(fn).bind(*range(n))
    except TypeError as e:
        raise ValueError(f"{what} must take {n} arguments: {e}") from None


def apply_hook(t: Tensor, hook: Hook | None) -> Tensor:
    """``hook(*labels, value)`` in the tensor's own order of labels; None leaves all as it is.

    Zeros without a row have no element, so a hook that maps zero to something else needs a
    dense tensor.
    """
    if hook is None:
        return t
    arity(hook, t.rank + 1, "hook")
    return t.like(t.df.withColumn(t.value, hook(*[F.col(m) for m in t.modes], F.col(t.value))))
