"""Products of array columns as plain expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(x: str | Column, y: str | Column) -> Column:
    """Inner product of two array columns in double precision; null where an array or an element is null, an error where lengths differ."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    total = F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(x) == F.size(y), total).when(x.isNull() | y.isNull(), F.lit(None)).otherwise(F.raise_error(F.lit("arrays of different lengths")))
