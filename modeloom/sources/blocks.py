"""Tensors stored by blocks of labels, so that those stored alike meet without a shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from modeloom.labels import distinct
from modeloom.operators.contract import contract
from modeloom.tensor import Tensor, quotient


def store_blocks(t: Tensor, table: str, by: Sequence[str], buckets: int, sizes: Mapping[str, int] | None = None) -> None:
    """Writes a tensor as the table ``table`` of Spark's catalogue, bucketed and sorted by the labels ``by``; an existing one is an error.

    ``sizes``: labels that are cut into blocks; rows are then also in a folder for each combination of block numbers, of
    which a read of some blocks opens only their own.  Labels are not null.
    """
    by, sizes = distinct(by, "labels of buckets"), dict(sizes or {})
    if lost := [m for m in (*by, *sizes) if m not in t.modes]:
        raise ValueError(f"the tensor has no labels {lost}")
    if not by or buckets < 1:
        raise ValueError("buckets need a label and a number")
    rows = t.df.select(*t.modes, F.col(t.value).alias("v"))
    for m, n in sizes.items():
        rows = rows.withColumn(f"{m}_block", quotient(F.col(m), n))
    cut = [f"{m}_block" for m in sizes]
    writer = rows.repartition(buckets, *by).write.format("parquet").bucketBy(buckets, *by).sortBy(*by)
    (writer.partitionBy(*cut) if cut else writer).saveAsTable(table)


def stored(spark: SparkSession, table: str, modes: Sequence[str], blocks: Mapping[str, Sequence[int]] | None = None, extents: Mapping[str, int | None] | None = None) -> Tensor:
    """A stored tensor, or some of its blocks (numbers by label)."""
    df = spark.table(table)
    for m, numbers in (blocks or {}).items():
        if f"{m}_block" not in df.columns:
            raise ValueError(f"the tensor is not cut by {m!r}")
        df = df.where(F.col(f"{m}_block").isin(*numbers))
    return Tensor(df, modes, "v", extents)


def contract_stored(a: Tensor, b: Tensor, out: Sequence[str] | None = None) -> Tensor:
    """As ``contract``, for stored tensors bucketed alike by their summed labels: neither is shuffled for the join.

    The plan relies on a shuffle-free join of equal buckets, so no side is broadcast, whatever its size.
    """
    wide = [Tensor(x.df.hint("merge"), x.modes, x.value, dict.fromkeys(x.modes)) for x in (a, b)]
    made = contract(*wide, out)
    return made.like(made.df, extents={m: {**a.extents, **b.extents}[m] for m in made.modes})
