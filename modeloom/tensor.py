"""A labelled tensor: a DataFrame with one column per label and one value column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modeloom.labels import Labels, distinct, gather

#: Elements up to which a side of known extents is broadcast.
SMALL = 1 << 20


class Tensor:
    """Handle of a tensor: rows (labels..., value), a function of its labels.

    ``extents`` gives the size of each label's range 0 .. n-1 (None: not known, as for labels
    that are not numbers).  ``dense`` says that every coordinate has a row; else a missing
    row is a zero.
    """

    def __init__(self, df: DataFrame, modes: Sequence[str], value: str = "v", extents: Mapping[str, int | None] | None = None, dense: bool = False):
        self.modes: Labels = distinct(modes, "tensor")
        if missing := [c for c in (*self.modes, value) if c not in df.columns]:
            raise ValueError(f"columns {missing} are missing; there are {df.columns}")
        if value in self.modes:
            raise ValueError(f"{value!r} is both label and value")
        extra = set(extents or ()) - set(self.modes)
        if extra:
            raise ValueError(f"extents of labels that the tensor does not have: {sorted(extra)}")
        self.value, self.dense = value, dense
        self.extents: dict[str, int | None] = {m: (extents or {}).get(m) for m in self.modes}
        if dense and None in self.extents.values():
            raise ValueError("a dense tensor needs all its extents")
        self.df = df.select(*self.modes, value)

    # -- properties

    @property
    def rank(self) -> int:
        return len(self.modes)

    @property
    def size(self) -> int | None:
        """Elements of the box of coordinates, if it is known."""
        n = 1
        for e in self.extents.values():
            if e is None:
                return None
            n *= e
        return n

    @property
    def small(self) -> bool:
        """Whether the extents prove that the tensor may be broadcast."""
        return self.size is not None and self.size <= SMALL

    def columns(self, value: str) -> DataFrame:
        """Labels and the value under another name."""
        return self.df.select(*self.modes, F.col(self.value).alias(value))

    def like(self, df: DataFrame, modes: Sequence[str] | None = None, extents: Mapping[str, int | None] | None = None, dense: bool | None = None, value: str | None = None) -> Tensor:
        return Tensor(df, self.modes if modes is None else modes, value or self.value, self.extents if extents is None else extents, self.dense if dense is None else dense)

    # -- views that only rename or order

    def as_(self, *labels: str) -> Tensor:
        """The same tensor under other labels, by position."""
        if len(labels) != self.rank:
            raise ValueError(f"{len(labels)} labels for a tensor of rank {self.rank}")
        df = self.df.select(*[F.col(m).alias(x) for m, x in zip(self.modes, labels)], F.col(self.value))
        return Tensor(df, labels, self.value, dict(zip(labels, self.extents.values())), self.dense)

    def permute(self, *labels: str) -> Tensor:
        """Labels in another order: a transpose."""
        gather(self.modes, labels)
        return self.like(self.df, labels, {m: self.extents[m] for m in labels})

    def named(self, value: str) -> Tensor:
        return self.like(self.columns(value), value=value)

    def cast(self, kind: str) -> Tensor:
        return self.like(self.df.withColumn(self.value, F.col(self.value).cast(kind)))

    # -- density

    def densify(self) -> Tensor:
        """A row for every coordinate, zero where there was none."""
        if self.dense:
            return self
        box = coordinates(self.df.sparkSession, self.extents)
        kind = self.df.schema[self.value].dataType
        joined = box.join(self.df, list(self.modes), "left") if self.modes else self.df
        return self.like(joined.withColumn(self.value, F.coalesce(self.value, F.lit(0).cast(kind))), dense=True)

    def check(self) -> Tensor:
        """Runs the checks that need the data: labels and values not null, in range, and labels unique."""
        bad = F.col(self.value).isNull()
        for m in self.modes:
            bad |= F.col(m).isNull()
            if self.extents[m] is not None:
                bad |= (F.col(m) < 0) | (F.col(m) >= self.extents[m])
        if n := self.df.where(bad).count():
            raise ValueError(f"{n} rows with a null, or a label out of range")
        twice = self.df.groupBy(*self.modes).count().where("count > 1") if self.modes else None
        if twice is not None and twice.limit(1).count():
            raise ValueError("a coordinate occurs twice")
        return self

    def to_df(self, *order: str, value: str | None = None) -> DataFrame:
        """Labels in the order asked for, then the value: the root store."""
        order = order or self.modes
        gather(self.modes, order)
        return self.df.select(*order, F.col(self.value).alias(value or self.value))


def coordinates(spark: SparkSession, extents: Mapping[str, int | None]) -> DataFrame:
    """Every coordinate of a box, from one range by division and remainder (the last label runs fastest)."""
    if None in extents.values():
        raise ValueError(f"extents are not all known: {dict(extents)}")
    total = 1
    for n in extents.values():
        total *= n
    return spark.range(total).select(*split_index(F.col("id"), extents))


def quotient(index: Column, by: int) -> Column:
    """Whole quotient of non-negative numbers, without a detour through floating point."""
    return F.call_function("div", index, F.lit(by)).cast("long") if by != 1 else index.cast("long")


def split_index(index: Column, extents: Mapping[str, int]) -> list[Column]:
    """Label columns of a row-major number."""
    out, below = [], 1
    for label, n in reversed(extents.items()):
        out.append((quotient(index, below) % n).cast("long").alias(label))
        below *= n
    return out[::-1]


def flat_index(extents: Mapping[str, int]) -> Column:
    """The row-major number of a coordinate."""
    out: Column = F.lit(0).cast("long")
    for label, n in extents.items():
        out = out * n + F.col(label)
    return out
