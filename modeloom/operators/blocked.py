"""Blocked encoding of dense tensors: one row per block, elements in row-major order.

Operands meet block by block in an equi-join; the product of two blocks is one call of
numpy, whose partial sums are added up per output block within an Arrow batch, then per
element by an aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modeloom.labels import plan_contraction
from modeloom.operators.views import tile_view, untile
from modeloom.tensor import SMALL, Tensor, flat_index, split_index

STACKED = 4_000_000  # numbers of a side that are multiplied at a time


class Blocked:
    """Blocks of a tensor: block labels ``<label>_o`` and ``data``; blocks without an element are absent."""

    def __init__(self, df: DataFrame, modes: Sequence[str], extents: Mapping[str, int], sizes: Mapping[str, int]):
        self.df, self.modes, self.extents, self.sizes = df, tuple(modes), dict(extents), dict(sizes)

    @classmethod
    def of(cls, t: Tensor, sizes: Mapping[str, int]) -> Blocked:
        """Groups elements into blocks; labels not in ``sizes`` are whole. Missing elements are zeros."""
        if None in t.extents.values():
            raise ValueError("a blocked tensor needs all its extents")
        sizes = {m: min(sizes.get(m, t.extents[m]), t.extents[m]) for m in t.modes}
        tiled = tile_view(t, sizes)
        place = flat_index({f"{m}_i": sizes[m] for m in t.modes})
        n = int(np.prod(list(sizes.values()))) if sizes else 1
        if n > SMALL:
            raise ValueError(f"a block of {sizes} has {n} elements, {SMALL} are the most")
        pairs = tiled.df.groupBy(*[f"{m}_o" for m in t.modes]).agg(F.collect_list(F.struct(place.cast("int").alias("at"), F.col(t.value).cast("double").alias("x"))).alias("items"))

        def fill(batches):
            for batch in batches:
                items = batch.column(batch.num_columns - 1)
                count = items.value_lengths().to_numpy()
                flat = items.flatten()
                data = np.zeros((batch.num_rows, n))
                data[np.repeat(np.arange(batch.num_rows), count), flat.field(0).to_numpy()] = flat.field(1).to_numpy()
                ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * n)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(ends, pa.array(data.ravel()))], [*batch.schema.names[:-1], "data"])

        schema = ", ".join(f"{m}_o long" for m in t.modes)
        return cls(pairs.mapInArrow(fill, f"{schema}, data array<double>"), t.modes, t.extents, sizes)

    def to_tensor(self) -> Tensor:
        """One row per element, padding left out."""
        names = [f"{m}_o" for m in self.modes]
        rows = self.df.select(*names, F.posexplode("data").alias("__at", "v"))
        return elements(rows, self.modes, self.extents, self.sizes)


def elements(rows: DataFrame, modes: Sequence[str], extents: Mapping[str, int], sizes: Mapping[str, int]) -> Tensor:
    inner = split_index(F.col("__at").cast("long"), {f"{m}_i": sizes[m] for m in modes})
    columns = [c for m, i in zip(modes, inner) for c in (F.col(f"{m}_o"), i)]
    names = [x for m in modes for x in (f"{m}_o", f"{m}_i")]
    tiled = {x: n for m in modes for x, n in ((f"{m}_o", -(-extents[m] // sizes[m])), (f"{m}_i", sizes[m]))}
    return untile(Tensor(rows.select(*columns, "v"), names, "v", tiled), modes, {m: extents[m] for m in modes})


def contract_blocked(a: Blocked, b: Blocked, out: Sequence[str] | None = None) -> Tensor:
    """The contraction of blocked operands; blocks of a shared label must have one size."""
    plan = plan_contraction(a.modes, b.modes, out)
    for m in plan.contracted:
        if (a.extents[m], a.sizes[m]) != (b.extents[m], b.sizes[m]):
            raise ValueError(f"label {m!r} is blocked differently in the operands")
    extents, sizes = a.extents | b.extents, a.sizes | b.sizes
    letters = {m: chr(97 + i) for i, m in enumerate(dict.fromkeys((*a.modes, *b.modes)))}
    word = lambda modes: "".join(letters[m] for m in modes)
    rule = f"Z{word(a.modes)},Z{word(b.modes)}->Z{word(plan.out)}"
    shape_a, shape_b = ([x.sizes[m] for m in x.modes] for x in (a, b))
    n = int(np.prod([sizes[m] for m in plan.out])) if plan.out else 1
    left = a.df.withColumnRenamed("data", "__x")
    right = b.df.withColumnRenamed("data", "__y")
    on = [f"{m}_o" for m in plan.contracted]
    small = [np.prod(list(x.extents.values())) <= SMALL for x in (a, b)]
    if not on and not any(small):
        raise ValueError("operands without a shared label: the extents of one must prove it small")
    joined = (left.join(right, on) if on else left.crossJoin(right)).select(*[f"{m}_o" for m in plan.out], "__x", "__y")
    width = len(plan.out)

    step = max(1, STACKED // max(n, int(np.prod(shape_a)), int(np.prod(shape_b))))

    def multiply(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, step):
                own = batch.slice(k, step)
                x, y = (own.column(width + i).flatten().to_numpy().reshape(own.num_rows, *s) for i, s in enumerate((shape_a, shape_b)))
                products = np.einsum(rule, x, y, optimize=True).reshape(own.num_rows, n)  # all pairs of blocks at once
                keys = np.stack([own.column(i).to_numpy() for i in range(width)], axis=1) if width else np.zeros((own.num_rows, 0), np.int64)
                unique, place = np.unique(keys, axis=0, return_inverse=True)
                order = np.argsort(np.ravel(place), kind="stable")
                total = np.add.reduceat(products[order], np.searchsorted(np.ravel(place)[order], np.arange(len(unique))), axis=0)
                ends = pa.array(np.arange(len(unique) + 1, dtype=np.int32) * n)
                yield pa.RecordBatch.from_arrays([*[pa.array(unique[:, i]) for i in range(width)], pa.ListArray.from_arrays(ends, pa.array(total.ravel()))], [*[f"{m}_o" for m in plan.out], "data"])

    schema = ", ".join([*[f"{m}_o long" for m in plan.out], "data array<double>"])
    names = [f"{m}_o" for m in plan.out]
    rows = joined.mapInArrow(multiply, schema).select(*names, F.posexplode("data").alias("__at", "__p")).groupBy(*names, "__at").agg(F.sum("__p").alias("v"))
    if not plan.out:
        return Tensor(rows.select("v"), (), "v")
    return elements(rows, plan.out, {m: extents[m] for m in plan.out}, {m: sizes[m] for m in plan.out})
