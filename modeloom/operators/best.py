"""The best products of each value of some labels, with their coordinates.

A task keeps the ``k`` best rows of each key and no more, before the shuffle and behind it, so neither a
sort nor a window over all products is needed.  Most products are not even made: with the greatest and
least partner of each summed value known, the best product of each row of the first operand is
known without a join to the second; the kth of these is reached by k rows at least, so only rows whose best
product is not below it meet the second operand.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modeloom.labels import distinct, merge_extents
from modeloom.operators.contract import sized
from modeloom.tensor import Tensor

#: Rows that a task holds before it sends them on.
HELD = 200_000


def best_rows(df: DataFrame, per: Sequence[str], value: str, coordinates: Sequence[str], k: int) -> DataFrame:
    """The ``k`` rows of greatest ``value`` of each key, ties to the least coordinates, by bounded states that are merged; nulls come last."""
    if k < 1:
        raise ValueError("at least one row is asked for")
    per, names = list(per), df.columns
    places = [f"c{i}" for i in range(len(names))]
    plain = dict(zip(names, places))
    keys = [(plain[m], "ascending") for m in per]
    order = [*keys, (plain[value], "descending"), *[(plain[m], "ascending") for m in coordinates]]

    def cut(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by(order)
        new = np.ones(t.num_rows, bool)
        new[1:] = False
        for m in per:
            codes = t[plain[m]].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        at = np.arange(t.num_rows)
        return t.filter(pa.array(at - np.maximum.accumulate(np.where(new, at, 0)) < k))

    def work(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n, least = [], 0, HELD
            for batch in batches:
                if not batch.num_rows:
                    continue
                held.append(pa.Table.from_batches([batch]))
                n += batch.num_rows
                if n > least:
                    held = [cut(pa.concat_tables(held))]
                    n = held[0].num_rows
                    if not last and n > HELD // 2:
                        yield from held[0].to_batches()
                        held, n = [], 0
                    least = max(HELD, 2 * n)
            if held:
                yield from cut(pa.concat_tables(held)).combine_chunks().to_batches()

        return run

    rows = df.toDF(*places)
    partial = rows.mapInArrow(work(False), rows.schema)
    dealt = partial.repartition(*[plain[m] for m in per]) if per else partial.repartition(1)
    return dealt.mapInArrow(work(True), rows.schema).toDF(*names)


def contract_best(a: Tensor, b: Tensor, per: Sequence[str], k: int) -> Tensor:
    """The ``k`` greatest products of elements of ``a`` and ``b`` that agree in their shared labels, for each value of ``per``, labels of ``a``.

    The result has the labels of both (those of ``a`` first), sparse; ties go to the least coordinates in that order.  Null values, and rows with a null shared label, make
    no product.  Coordinates are unique.
    """
    per = distinct(per, "keys")
    if lost := [m for m in per if m not in a.modes]:
        raise ValueError(f"the first operand has no labels {lost}")
    shared = [m for m in a.modes if m in b.modes]
    if not shared:
        raise ValueError("operands without a shared label")
    modes = (*a.modes, *[m for m in b.modes if m not in a.modes])
    right = b.columns("__y").where(F.col("__y").isNotNull())
    ends = right.groupBy(*shared).agg(F.max("__y").alias("__high"), F.min("__y").alias("__low"))
    rows = a.columns("__x").where(F.col("__x").isNotNull()).join(sized(ends, b.small), shared)
    rows = rows.withColumn("__best", F.greatest(F.col("__x") * F.col("__high"), F.col("__x") * F.col("__low"))).drop("__high", "__low")
    top = best_rows(rows.select(*per, "__best"), per, "__best", (), k)
    bound = F.when(F.count("*") == k, F.min("__best")).alias("__bound")
    kept = rows.join(top.groupBy(*per).agg(bound).select(*[F.col(m).alias(f"__{m}") for m in per], "__bound"), [F.col(m).eqNullSafe(F.col(f"__{m}")) for m in per]) if per else rows.crossJoin(F.broadcast(top.agg(bound)))
    kept = kept.where(F.col("__bound").isNull() | (F.col("__best") >= F.col("__bound"))).select(*a.modes, "__x")
    met = kept.join(sized(right, b.small), shared).select(*modes, (F.col("__x") * F.col("__y")).alias("v"))
    extents = merge_extents(a.extents, b.extents)
    made = Tensor(best_rows(met, per, "v", modes, k), modes, "v", {m: extents[m] for m in modes})
    made.joined = met
    return made
