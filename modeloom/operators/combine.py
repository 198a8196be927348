"""Pointwise functions of several tensors over the same labels."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modeloom.labels import merge_extents
from modeloom.operators.contract import in_range, outputs
from modeloom.operators.hooks import arity
from modeloom.tensor import Tensor, coordinates


def _joined(out: Sequence[str], operands: Sequence[Tensor], join: str | None, weights: Sequence[Tensor]):
    if not operands:
        raise ValueError("a combine needs an operand")
    for t in operands:
        if set(t.modes) != set(out):
            raise ValueError(f"combine operand has labels {t.modes}, the output {tuple(out)}")
    extents = merge_extents(*[t.extents for t in operands])
    if join is None:
        join = "inner" if all(t.dense for t in operands) else "dense"
    if join not in ("inner", "outer", "dense"):
        raise ValueError(f"unknown way to join: {join}")
    # several outputs of one operation are read from it, without a join
    frames: list[tuple[object, list[int]]] = []
    for i, t in enumerate(operands):
        for f, own in frames:
            if f is not None and getattr(t, "frame", None) is f and operands[own[0]].modes == t.modes:
                own.append(i)
                break
        else:
            frames.append((getattr(t, "frame", None), [i]))
    parts = [(operands[own[0]].df if len(own) == 1 else frame).select(*out, *[F.col(operands[i].value).alias(f"__v{i}") for i in own]) for frame, own in frames]
    df = parts[0]
    if len(parts) > 2 and out:
        df = _met(out, parts, join == "inner")
    else:
        for part in parts[1:]:
            df = df.join(part, list(out), "inner" if join == "inner" else "full") if out else df.crossJoin(part)
    full = all(t.dense for t in operands)
    dense = join == "dense" or full
    if join == "dense" and not full:
        df = coordinates(df.sparkSession, {m: extents[m] for m in out}).join(df, list(out), "left")
    if join != "inner":
        df = df.select(*out, *[F.coalesce(F.col(f"__v{i}"), F.lit(0).cast(t.df.schema[t.value].dataType)).alias(f"__v{i}") for i, t in enumerate(operands)])
    names = [f"__v{i}" for i in range(len(operands))]
    for k, w in enumerate(weights):
        if not set(w.modes) <= set(out):
            raise ValueError(f"captured tensor has labels {w.modes}, the output {tuple(out)}")
        captured = w.columns(f"__w{k}")
        df = df.join(F.broadcast(in_range(captured, w)) if w.small else captured, list(w.modes))
        names.append(f"__w{k}")
    return df, names, {m: extents[m] for m in out}, dense


def _met(out: Sequence[str], parts: Sequence[DataFrame], everywhere: bool) -> DataFrame:
    """Many tables with unique coordinates side by side, by one aggregate over all of them instead of a join for each; a repeated coordinate is an error."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("__has", F.lit(1 << k).cast("long")) for k, p in enumerate(parts)])
    values = [c for p in parts for c in p.columns if c not in out]
    met = rows.groupBy(*out).agg(*[F.max(c).alias(c) for c in values], F.bit_or("__has").alias("__has"), F.count("*").alias("__rows"))
    # one expression, as the optimiser would put what the one condition says of __has into the other
    wanted = F.col("__has") == (1 << len(parts)) - 1 if everywhere else F.lit(True)
    fine = F.when(F.col("__rows") == F.bit_count("__has"), wanted).otherwise(F.raise_error(F.lit("a coordinate occurs twice in an operand of a combine")).cast("boolean"))
    return met.where(fine).drop("__has", "__rows")


def combine_multi(out: Sequence[str], operands: Sequence[Tensor], fn: Callable[..., Sequence[Column]], join: str | None = None, weights: Sequence[Tensor] = ()) -> list[Tensor]:
    """``fn(*labels, *values)`` gives several columns: as many tensors, from one pass.

    ``join``: what happens where an operand has no row.  ``inner``: no output; ``outer``: a zero,
    wherever any operand has a row; ``dense``: a zero at every coordinate of the box (default
    unless all operands are dense, since ``fn`` of zeros may be other than zero).
    ``weights``: captured tensors over some of the labels; their values follow the operands'.
    Coordinates of an operand are unique: from three operands on a repeated one is an error, with two it gives a row for each.
    """
    out = tuple(out)
    df, names, extents, dense = _joined(out, operands, join, weights)
    arity(fn, len(out) + len(names), "combine function")
    made = fn(*[F.col(m) for m in out], *[F.col(n) for n in names])
    values = [f"v{i}" for i in range(len(made))]
    return outputs(df.select(*out, *[c.alias(n) for c, n in zip(made, values)]), out, values, extents, dense)


def combine(out: Sequence[str], operands: Sequence[Tensor], fn: Callable[..., Column], join: str | None = None, weights: Sequence[Tensor] = ()) -> Tensor:
    """As :func:`combine_multi` with one output, whose value is called v."""
    arity(fn, len(tuple(out)) + len(operands) + len(weights), "combine function")
    return combine_multi(out, operands, lambda *a: [fn(*a)], join, weights)[0].named("v")
