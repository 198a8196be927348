"""Shapes: tiles, slices, reshapes and transposes as arithmetic on label columns."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import functions as F

from modeloom.labels import distinct
from modeloom.tensor import Tensor, flat_index, quotient, split_index


def tile_view(t: Tensor, sizes: Mapping[str, int]) -> Tensor:
    """Splits each label of ``sizes`` in a block ``<label>_o`` and a place in it ``<label>_i``; the last block may be short."""
    modes, extents, columns = [], {}, []
    for m in t.modes:
        if m not in sizes:
            modes.append(m)
            extents[m] = t.extents[m]
            columns.append(F.col(m))
            continue
        if sizes[m] < 1:
            raise ValueError(f"block of {sizes[m]} along {m!r}")
        n, size = t.extents[m], sizes[m] if t.extents[m] is None else min(sizes[m], t.extents[m])
        modes += [f"{m}_o", f"{m}_i"]
        extents |= {f"{m}_o": None if n is None else -(-n // size), f"{m}_i": size}
        columns += [quotient(F.col(m), size).alias(f"{m}_o"), (F.col(m) % size).cast("long").alias(f"{m}_i")]
    whole = all(t.extents[m] is not None and t.extents[m] % extents[f"{m}_i"] == 0 for m in sizes)
    return Tensor(t.df.select(*columns, t.value), modes, t.value, extents, t.dense and whole)


def untile(t: Tensor, labels: Sequence[str], extents: Mapping[str, int] | None = None) -> Tensor:
    """Undoes :func:`tile_view` for the labels; coordinates beyond ``extents`` (padding) go."""
    modes = [m for m in (x.removesuffix("_o") if x.removesuffix("_o") in labels else x for x in t.modes) if m.removesuffix("_i") not in labels or m in labels]
    columns, new = [], {}
    for m in modes:
        if m in labels:
            inner = t.extents[f"{m}_i"]
            columns.append((F.col(f"{m}_o") * inner + F.col(f"{m}_i")).alias(m))
            blocks = t.extents[f"{m}_o"]
            new[m] = (extents or {}).get(m, None if blocks is None else blocks * inner)
        else:
            columns.append(F.col(m))
            new[m] = t.extents[m]
    df = t.df.select(*columns, t.value)
    for m, n in (extents or {}).items():
        df = df.where(F.col(m) < n)
    return Tensor(df, modes, t.value, new, t.dense)


def subview_tile(t: Tensor, blocks: Mapping[str, int]) -> Tensor:
    """One block of a tiled tensor: its block labels are fixed and go."""
    return slice_modes(t, {f"{m}_o": k for m, k in blocks.items()})


def slice_modes(t: Tensor, fixed: Mapping[str, int]) -> Tensor:
    """Fixes some labels, which go; the filter reaches the scan."""
    for m, k in fixed.items():
        if m not in t.modes:
            raise ValueError(f"the tensor has no label {m!r}")
        if isinstance(k, int) and t.extents[m] is not None and not 0 <= k < t.extents[m]:
            raise ValueError(f"{k} is outside of {m!r}, which has {t.extents[m]}")
    df = t.df
    for m, k in fixed.items():
        df = df.where(F.col(m) == k)
    keep = [m for m in t.modes if m not in fixed]
    return t.like(df, keep, {m: t.extents[m] for m in keep})


def permute(t: Tensor, *labels: str) -> Tensor:
    return t.permute(*labels)


def linearise(t: Tensor, label: str = "n", order: Sequence[str] | None = None) -> Tensor:
    """All labels as one row-major number; ``order`` names them slowest first (default: as they stand)."""
    order = tuple(order or t.modes)
    if sorted(order) != sorted(t.modes):
        raise ValueError(f"order {order} is none of the labels {t.modes}")
    extents = {m: t.extents[m] for m in order}
    if None in extents.values():
        raise ValueError("extents are not all known")
    return Tensor(t.df.select(flat_index(extents).alias(label), t.value), [label], t.value, {label: t.size}, t.dense)


def delinearise(t: Tensor, extents: Mapping[str, int]) -> Tensor:
    """A rank-1 tensor's row-major number as several labels."""
    if t.rank != 1:
        raise ValueError("only a tensor of rank 1 can be split")
    total = 1
    for n in extents.values():
        total *= n
    if t.size is not None and total != t.size:
        raise ValueError(f"{total} elements asked of {t.size}")
    distinct(list(extents), "reshape")
    return Tensor(t.df.select(*split_index(F.col(t.modes[0]), extents), t.value), tuple(extents), t.value, extents, t.dense)


def common_factors(source: Sequence[int], target: Sequence[int], most: int = 16) -> list[int]:
    """Factors, slowest first, whose runs make up both shapes; raises where two extents that meet share none.

    The fastest extents that are left meet; their greatest common divisor is a factor of both.
    """
    if math.prod(source) != math.prod(target):
        raise ValueError(f"{math.prod(target)} elements asked of {math.prod(source)}")
    left, right, out = [n for n in source if n != 1], [n for n in target if n != 1], []
    while left:
        g = math.gcd(left[-1], right[-1])
        if g == 1:
            raise ValueError(f"shapes {tuple(source)} and {tuple(target)} have no common factors")
        out.append(g)
        for side in (left, right):
            side[-1] //= g
            if side[-1] == 1:
                side.pop()
    if len(out) > most:
        raise ValueError(f"{len(out)} common factors, {most} are the most")
    return out[::-1]


def reshape(t: Tensor, extents: Mapping[str, int], order: Sequence[str] | None = None, strict: bool = False) -> Tensor:
    """Another shape over the same elements in memory order (the last label of ``order`` fastest).

    ``strict``: shapes that do not split into common factors (see :func:`common_factors`) are
    refused; Spark has no need of them.
    """
    if strict:
        common_factors([t.extents[m] for m in order or t.modes], list(extents.values()))
    return delinearise(linearise(t, "__n", order), extents)


def regroup(t: Tensor, split: int, names: tuple[str, str] = ("row", "col")) -> Tensor:
    """A matrix: labels before ``split`` as rows, the others as columns, the last of each fastest."""
    if not 0 < split < t.rank:
        raise ValueError(f"a split at {split} of {t.rank} labels leaves a side empty")
    left, right = ({m: t.extents[m] for m in part} for part in (t.modes[:split], t.modes[split:]))
    if None in t.extents.values():
        raise ValueError("extents are not all known")
    total = lambda e: math.prod(e.values())
    df = t.df.select(flat_index(left).alias(names[0]), flat_index(right).alias(names[1]), t.value)
    return Tensor(df, names, t.value, {names[0]: total(left), names[1]: total(right)}, t.dense)
