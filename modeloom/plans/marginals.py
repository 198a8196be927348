"""All marginals of a tensor, each from the smallest finer one.

``cube`` repeats every row for each set of labels before it adds up.  Here sets of labels are a
lattice: a set's sums are made from the sums of a set that contains it, of those that are there the
one with the fewest coordinates, which one pass of distinct counts estimates.  What
several others read is kept, so the operand itself is read twice, whatever the number of sets.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from modeloom.plans.graph import Run
from modeloom.tensor import Tensor

#: Aggregates that partial results can be aggregated by again.
ADDS = {"sum": F.sum, "min": F.min, "max": F.max}


def lattice(sets: Sequence[frozenset], whole: frozenset, size: dict[frozenset, float]) -> dict[frozenset, frozenset]:
    """For each set, of the larger ones the one with the fewest coordinates; larger sets come first."""
    out: dict[frozenset, frozenset] = {}
    for s in sorted(sets, key=lambda s: (-len(s), sorted(s))):
        above = [x for x in [whole, *out] if s < x]
        out[s] = min(above, key=lambda x: (size[x], -len(x), sorted(x)))
    return out


def marginals(t: Tensor, sets: Sequence[Sequence[str]] | None = None, add: str = "sum") -> Run:
    """The tensor's sums over all labels but those of each set, in the order of ``sets`` (default: all sets of its labels, larger ones first).

    What several marginals are made from is kept until the run is closed.  Null labels are coordinates like others.  A tensor without rows has
    no marginal but the empty set's, which is null.
    """
    every = [c for k in range(t.rank, -1, -1) for c in combinations(t.modes, k)]
    wanted = [tuple(s) for s in (every if sets is None else sets)]
    for s in wanted:
        if len(set(s)) < len(s) or not set(s) <= set(t.modes):
            raise ValueError(f"{s} are not labels of the tensor")
    own = frozenset(t.modes)
    base = t.df.persist(StorageLevel.MEMORY_AND_DISK)
    need = list(dict.fromkeys(frozenset(s) for s in wanted if frozenset(s) != own))
    size = {own: float("inf"), frozenset(): 1.0}
    count = [s for s in need if s]
    if count:
        row = base.agg(*[F.approx_count_distinct(F.struct(*[F.col(m) for m in sorted(s)])).alias(f"n{k}") for k, s in enumerate(count)]).first()
        size |= {s: row[k] for k, s in enumerate(count)}
    above = lattice(need, own, size)
    frames, held = {own: base}, [base]
    for s in above:
        df = frames[above[s]].groupBy(*[m for m in t.modes if m in s]).agg(ADDS[add](t.value).alias(t.value))
        if list(above.values()).count(s) > 1:
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
            held.append(df)
        frames[s] = df
    made = [Tensor(frames[frozenset(s)], s, t.value, {m: t.extents[m] for m in s}) for s in wanted]
    run = Run(made, held)
    run.above = above
    return run
