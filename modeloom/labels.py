"""Algebra of labels, in pure Python: which labels a contraction sums, and in what order results stand."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

Labels = tuple[str, ...]


def distinct(labels: Sequence[str], what: str) -> Labels:
    """The labels as a tuple; raises if one occurs twice."""
    out = tuple(labels)
    if len(set(out)) < len(out):
        raise ValueError(f"{what}: a label occurs twice in {out}")
    return out


def gather(source: Sequence[str], target: Sequence[str]) -> tuple[int, ...]:
    """Positions in ``source`` of the labels of ``target``, so that target[i] == source[out[i]]."""
    if set(source) != set(target):
        raise ValueError(f"label sets differ: {tuple(source)} and {tuple(target)}")
    return tuple(list(source).index(x) for x in target)


def inverse(permutation: Sequence[int]) -> tuple[int, ...]:
    """The permutation that undoes another."""
    out = [0] * len(permutation)
    for i, p in enumerate(permutation):
        out[p] = i
    return tuple(out)


@dataclass(frozen=True)
class ContractionPlan:
    """Free and summed labels, and gather permutations into matrix form (free_a x summed, summed x free_b)."""

    free_a: Labels
    contracted: Labels
    free_b: Labels
    out: Labels
    perm_a: tuple[int, ...]
    perm_b: tuple[int, ...]
    perm_out: tuple[int, ...]

    @property
    def canonical(self) -> Labels:
        return self.free_a + self.free_b


def plan_contraction(a: Sequence[str], b: Sequence[str], out: Sequence[str] | None = None) -> ContractionPlan:
    """Labels of both operands are summed (in a's order); all others are free and make up ``out``."""
    a, b = distinct(a, "first operand"), distinct(b, "second operand")
    shared = tuple(x for x in a if x in b)
    free_a, free_b = (tuple(x for x in s if x not in shared) for s in (a, b))
    out = free_a + free_b if out is None else distinct(out, "output")
    for x in out:
        if x in shared:
            raise ValueError(f"output label {x!r} is in both operands, which sums it")
        if x not in free_a + free_b:
            raise ValueError(f"output label {x!r} is in neither operand")
    if missing := [x for x in free_a + free_b if x not in out]:
        raise ValueError(f"free labels {missing} are missing from the output")
    return ContractionPlan(free_a, shared, free_b, out, gather(a, free_a + shared), gather(b, shared + free_b), gather(out, free_a + free_b))


def merge_extents(*many: dict[str, int | None]) -> dict[str, int | None]:
    """One map of extents; raises where two known extents of a label differ."""
    out: dict[str, int | None] = {}
    for extents in many:
        for label, n in extents.items():
            if out.get(label) is not None and n is not None and out[label] != n:
                raise ValueError(f"label {label!r} has extents {out[label]} and {n}")
            out[label] = n if out.get(label) is None else out[label]
    return out
