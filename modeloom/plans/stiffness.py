"""Elastic stiffness on spectral elements, in two or three dimensions, as a graph in levels.

Per element: gradients of each component along each reference direction (contractions with the derivative
matrix), one pointwise integrand with an output for each direction and component, divergences
(contractions with its weighted transpose), and a weighted sum for each component.  All of it is local to an
element, so the graph runs on whole elements after one shuffle by element.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modeloom.functions.elastic import integrand, weighted_sum
from modeloom.plans.graph import combination, contraction, input_node, stage
from modeloom.plans.levels import LabelTile, LabelTiles, LabelWhole, LevelGraph
from modeloom.plans.local import columns_of
from modeloom.tensor import Tensor, split_index


def stiffness_graph(fields: DataFrame, element: str, axes: Sequence[str], derivative: Tensor, transposed: Tensor, weights: Tensor, elements: int | None = None) -> LevelGraph:
    """The levels: inputs, gradients, integrand, divergences, forces; the forces are its outputs.  ``elements``: their number, which only a run by rows needs."""
    n, labels, points = len(axes), [element, *axes], weights.size
    us, metric = [f"u{c}" for c in range(n)], [f"m{d}{x}" for d in range(n) for x in range(n)]
    inputs = columns_of(fields, labels, [*us, *metric, "modulus", "mu", "jac"], {element: elements, **dict.fromkeys(axes, points)})
    matrices = [t.as_("__q", "__a") for t in (derivative, transposed)]
    at = lambda d, name: [name if k == d + 1 else m for k, m in enumerate(labels)]
    g = LevelGraph(LabelTiles(LabelTile(element, 64), *[LabelWhole(m, points) for m in (*axes, "__q", "__a")]))
    g, *made = g.add(*[stage(input_node(t)) for t in [*inputs, *matrices]])
    u, rest, (h, ht) = made[:n], made[n:-2], made[-2:]
    g, *gradients = g.add(*[contraction(u[c].as_(*at(d, "__a")), h.read(), at(d, "__q")) for c in range(n) for d in range(n)])

    def flux(*values):
        own = values[len(labels) :]
        gradient, rest = own[: n * n], own[n * n :]
        square = lambda v: [list(v[k * n : (k + 1) * n]) for k in range(n)]
        return integrand(square(gradient), square(rest[: n * n]), *rest[n * n :])

    g, *fluxes = g.add(combination([*[x.as_(*labels) for x in gradients], *[x.read() for x in rest]], flux, outputs=n * n))
    g, *divergences = g.add(*[contraction(fluxes[d * n + c].as_(*at(d, "__a")), ht.read(), at(d, "__q")) for c in range(n) for d in range(n)])

    def force(*values):
        own = values[len(labels) :]
        return weighted_sum(own[n:], own[:n])

    shaped = [weights.as_(m) for m in axes]
    g, *forces = g.add(*[combination([x.as_(*labels) for x in divergences[c * n : (c + 1) * n]], force, weights=shaped) for c in range(n)])
    return g.outputs(*forces)


def stiffness(fields: DataFrame, element: str, axes: Sequence[str], derivative: Tensor, transposed: Tensor, weights: Tensor, dealt: bool = False) -> DataFrame:
    """(element, axes..., f0, f1[, f2]) at all points of each element.

    ``fields``: element, axes and columns u<c>, metric m<direction><dimension>, modulus, mu, jac; a
    point without a row is all zeros, one outside of the element or given twice is an error.
    ``derivative``: (point, summed point); ``transposed``: its weighted transpose; ``weights``: (point).
    ``axes``: reference directions, the first of the metric first.  ``dealt``: see :func:`modeloom.plans.local.execute_local`.
    """
    graph = stiffness_graph(fields, element, axes, derivative, transposed, weights)
    return graph.execute_local([f"f{c}" for c in range(len(axes))], dealt)


def quadrature(points: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gauss-Lobatto points on [-1, 1], their weights, and the derivatives of the Lagrange polynomials through them, (at, polynomial)."""
    legendre = np.polynomial.legendre.Legendre.basis(points - 1)
    x = np.concatenate([[-1.0], np.sort(legendre.deriv().roots().real), [1.0]])
    w = 2 / (points * (points - 1) * legendre(x) ** 2)
    apart = x[:, None] - x[None, :] + np.eye(points)
    scale = apart.prod(axis=1)
    h = scale[:, None] / scale[None, :] / apart
    np.fill_diagonal(h, (1 / apart).sum(axis=1) - 1)
    return x, w, h


def fixture_columns(axes: Sequence[str], element: str = "e", kind: str | None = None) -> Mapping[str, str]:
    """SQL expressions of smooth, unsymmetric test fields over element and axes; ``kind``: a column that decides the material.  Each term has one decimal factor, of three digits at most."""
    n = len(axes)
    step = " + ".join(f"{0.013 * (k + 1):.3f} * {a}" for k, a in enumerate(axes))
    out = {}
    for c in range(n):
        out[f"u{c}"] = f"{0.1 + 0.2 * c:.1f} + {step} + 0.01 * (({element} + {c + 1} * {axes[0]} + {axes[-1]}) % 7)"
    for d in range(n):
        for x in range(n):
            out[f"m{d}{x}"] = f"{1.0 if d == x else 0.1 * (d + 1) + 0.05 * x:.2f} + 0.02 * (({element} + {axes[d]}) % 3)"
    out["mu"] = f"1.0 + 0.05 * ({kind or element} % 4)"
    out["modulus"] = f"3.0 + 0.1 * (({element} + {axes[0]}) % 5)"
    out["jac"] = f"0.5 + 0.01 * ({axes[-1]} + {element} % 2)"
    return out


def in_thousandths(text: str) -> str:
    """A column of :func:`fixture_columns` as a double: whole thousandths, which Spark adds up much faster than decimals, divided once, so that the value is the same to the last bit."""
    return f"({re.sub(r'[0-9]+[.][0-9]+', lambda m: str(round(1000 * float(m[0]))), text)}) / 1000D"


def stiffness_sql(elements: str, points: int, axes: Sequence[str], element: str = "e", kind: str | None = None) -> str:
    """The same result in plain SQL, for comparison; ``elements``: a relation with the element and the kind."""
    n, lab = len(axes), ", ".join([element, *axes])
    _, w, derivative = quadrature(points)
    weight = lambda label: f"([{', '.join(repr(float(x)) for x in w)}]::DOUBLE[])[{label} + 1]"
    cols = ", ".join(f"CAST({x} AS DOUBLE) AS {k}" for k, x in fixture_columns(axes, element, kind).items())
    box = " CROSS JOIN ".join([f"({elements}) AS r0", *[f"range({points}) AS r{k + 1}({a})" for k, a in enumerate(axes)]])
    parts = [f"f AS (SELECT {lab}, {cols} FROM {box})", "h(a, b, h) AS (VALUES " + ", ".join(f"({a}::BIGINT, {b}::BIGINT, {float(x)!r}::DOUBLE)" for (a, b), x in np.ndenumerate(derivative)) + ")"]
    for d, axis in enumerate(axes):
        out = ", ".join(f"h.a AS {x}" if x == axis else f"f.{x}" for x in [element, *axes])
        keys = ", ".join("h.a" if x == axis else f"f.{x}" for x in [element, *axes])
        parts.append(f"g{d} AS (SELECT {out}, " + ", ".join(f"SUM(f.u{c} * h.h) AS g{c}{d}" for c in range(n)) + f" FROM f JOIN h ON f.{axis} = h.b GROUP BY {keys})")
    ds = lambda c, x: "(" + " + ".join(f"g{c}{d} * m{d}{x}" for d in range(n)) + ")"

    def sigma(c: int, x: int) -> str:
        if c != x:
            return f"(mu * ({ds(c, x)} + {ds(x, c)}))"
        return "(" + " + ".join(f"{'modulus' if k == c else '(modulus - 2 * mu)'} * {ds(k, k)}" for k in range(n)) + ")"

    using = " ".join(f"JOIN g{d} USING ({lab})" for d in range(n))
    flux = ", ".join(f"jac * ({' + '.join(f'{sigma(c, x)} * m{d}{x}' for x in range(n))}) AS F{d}{c}" for d in range(n) for c in range(n))
    parts.append(f"q AS (SELECT {lab}, {flux} FROM f {using})")
    for d, axis in enumerate(axes):
        out = ", ".join(f"h.b AS {x}" if x == axis else f"q.{x}" for x in [element, *axes])
        keys = ", ".join("h.b" if x == axis else f"q.{x}" for x in [element, *axes])
        parts.append(f"t{d} AS (SELECT {out}, " + ", ".join(f"SUM(q.F{d}{c} * h.h * {weight('h.a')}) AS F{d}{c}" for c in range(n)) + f" FROM q JOIN h ON q.{axis} = h.a GROUP BY {keys})")
    using = "t0 " + " ".join(f"JOIN t{d} USING ({lab})" for d in range(1, n))
    final = ", ".join("ROUND(" + " + ".join(" * ".join([weight(axes[k]) for k in range(n) if k != d] + [f"F{d}{c}"]) for d in range(n)) + f", 6) AS f{c}" for c in range(n))
    return f"WITH {', '.join(parts)} SELECT {lab}, {final} FROM {using}"


def constant(spark: SparkSession, array: np.ndarray, *labels: str) -> Tensor:
    """A small array as a dense tensor."""
    schema = ", ".join([*[f"{m} long" for m in labels], "v double"])
    return Tensor(spark.createDataFrame([(*map(int, at), float(x)) for at, x in np.ndenumerate(array)], schema), labels, "v", dict(zip(labels, array.shape)), dense=True)


def fixture(elements: DataFrame, points: int, axes: Sequence[str], element: str = "e", kind: str | None = None) -> tuple[DataFrame, Tensor, Tensor, Tensor]:
    """Fields at all points of the elements (rows with the element and the kind), derivative matrix, its weighted transpose, weights."""
    spark = elements.sparkSession
    keep = [element, *([kind] if kind else [])]
    rows = elements.select(*keep, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points ** len(axes) - 1).cast("long"))).alias("__at"))
    rows = rows.select(*keep, *split_index(F.col("__at"), dict.fromkeys(axes, points)))
    fields = rows.select(element, *axes, *[F.expr(in_thousandths(x)).alias(k) for k, x in fixture_columns(axes, element, kind).items()])
    _, w, h = quadrature(points)
    return fields, constant(spark, h, "a", "b"), constant(spark, (h * w[:, None]).T, "a", "b"), constant(spark, w, "a")
