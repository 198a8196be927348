"""Linear elasticity as column expressions; matrices are lists of rows of columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column

Matrix = Sequence[Sequence[Column]]


def add(terms: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x + y, terms)


def matrix_product(a: Matrix, b: Matrix) -> list[list[Column]]:
    return [[add([row[k] * b[k][j] for k in range(len(b))]) for j in range(len(b[0]))] for row in a]


def stress(gradient: Matrix, modulus: Column, mu: Column) -> list[list[Column]]:
    """Isotropic stress of a displacement gradient [component][direction]; ``modulus`` is lambda + 2 mu.

    Shear parts are mu times the symmetric sum; a normal part is ``modulus`` times its own
    strain and lambda times the others.
    """
    n, lam = len(gradient), modulus - 2 * mu
    out = [[mu * (gradient[c][d] + gradient[d][c]) for d in range(n)] for c in range(n)]
    for c in range(n):
        out[c][c] = add([(modulus if k == c else lam) * gradient[k][k] for k in range(n)])
    return out


def project(sigma: Matrix, metric_row: Sequence[Column], jacobian: Column) -> list[Column]:
    """Stress along one reference direction, by component, times the Jacobian."""
    return [jacobian * add([s * m for s, m in zip(row, metric_row)]) for row in sigma]


def integrand(reference_gradient: Matrix, metric: Matrix, modulus: Column, mu: Column, jacobian: Column) -> list[Column]:
    """Components of all reference directions, one after another.

    ``reference_gradient``: [component][reference direction]; ``metric``: [reference direction][direction].
    """
    sigma = stress(matrix_product(reference_gradient, metric), modulus, mu)
    return [c for row in metric for c in project(sigma, row, jacobian)]


def weighted_sum(weights: Sequence[Column], terms: Sequence[Column]) -> Column:
    """Sum over directions of a term times the weights of all other directions."""
    out = []
    for d, t in enumerate(terms):
        for k, w in enumerate(weights):
            if k != d:
                t = w * t
        out.append(t)
    return add(out)
