"""Pointwise functions: elastic stress and what surrounds it, in two or three dimensions; products of arrays."""

from modeloom.functions.arrays import dot
from modeloom.functions.elastic import integrand, matrix_product, project, stress, weighted_sum

__all__ = ["dot", "integrand", "matrix_product", "project", "stress", "weighted_sum"]
