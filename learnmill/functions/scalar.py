"""Scalar functions as Column builders: comparisons, losses, densities, impurities, kernels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One absolute tolerance for all comparisons.
TOLERANCE = 1e-8


def isclose(a: Column, b: Column, tol: float = TOLERANCE) -> Column:
    return F.abs(a - b) <= tol


def less_equal(a: Column, b: Column, tol: float = TOLERANCE) -> Column:
    return a <= b + tol


def large_equal(a: Column, b: Column, tol: float = TOLERANCE) -> Column:
    return a >= b - tol


def log_factorial(x: Column) -> Column:
    """Stirling's x ln x - x; 0 at 0."""
    return F.when(x > 0, x * F.log(x) - x).otherwise(0.0)


def poisson_loss(y: Column, mu: Column, floor: float = 1e-8) -> Column:
    """One row's share of the negative log likelihood."""
    return -(y * F.log(F.greatest(mu, F.lit(floor))) - mu - log_factorial(y))


def logistic_loss_of_probability(y: Column, mu: Column, floor: float = 1e-8) -> Column:
    return F.when(y == 1, -F.log(F.greatest(mu, F.lit(floor)))).otherwise(-F.log(F.greatest(1 - mu, F.lit(floor))))


def sigmoid(t: Column) -> Column:
    return 1 / (1 + F.exp(-t))


def log1p_exp(t: Column) -> Column:
    """log(1 + e**t) without overflow."""
    return F.greatest(t, F.lit(0.0)) + F.log1p(F.exp(-F.abs(t)))


def logistic_gradient(y: Column, z: Column) -> Column:
    """Derivative of the logistic loss by the score, in the form sigma(z) - (y + 1) / 2."""
    return sigmoid(z) - (y + 1) / 2


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def normal_cdf(x: Column, terms: int = 60) -> Column:
    """The standard normal distribution function by its series x + x**3 / 3 + x**5 / 15 + ..., to 12 places for |x| < 6; 0 and 1 beyond."""
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.struct(x.cast("double").alias("term"), x.cast("double").alias("sum")),
        lambda s, k: F.struct((s["term"] * x * x / (2 * k + 1)).alias("term"), (s["sum"] + s["term"] * x * x / (2 * k + 1)).alias("sum")), lambda s: s["sum"],
    )
    return F.when(x <= -6, 0.0).when(x >= 6, 1.0).otherwise(0.5 + normal_pdf(x) * series)


def log_pdf(x: Column, mean: float, variance: float) -> Column:
    return -0.5 * math.log(2 * math.pi * variance) - (x - mean) * (x - mean) / (2 * variance)


def entropy(shares: Column) -> Column:
    """Of an array of shares, natural logarithm."""
    return F.aggregate(shares, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log(p)).otherwise(0.0))


def gini(shares: Column) -> Column:
    return 1 - F.aggregate(shares, F.lit(0.0), lambda s, p: s + p * p)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def rbf(a: Column, b: Column, precision: float) -> Column:
    return F.exp(-precision * squared_distance(a, b))


def rbf_derivative(a: Column, b: Column, precision: float) -> Column:
    """Of the kernel, by its precision."""
    return -squared_distance(a, b) * rbf(a, b, precision)


def hinge(y: Column, z: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - y * z)


def squared_hinge(y: Column, z: Column) -> Column:
    return hinge(y, z) * hinge(y, z)


def sorted_union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def sorted_difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def sorted_intersection(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def search(values: Column, wanted: Column) -> Column:
    """Place of a value in a sorted array from 0; null if it is absent."""
    at = F.array_position(values, wanted)
    return F.when(at > 0, at - 1)


def left_most(values: Column, least: Column) -> Column:
    """First place with a value of at least ``least``, else the length."""
    return F.size(F.filter(values, lambda x: x < least))


def right_most(values: Column, most: Column) -> Column:
    """Last place with a value of at most ``most``, else -1."""
    return F.size(F.filter(values, lambda x: x <= most)) - 1
