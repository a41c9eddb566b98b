"""Vector algebra on array<double> columns, kept in Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

Z_LIMIT = 50.0
LN2 = 0.6931471805599453


def dot(x: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def sigmoid(z: Column) -> Column:
    """Logistic function with the argument clipped to +-50."""
    z = F.greatest(F.least(z, F.lit(Z_LIMIT)), F.lit(-Z_LIMIT))
    return 1.0 / (1.0 + F.exp(-z))


def linear_probability(x: Column, coef: Column, intercept: Column) -> Column:
    return sigmoid(dot(x, coef) + intercept)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v
    )


def binary_entropy(p: Column, eps: float = 1e-10) -> Column:
    """Entropy (nats) of a Bernoulli probability, both sides clipped away from 0 and 1."""
    p1 = F.greatest(F.least(p, F.lit(1.0 - eps)), F.lit(eps))
    p0 = F.greatest(F.least(1.0 - p, F.lit(1.0 - eps)), F.lit(eps))
    return -(p1 * F.log(p1) + p0 * F.log(p0))


def as_doubles(x: Column) -> Column:
    return x.cast("array<double>")
