"""Scalar column functions around the logistic curve."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published definitions.
SIG_BOUND = 30.0            # argument of the logistic is kept in [-30, 30]
ENTROPY_FLOOR = 1e-12
PROB_FLOOR = 1e-9           # probabilities inside the log score


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def sig(x: Column) -> Column:
    """Logistic with its argument clipped, so exp() never overflows."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clamp(x, -SIG_BOUND, SIG_BOUND)))


def sig_sql(x: str) -> str:
    """The same curve as SQL text, for steps that are planned many times."""
    return f"1D / (1D + exp(-greatest(least({x}, {SIG_BOUND}D), -{SIG_BOUND}D)))"


def spread(p: Column) -> Column:
    """p(1-p), the variance of a Bernoulli outcome."""
    return p * (F.lit(1.0) - p)


def logit(p: Column) -> Column:
    return F.log(p / (F.lit(1.0) - p))


def binary_entropy(p: Column) -> Column:
    """Entropy of a Bernoulli outcome in nats."""
    q = clamp(p, ENTROPY_FLOOR, 1.0 - ENTROPY_FLOOR)
    return -(q * F.log(q) + (F.lit(1.0) - q) * F.log(F.lit(1.0) - q))


def log_loss(y: Column, p: Column) -> Column:
    q = clamp(p, PROB_FLOOR, 1.0 - PROB_FLOOR)
    return -(y * F.log(q) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - q))

