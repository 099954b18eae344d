"""The ability grid and the quadrature nodes for an uncertain difficulty."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# 241 points on [-6, 6] under a standard normal, 21 nodes.
GRID_LOW, GRID_HIGH, GRID_SIZE = -6.0, 6.0, 241
NODE_COUNT = 21
LIKELIHOOD_FLOOR = 1e-12

GRID_STEP = (GRID_HIGH - GRID_LOW) / (GRID_SIZE - 1)


def ability_grid() -> np.ndarray:
    return np.linspace(GRID_LOW, GRID_HIGH, GRID_SIZE)


def ability_prior() -> np.ndarray:
    density = np.exp(-0.5 * ability_grid() ** 2)
    return density / density.sum()


def difficulty_nodes() -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights of the probabilists' Gauss-Hermite rule, weights sum to 1."""
    x, w = np.polynomial.hermite_e.hermegauss(NODE_COUNT)
    return x, w / w.sum()


def grid_value(g: Column) -> Column:
    return F.lit(GRID_LOW) + F.lit(GRID_STEP) * g


def grid_column() -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(GRID_SIZE - 1)), grid_value)


def prior_column() -> Column:
    return F.array(*[F.lit(float(v)) for v in ability_prior()])
