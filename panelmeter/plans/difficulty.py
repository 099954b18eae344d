"""Difficulty of unseen item types from item features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.calibrate import calibrate, calibrate_many, center_both, converged
from ..operators.regression import difficulty_regression


def fold_abilities(panel: DataFrame, types: DataFrame, *, tol: float,
                   max_sweeps: int) -> DataFrame:
    """(fold, rater, theta) of one centred 1PL fit per left-out type, run together.

    Every fold leaves out little, so all of them start from the full fit.
    """
    full = calibrate(panel, model="1pl", tol=max(tol, 1e-3), max_sweeps=max_sweeps)
    left_out = types.select(F.col("item_type").alias("fit_id"), "item")
    fit = converged(calibrate_many(panel, model="1pl", tol=tol, max_sweeps=max_sweeps,
                                   items_out=left_out, start=full), tol)
    raters, _ = center_both(fit)
    return raters.withColumnRenamed("fit_id", "fold")


def out_of_fold_difficulty(panel: DataFrame, types: DataFrame, features: DataFrame,
                           columns: Sequence[str], *, tol: float = 1e-6,
                           max_sweeps: int = 30) -> DataFrame:
    """(item, item_type, b_tilde): each item predicted by a fit that never saw its type."""
    thetas = fold_abilities(panel, types, tol=tol, max_sweeps=max_sweeps)
    typed = panel.join(types.select("item", "item_type"), "item")
    return difficulty_regression(typed, features, columns, thetas)[0]
