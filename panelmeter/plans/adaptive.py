"""Cost and error of adaptive testing against a reference budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import GRID_LOW, GRID_STEP
from ..operators.metrics import ies, p_irt_error, p_irt_on_grid
from ..operators.posterior import item_curves, precision_by_step, rollouts_to_precision
from ..session import cut_lineage

REFERENCE_ITEMS = 40          # fixed value: budget of the random reference
TAU = 0.35                    # fixed value: standard error at which a test stops


def stopped(log: DataFrame, bank: DataFrame, tau: float | None = TAU) -> tuple[DataFrame, DataFrame]:
    """(rater, n_items, g) where each test stops, and the responses (rater, item, y) until then.

    A test stops at the first step with a standard error below tau, or at its last step
    if that is never reached or tau is None. g is the grid position of the ability there.
    """
    steps = cut_lineage(precision_by_step(log, bank), "steps")
    ends = rollouts_to_precision(steps, tau if tau is not None else 0.0).select(
        "rater", F.coalesce("n_items", "n_logged").alias("n_items"))
    at = steps.join(ends, "rater").where(F.col("step") == F.col("n_items")).select(
        "rater", "n_items", F.round((F.col("theta") - GRID_LOW) / GRID_STEP).cast("int").alias("g"))
    at = cut_lineage(at, "stops")
    seen = log.join(at.select("rater", "n_items"), "rater").where(F.col("step") <= F.col("n_items")).select("rater", "item", "y")
    return at, seen


def ies_report(panel: DataFrame, log: DataFrame, reference: DataFrame, bank: DataFrame, tau: float = TAU) -> DataFrame:
    """One row: p-IRT error and mean items of the log stopped at tau and of the reference log, and IES.

    log and reference (rater, item, y, step) are ordered responses; the reference is
    administered whole. The error is against the rate of all cells of the rater in panel.
    """
    curves = cut_lineage(item_curves(bank, marginalise=False), "curves")
    truth = panel.groupBy("rater").agg(F.avg("y").alias("true_sr"))
    parts = []
    for name, own, stop in (("", log, tau), ("_ref", reference, None)):
        at, seen = stopped(own, bank, stop)
        error = p_irt_error(p_irt_on_grid(seen, curves, at.select("rater", "g")), truth).select(F.col("mae").alias(f"mae{name}"))
        parts.append(error.crossJoin(at.agg(F.avg("n_items").alias(f"items{name}"))))      # one row each
    both = parts[0].crossJoin(parts[1])
    return both.withColumn("ies", ies(F.col("mae"), F.col("mae_ref"), F.col("items"), F.col("items_ref")))
