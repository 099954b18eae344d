"""Connected components over an edge table, for any number of edges.

Labels move along edges and are then shortened by following the label of the
label, so a chain of n nodes needs about log n rounds and a star two. Both sides
of every join are plain tables in the shared folder: a hub with a third of all
edges is split by the skew handling of the joins, and pre-aggregated before the
shuffle of the minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import any_row, cut_lineage

ROUNDS = 60


def components(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, label): label is the smallest node reachable. edges: a, b (long), no nulls.

    Nodes without an edge are not listed. An empty edge table gives no rows.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a"))
                       .filter("a <> b").distinct(), "edges")
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    for _ in range(rounds):
        heard = (both.join(labels.withColumnRenamed("node", "a"), "a")
                 .groupBy(F.col("b").alias("node")).agg(F.min("label").alias("heard")))
        moved = labels.join(heard, "node", "left").select(
            "node", F.col("label").alias("was"),
            F.least("label", "heard").alias("near"))
        far = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        step = cut_lineage(moved.join(far, "near").select(
            "node", "was", F.least("near", "far").alias("label")), "labels")
        labels = step.select("node", "label")
        if not any_row(step.filter("label <> was")):
            return labels
    raise RuntimeError(f"labels still move after {rounds} rounds")


def extended(labels: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """labels (node, label) of components after more edges.

    A known class counts as one node: an edge inside it is left out, and of many edges
    between two classes one is walked.
    """
    met = edges.select("a", "b")
    for side in ("a", "b"):
        named = labels.select(F.col("node").alias(side), F.col("label").alias(f"of_{side}"))
        met = met.join(named, side, "left")
    met = cut_lineage(met.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
                      .filter("a <> b").distinct(), "between")
    moved = components(met, rounds)
    old = labels.join(moved.select(F.col("node").alias("label"), F.col("label").alias("now")), "label", "left").select(
        "node", F.coalesce("now", "label").alias("label"))
    new = moved.join(labels.select("node"), "node", "left_anti").select("node", "label")
    return cut_lineage(old.unionByName(new), "labels")
