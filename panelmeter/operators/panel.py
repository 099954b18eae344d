"""Selecting, reshaping and describing a panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .rank import text_index

MIN_OBSERVED = 8                 # fixed value: fewest responses a kept item has
DIGEST_BLOCK = 1024              # positions whose ids are hashed as one string


def exclude_raters(panel: DataFrame, names: Sequence[str]) -> DataFrame:
    return panel.where(~F.col("rater").isin(list(names)))


def item_universe(items: DataFrame, *tables: DataFrame) -> DataFrame:
    """Items present in every table; the item order column is kept as it is.

    Tables of items are merged: they follow the bank, and the planner takes a score table made of
    several runs for no larger than the table it is read from, so it would send all of it to the driver.
    """
    for table in tables:
        items = items.join(table.select("item").hint("merge"), "item", "left_semi")
    return items


def keep_items(items: DataFrame, prediction: DataFrame, reference: DataFrame,
               types: DataFrame) -> DataFrame:
    """Items that can be scored: predicted, anchored and typed."""
    return item_universe(items, prediction, reference, types)


def train_items(scenes: DataFrame, types: DataFrame, panel: DataFrame) -> DataFrame:
    """Items with windows, a type and at least one cell, indexed in sorted order."""
    kept = item_universe(scenes.select("item").distinct(), types, panel)
    return text_index(kept, "item", "item_ord")


def mask_raters(panel: DataFrame, raters: DataFrame) -> DataFrame:
    return panel.join(raters.select("rater"), "rater", "left_semi")


def observed(panel: DataFrame, wanted: DataFrame) -> DataFrame:
    """Flag the wanted (item, rater) pairs that have a cell."""
    have = panel.select("item", "rater", F.lit(True).alias("_have"))
    return (wanted.join(have, ["item", "rater"], "left")
            .withColumn("observed", F.col("_have").isNotNull()).drop("_have"))


def missing(panel: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted (item, rater) pairs that have no cell."""
    return wanted.join(panel.select("item", "rater"), ["item", "rater"], "left_anti")


def missing_per_item(panel: DataFrame, n_raters: int) -> DataFrame:
    """How many raters did not answer each item, without listing the pairs."""
    return (panel.groupBy("item").agg(F.count("*").alias("n_observed"))
            .withColumn("n_missing", F.lit(n_raters) - F.col("n_observed")))


def as_failure(panel: DataFrame) -> DataFrame:
    return panel.withColumn("fail", 1 - F.col("y"))


def min_observed(panel: DataFrame, k: int = MIN_OBSERVED) -> DataFrame:
    enough = panel.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    return panel.join(enough.select("item"), "item", "left_semi")


def fingerprint(items: DataFrame, block: int = DIGEST_BLOCK) -> DataFrame:
    """One row (n_items, digest) that changes with the ids or their order.

    Ids are joined by commas in order, `block` positions of item_ord at a time, and each
    string becomes its SHA-1; the blocks' digests are joined and hashed the same way until
    one is left. A universe of one block has the SHA-1 of all its ids. No string holds
    more than a block, so it is the same digest at every size.
    """
    nodes = items.select(F.col("item_ord").cast("bigint").alias("at"), F.col("item").cast("string").alias("mark"))
    n_items, left = None, None
    while left != 1:
        nodes = cut_lineage(nodes.groupBy(F.floor(F.col("at") / block).alias("at")).agg(
            F.sha1(F.expr("coalesce(listagg(mark, ',') within group (order by at), '')").cast("binary")).alias("mark"),
            F.count("*").alias("n")), "digest")
        left, total = nodes.agg(F.count("*"), F.sum("n")).first()
        n_items = (total or 0) if n_items is None else n_items
        if not left:                              # no items: the digest of an empty string
            return items.sparkSession.range(1).select(
                F.lit(0).cast("bigint").alias("n_items"), F.sha1(F.lit("").cast("binary")).alias("digest"))
        nodes = nodes.select("at", "mark")
    return nodes.select(F.lit(n_items).cast("bigint").alias("n_items"), F.col("mark").alias("digest"))


def assert_universe(items: DataFrame, n: int, digest: str | None = None) -> DataFrame:
    """Return the items unchanged, or raise if count or digest differ."""
    got = fingerprint(items).first()
    if got["n_items"] != n:
        raise AssertionError(f"{got['n_items']} items, expected {n}")
    if digest is not None and got["digest"] != digest:
        raise AssertionError("items or their order differ from the expected universe")
    return items


def dense(panel: DataFrame, items: DataFrame | None, raters: Sequence) -> DataFrame:
    """One row per item, one column per listed rater, NULL where unobserved."""
    wanted = panel.where(F.col("rater").isin(list(raters)))
    wide = wanted.groupBy("item").pivot("rater", list(raters)).agg(F.first("y"))
    if items is None:
        return wide
    return items.select("item").join(wide, "item", "left")


def dense_all(panel: DataFrame, items: DataFrame, raters: DataFrame,
              max_columns: int = 2_000) -> DataFrame:
    """Every item against every rater. Columns are raters, so their number is checked."""
    names = [r["rater"] for r in raters.orderBy("rater_ord").limit(max_columns + 1).collect()]
    if len(names) > max_columns:
        raise ValueError(f"more than {max_columns} raters do not fit in columns")
    return dense(panel, items, names)


def responses_for(panel: DataFrame, raters: DataFrame, item=None) -> DataFrame:
    """Cells with the rater's position, for one item or for all of them."""
    cells = panel if item is None else panel.where(F.col("item") == F.lit(item))
    return cells.join(raters, "rater").select("item", "rater_ord", "y")


def type_clusters(items: DataFrame) -> DataFrame:
    """(item_type, item, member): members of a type numbered by item order.

    Long form, so a type of any size stays spread; see cluster_sizes for totals.
    """
    from .rank import dense_index
    return dense_index(items.select("item_type", "item", "item_ord"), "item_ord", "member",
                       ["item_type"])


def cluster_sizes(items: DataFrame) -> DataFrame:
    return items.groupBy("item_type").agg(
        F.count("*").alias("n_items"), F.min("item_ord").alias("first_ord"),
        F.max("item_ord").alias("last_ord"))


def bank_columns(bank: DataFrame) -> DataFrame:
    """Bank with a position in sorted item order."""
    return text_index(bank.select("item", "b", "a", "s"), "item", "bank_ord")


def failure_rate(panel: DataFrame) -> DataFrame:
    return panel.groupBy("item").agg(
        (F.lit(1.0) - F.avg("y")).alias("fail_rate"), F.count("*").alias("n_obs"))


def panel_summary(panel: DataFrame, types: DataFrame) -> DataFrame:
    """Counts and pass rate per rater, per item type and overall, in one pass.

    n_missing is set for raters: typed items of the panel that the rater has no cell for.
    """
    typed = panel.join(types.select("item", "item_type"), "item")
    items = typed.agg(F.count_distinct("item").alias("n")).first()["n"]
    grouped = typed.groupingSets([["rater"], ["item_type"], []], "rater", "item_type")
    return grouped.agg(F.grouping_id().alias("level"), F.count("*").alias("n_obs"),
                       F.sum(F.col("y").cast("bigint")).alias("n_pass"),
                       F.avg("y").alias("pass_rate")).withColumn(
        "n_missing", F.when(F.col("level") == 1, F.lit(items) - F.col("n_obs")))
