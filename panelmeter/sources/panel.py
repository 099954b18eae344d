"""Readers for response matrices, type maps, feature vectors and run predictions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rank import text_index

# The rater that never takes part, the prefix item ids may carry,
# and the run that is reported unless another one is asked for.
EXCLUDED_RATER = "PDM-Lite"
ITEM_PREFIX = "route_"
DEFAULT_RUN = "d64_s0"


@dataclass
class Panel:
    cells: DataFrame     # item, rater, y        no row = not observed
    items: DataFrame     # item, item_ord        order of the matrix columns
    raters: DataFrame    # rater, rater_ord      order of the matrix rows


def _place() -> Column:
    """Where a row of a file scan stands: files by path, then splits by offset, then rows in a
    split. Rows of one split are read in order by one task, however splits are dealt."""
    return F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
                    F.monotonically_increasing_id().alias("row"))


def read_panel(spark: SparkSession, path: str,
               exclude: tuple[str, ...] = (EXCLUDED_RATER,)) -> Panel:
    """Wide response matrix (one row per rater) to a long panel.

    Cells are read as text, so an empty cell stays apart from a failed one.
    Excluded raters are dropped before the row index is given out. Rows are ordered by
    file path and by their place in it, over any number of files and splits.
    """
    wide = spark.read.csv(path, header=True, inferSchema=False)
    rater_col, *item_cols = wide.columns
    placed = wide.select(F.col(f"`{rater_col}`").alias("rater"), _place().alias("place"))
    wide = wide.withColumnRenamed(rater_col, "rater")
    wide = wide.where(~F.col("rater").isin(list(exclude)) | F.col("rater").isNull())
    cells = (wide.unpivot(["rater"], item_cols, "item", "cell")
             .where(F.col("cell").isNotNull() & (F.trim("cell") != ""))
             .select("item", "rater", F.col("cell").cast("double").cast("int").alias("y")))
    order = placed.where(~F.col("rater").isin(list(exclude)) | F.col("rater").isNull())
    raters = text_index(order, "place", "rater_ord").select("rater", F.col("rater_ord").cast("int").alias("rater_ord"))
    items = spark.createDataFrame([(name, k) for k, name in enumerate(item_cols)],
                                  "item string, item_ord int")
    return Panel(cells, items, raters)


def read_item_types(spark: SparkSession, path: str, duplicates: str = "last") -> DataFrame:
    """Headerless `item,type` lines; lines without a comma are skipped.

    duplicates='last' keeps the last line of an item: lines are ordered by file path, split
    offset and place in the split. duplicates='error' raises instead.
    """
    lines = (spark.read.text(path)
             .select("value", _place().alias("line_pos"))
             .where(F.contains(F.col("value"), F.lit(","))))
    parts = F.split("value", ",")
    pairs = lines.select(F.get(parts, F.lit(0)).alias("item"),
                         F.trim(F.get(parts, F.lit(1))).alias("item_type"), "line_pos")
    per_item = pairs.groupBy("item").agg(
        F.max_by("item_type", "line_pos").alias("item_type"), F.count("*").alias("lines"))
    if duplicates == "error":
        checked = F.when(F.col("lines") > 1, F.raise_error(
            F.concat(F.lit("item listed twice: "), F.col("item")))).otherwise(F.col("item_type"))
        return per_item.select("item", checked.alias("item_type"))
    return per_item.select("item", "item_type")


def read_features(spark: SparkSession, path: str, name_col: str = "name",
                  vector_col: str = "stats") -> DataFrame:
    """Feature vectors as float arrays; the id prefix is removed."""
    raw = spark.read.parquet(path)
    return raw.select(
        F.replace(F.col(name_col).cast("string"), F.lit(ITEM_PREFIX), F.lit("")).alias("item"),
        F.col(vector_col).cast("array<float>").alias("features"))


def read_predictions(spark: SparkSession, path: str, run: str = DEFAULT_RUN) -> DataFrame:
    """Scores of one run. The run is a partition, so other runs are not read.

    There is no form that averages several runs: spread over runs is reported
    on their metrics, see plans.evaluation.run_spread.
    """
    table = spark.read.parquet(path).where(F.col("run") == run)
    return table.select(
        F.replace(F.col("item").cast("string"), F.lit(ITEM_PREFIX), F.lit("")).alias("item"),
        F.col("b_tilde").cast("double").alias("b_tilde"))
