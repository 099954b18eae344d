"""Ranks without a single-partition window.

A global rank is a running count over sorted distinct values. Rows are first
collapsed to distinct values, the values are cut into buckets at approximate
quantiles, each bucket is numbered on its own, and the totals of the buckets
before it are added. Ties, however heavy, are one row by then.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, parallelism

QUANTILE_ACCURACY = 10_000


def value_buckets(df: DataFrame, value: str, n_buckets: int, out: str = "_bucket") -> DataFrame:
    """Add an order-preserving bucket number cut at approximate quantiles."""
    inner = [k / n_buckets for k in range(1, n_buckets)] or [0.5]
    cuts = df.agg(F.percentile_approx(F.col(value).cast("double"), inner, QUANTILE_ACCURACY)
                  .alias("q")).first()["q"] or [0.0]
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    binned = Bucketizer(splits=splits, inputCol="_num", outputCol=out).transform(
        df.withColumn("_num", F.col(value).cast("double")))
    return binned.drop("_num").withColumn(out, F.col(out).cast("int"))


def running_before(dist: DataFrame, value: str, sums: Sequence[str],
                   groups: Sequence[str] = (), n_buckets: int | None = None) -> DataFrame:
    """For each distinct (groups, value): the sums over all smaller values.

    `dist` has one row per (groups, value) and should be cheap to read twice.
    Adds before_<s> and total_<s> for every column in `sums`.
    """
    groups = list(groups)
    bucketed = value_buckets(dist, value, n_buckets or parallelism(dist.sparkSession))
    per_bucket = bucketed.groupBy(*groups, "_bucket").agg(
        *[F.sum(s).alias(f"_t_{s}") for s in sums])
    whole = Window.partitionBy(*(groups or [F.lit(0)]))
    earlier = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # written, as rows that lie by group alone would have all others dealt by group alone
    offsets = cut_lineage(per_bucket.select(
        *groups, "_bucket",
        *[F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(whole).alias(f"total_{s}") for s in sums]), "offsets")
    inside = (Window.partitionBy(*groups, "_bucket").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, -1))
    out = bucketed.join(offsets, [*groups, "_bucket"])
    for s in sums:
        out = out.withColumn(
            f"before_{s}", F.col(f"_o_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0)))
    return out.drop("_bucket", *[f"_o_{s}" for s in sums])


def dense_index(df: DataFrame, order_col: str, out: str,
                groups: Sequence[str] = (), start: int = 0) -> DataFrame:
    """0-based position by a numeric order column that is unique within a group."""
    base = cut_lineage(df.withColumn("_one", F.lit(1).cast("bigint")), "index")
    placed = running_before(base, order_col, ["_one"], groups)
    return (placed.withColumn(out, (F.col("before__one") + F.lit(start)).cast("bigint"))
            .drop("_one", "before__one", "total__one"))


def text_index(df: DataFrame, key: str, out: str) -> DataFrame:
    """0-based position of unique text (or any sortable) keys in sorted order.

    Range partitions are written once with their number, so the offsets and the
    rows always see the same cut.
    """
    parts = parallelism(df.sparkSession)
    base = cut_lineage(df.repartitionByRange(parts, key)
                       .withColumn("_part", F.spark_partition_id()), "textindex")
    sizes = base.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = (Window.partitionBy(F.lit(0)).orderBy("_part")
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_part").orderBy(key)
    return (base.join(offsets, "_part")
            .withColumn(out, F.col("_o") + F.row_number().over(inside) - 1)
            .drop("_part", "_o"))


def average_ranks(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, value, n_ties, avg_rank) with ties sharing their mean rank."""
    dist = cut_lineage(df.where(F.col(value).isNotNull())
                       .groupBy(*groups, value).agg(F.count("*").alias("n_ties")), "ranks")
    placed = running_before(dist, value, ["n_ties"], groups)
    return placed.select(
        *groups, value, "n_ties",
        (F.col("before_n_ties") + (F.col("n_ties") + 1) / 2.0).alias("avg_rank"))


def spearman(df: DataFrame, x: str, y: str, groups: Sequence[str] = (),
             out: str = "rho") -> DataFrame:
    """Rank correlation with average ranks; NULL where one side is constant.

    Rows with a missing value on either side take no part.
    """
    groups = list(groups)
    base = cut_lineage(df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
                       .select(*groups, F.col(x).alias("_x"), F.col(y).alias("_y"))
                       .groupBy(*groups, "_x", "_y").agg(F.count("*").alias("_n")), "pairs")
    ranked = base
    for side in ("_x", "_y"):
        dist = base.groupBy(*groups, side).agg(F.sum("_n").alias("_ties"))
        placed = running_before(cut_lineage(dist, "ranks"), side, ["_ties"], groups)
        # ranks measured from their known mean, so the moments do not cancel
        centred = (F.col("before__ties") + (F.col("_ties") + 1) / 2.0
                   - (F.col("total__ties") + 1) / 2.0)
        ranked = ranked.join(placed.select(*groups, side, centred.alias(f"r{side}")),
                             [*groups, side])
    n, rx, ry = F.col("_n"), F.col("r_x"), F.col("r_y")
    moments = ranked.groupBy(*groups).agg(
        F.sum(n * rx * ry).alias("_xy"), F.sum(n * rx * rx).alias("_xx"),
        F.sum(n * ry * ry).alias("_yy"), F.sum(n).alias("n_rows"))
    rho = F.when((F.col("_xx") > 0) & (F.col("_yy") > 0),
                 F.col("_xy") / F.sqrt(F.col("_xx") * F.col("_yy")))
    return moments.select(*groups, rho.alias(out), "n_rows")


def auroc(df: DataFrame, y: str, p: str, groups: Sequence[str] = (),
          out: str = "auroc") -> DataFrame:
    """Area under the ROC curve, ties counted half; NULL for a single class."""
    groups = list(groups)
    dist = cut_lineage(
        df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
        .groupBy(*groups, F.col(p).alias("_p"))
        .agg(F.sum(F.col(y).cast("bigint")).alias("pos"),
             F.sum((1 - F.col(y)).cast("bigint")).alias("neg")), "scores")
    placed = running_before(dist, "_p", ["neg"], groups)
    wins = F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0)
    sums = placed.groupBy(*groups).agg(
        F.sum(wins).alias("_wins"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    area = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                  F.col("_wins") / (F.col("n_pos").cast("double") * F.col("n_neg")))
    return sums.select(*groups, area.alias(out), "n_pos", "n_neg")


def macro_auroc(df: DataFrame, y: str, p: str, rater: str = "rater",
                groups: Sequence[str] = ()) -> DataFrame:
    """Mean AUROC over raters with its standard error; one-class raters are skipped."""
    groups = list(groups)
    per_rater = auroc(df, y, p, [*groups, rater])
    return per_rater.groupBy(*groups).agg(
        F.avg("auroc").alias("macro_auroc"),
        (F.stddev_samp("auroc") / F.sqrt(F.count("auroc"))).alias("macro_auroc_se"),
        F.count("auroc").alias("n_raters"))
