"""Sinks: cached results, window tables with an error channel, run tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rank import spearman
from ..session import cut_lineage, shared_folder

# Fixed names of the bundled runs, in order.
RUN_NAMES = ("d64_s0", "d64_s1", "d64_s2", "d96_s0", "d96_s1", "d96_s2")


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)


def materialise(spark: SparkSession, make: Callable[[], DataFrame], name: str,
                fingerprint: str, recompute: bool = False, root: str | None = None) -> DataFrame:
    """Compute a table once per input fingerprint and read it back afterwards.

    The fingerprint is part of the path, so a changed panel never meets a stale
    result. A table counts as present only with its success marker.
    """
    path = f"{root or shared_folder(spark) + '/panelmeter'}/{name}/{fingerprint}"
    if recompute or not _exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_windows(windows: DataFrame, path: str, error: str = "error",
                  buckets: int = 64) -> tuple[str, str]:
    """Write good rows by scene bucket and rejected rows to a table beside them.

    Rows whose `error` column is set are rejected; none is raised or lost.
    """
    bucket = F.pmod(F.xxhash64("scene"), F.lit(buckets)).cast("int")
    good, bad = f"{path}/windows", f"{path}/errors"
    windows = cut_lineage(windows, "windows")          # both writes read the same rows
    (windows.where(F.col(error).isNull()).drop(error).withColumn("scene_bucket", bucket)
     .repartition(buckets, "scene_bucket")             # a file per bucket, not per task and bucket
     .write.mode("overwrite").partitionBy("scene_bucket").option("compression", "zstd").parquet(good))
    (windows.where(F.col(error).isNotNull()).select("scene", error).distinct()
     .write.mode("overwrite").parquet(bad))
    return good, bad


def write_run(predictions: DataFrame, run: str, path: str) -> None:
    """Write one run's out-of-fold table (item, item_type, reference, b_tilde).

    A run written again replaces itself; other runs stay.
    """
    (predictions.select("item", "item_type", "reference", "b_tilde")
     .withColumn("run", F.lit(run))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run")
     .parquet(path))


def bundle_runs(runs: Sequence[DataFrame], names: Sequence[str] = RUN_NAMES
                ) -> tuple[DataFrame, DataFrame]:
    """Put runs side by side under names, each with its rank correlation.

    Every run needs a name: more runs than names are refused. Types and reference
    come from the first run; a run that scores another set of items is refused too.
    """
    if len(runs) > len(names):
        raise ValueError(f"{len(runs)} runs for {len(names)} names")
    pairs = list(zip(names, runs))
    base = runs[0].select("item", "item_type", "reference")
    scored = None
    for name, run in pairs:
        one = run.select("item", "b_tilde").withColumn("run", F.lit(name))
        scored = one if scored is None else scored.unionByName(one)
    joined = base.join(scored, "item", "full_outer")
    # every run must score every item of the first run and no other
    per_item = joined.groupBy("item").agg(
        F.count("run").alias("n"), F.count("reference").alias("known"))
    odd = per_item.where((F.col("n") != len(pairs)) | (F.col("known") != len(pairs)))
    if odd.limit(1).count():
        raise ValueError("runs do not score the same items")
    table = joined.select("run", "item", "item_type", "reference", "b_tilde")
    return table, spearman(table, "b_tilde", "reference", ["run"])
