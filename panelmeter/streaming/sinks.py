"""Writers for tracked streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.posterior import theta_posterior
from ..operators.selection import next_item
from ..session import scratch_path


def _batch_writer(path: str, transform: Callable[[DataFrame], DataFrame] | None = None):
    def write(batch: DataFrame, batch_id: int) -> None:
        out = transform(batch) if transform else batch
        # one folder per batch: a retried batch overwrites itself
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def drain(stream: DataFrame, mode: str, tag: str,
          transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Process everything available now and return what was written, with `batch`."""
    spark = stream.sparkSession
    path, state = scratch_path(spark, tag), scratch_path(spark, f"{tag}-state")
    query = (stream.writeStream.outputMode(mode).trigger(availableNow=True)
             .option("checkpointLocation", state)
             .foreachBatch(_batch_writer(path, transform)).start())
    query.awaitTermination()
    return spark.read.parquet(path)


def latest_per_key(written: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest update of every key from the output of an update-mode stream."""
    order = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return (written.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == 1)
            .drop("_n", "batch"))


def next_item_writer(curves: DataFrame, path: str, k: int = 1):
    """foreachBatch function over answered_so_far: next items of every rater of the batch.

    Writes (rater, rank, item) per batch below `path`/batch=<id>. The outcomes of the batch
    are written first, as they are read twice: for the posterior and for what is left.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        told = f"{path}-told/batch={batch_id}"
        batch.write.mode("overwrite").parquet(told)
        known = batch.sparkSession.read.schema(batch.schema).parquet(told)
        posts = theta_posterior(known, curves)
        next_item(posts, curves, known, k).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write
