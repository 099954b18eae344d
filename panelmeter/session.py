"""Session builder and the lineage cut shared by every iterative operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators are written for. All of them are plain Spark settings:
# a user who brings a session of their own gets the same results without them.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # lets a join on (block, key) reuse a partitioning by block alone
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # keyed state for streams that correct earlier outcomes
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # vector sums per key stay hash-based instead of sorting after 128 keys
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
}

_own_root: dict[str, str] = {}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "panelmeter", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Where that setting is absent and everything runs in one process (tests, a
    laptop), a temporary folder of this machine is used instead. On a cluster no
    local folder is seen by all executors, so its absence is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a shared folder on {master}")
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        _own_root[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own_root[app]


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/panelmeter/{tag}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder once and continue from the files.

    Survives the loss of any executor, computes the input exactly once and lets
    the planner see the real size of what it reads back.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cores(spark: SparkSession) -> int:
    """Tasks that run side by side."""
    return max(1, spark.sparkContext.defaultParallelism)
