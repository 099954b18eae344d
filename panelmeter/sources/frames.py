"""Readers for frame annotations and the per-scene command table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOX_TYPE = T.StructType([
    T.StructField("class", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("location", T.ArrayType(T.DoubleType())),
    T.StructField("rotation", T.ArrayType(T.DoubleType())),
    T.StructField("extent", T.ArrayType(T.DoubleType())),
    T.StructField("speed", T.DoubleType()),
])

FRAME_SCHEMA = T.StructType([
    T.StructField("bounding_boxes", T.ArrayType(BOX_TYPE)),
    T.StructField("_bad", T.StringType()),
])


def read_frames(spark: SparkSession, root: str,
                scene_pattern: str = r"/([^/]+)/anno/[^/]+$",
                frame_pattern: str = r"/0*(\d+)\.json(?:\.gz)?$") -> DataFrame:
    """One JSON document per file to (scene, frame, boxes, bad).

    Files that cannot be read or parsed keep their row, with bad set and no boxes:
    a frame's position counts all files of its scene, so they are dropped only
    after positions are given (see tracks.downsample). The listing reads no
    content. Frames are many small files, so the scan packs them by size; write
    the result to parquet once and work from that table.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
             .select(F.regexp_extract("path", scene_pattern, 1).alias("scene"),
                     F.regexp_extract("path", frame_pattern, 1).cast("int").alias("frame"))
             .where(F.col("frame").isNotNull()))
    raw = (spark.read.schema(FRAME_SCHEMA)
           .option("multiLine", True).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_bad")
           .option("recursiveFileLookup", True).option("ignoreCorruptFiles", True)
           .json(root))
    path = F.input_file_name()
    parsed = (raw.select(F.regexp_extract(path, scene_pattern, 1).alias("scene"),
                       F.regexp_extract(path, frame_pattern, 1).cast("int").alias("frame"),
                       F.coalesce("bounding_boxes", F.array().cast(T.ArrayType(BOX_TYPE)))
                       .alias("boxes"), "_bad")
              .where(F.col("_bad").isNull()).drop("_bad").withColumn("_read", F.lit(True)))
    none = F.array().cast(T.ArrayType(BOX_TYPE))
    return files.join(parsed, ["scene", "frame"], "left").select(
        "scene", "frame", F.coalesce("boxes", none).alias("boxes"), F.col("_read").isNull().alias("bad"))


def read_commands(spark: SparkSession, path: str) -> DataFrame:
    """(scene, frame, cmd). Scene length is the number of rows of the scene."""
    return spark.read.parquet(path).select(
        F.col("scene").cast("string").alias("scene"),
        F.col("frame").cast("int").alias("frame"), F.col("cmd").cast("int").alias("cmd"))
