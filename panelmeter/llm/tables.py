"""Small table helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmeter.session import cut_lineage, shared_folder  # noqa: F401

#: what counts as white space everywhere in this package
SPACE = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def bucket(col: Column, n: int) -> Column:
    """crc32 of an id written as text, modulo n; null ids are in bucket 0 of an empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def shielded(df: DataFrame) -> DataFrame:
    """df with its columns called in_0, in_1, ...: no name of the caller meets one of ours."""
    return df.toDF(*[f"in_{i}" for i in range(len(df.columns))])


def at(df: DataFrame, name: str) -> str:
    """What the column of exactly this name is called in shielded(df)."""
    return f"in_{df.columns.index(name)}"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, also where others differ from them by case only."""
    return shielded(df).select(*[F.col(at(df, n)).alias(n) for n in names])


def any_row(df: DataFrame) -> bool:
    return len(df.limit(1).collect()) > 0
