"""Inputs every registered query starts from, and the registry itself.

A query is a function (spark, dir) -> DataFrame beside the SQL that must give
the same rows. Both read the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return add


def rd(col, digits: int = 6):
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("double"), digits) + F.lit(0.0)


def rsql(expr: str, digits: int = 6) -> str:
    return f"(round(({expr})::DOUBLE, {digits}) + 0.0)"


def sig_sql(x: str) -> str:
    return f"(1.0 / (1.0 + exp(-greatest(least({x}, 30.0), -30.0))))"


# --- panel from lineitem: item = part, rater = supplier -----------------------------

def panel(spark: SparkSession, sf: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    return lines.groupBy(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("rater")).agg(
        F.max((F.col("l_linestatus") == "O").cast("int")).alias("y"))


def types(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/part.parquet").select(
        F.col("p_partkey").alias("item"), F.col("p_brand").alias("item_type"))


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Items with an order: by part key."""
    return spark.read.parquet(f"{sf}/part.parquet").select(
        F.col("p_partkey").alias("item"), F.col("p_partkey").alias("item_ord"),
        F.col("p_brand").alias("item_type"))


def raters(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/supplier.parquet").select(
        F.col("s_suppkey").alias("rater"), F.col("s_suppkey").alias("rater_ord"))


def size_score(spark: SparkSession, sf: str) -> DataFrame:
    """A prediction with heavy ties: the part size on a logit-like scale."""
    return spark.read.parquet(f"{sf}/part.parquet").select(
        F.col("p_partkey").alias("item"), ((F.col("p_size") - 25.5) / 14.5).alias("b"))


def rate_score(cells: DataFrame) -> DataFrame:
    """Difficulty read off the failure count, without a fit."""
    return cells.groupBy("item").agg(
        F.log((F.sum(1 - F.col("y")) + 0.5) / (F.sum("y") + 0.5)).alias("b"))


def plain_bank(spark: SparkSession, sf: str) -> DataFrame:
    """A bank without a fit: b from failure counts, a from part size, s from counts."""
    cells = panel(spark, sf)
    b = cells.groupBy("item").agg(
        F.log((F.sum(1 - F.col("y")) + 0.5) / (F.sum("y") + 0.5)).alias("b"),
        (1 / F.sqrt(F.count("*") * 0.25 + 1)).alias("s"))
    size = spark.read.parquet(f"{sf}/part.parquet").select(
        F.col("p_partkey").alias("item"), (0.8 + F.col("p_size") / 100).alias("a"))
    return b.join(size, "item").select("item", "b", "a", "s")


PANEL = """panel AS (
  SELECT l_partkey AS item, l_suppkey AS rater,
         max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)::INTEGER AS y
  FROM lineitem GROUP BY 1, 2)"""
TYPES = "types AS (SELECT p_partkey AS item, p_brand AS item_type FROM part)"
SIZE = "size_score AS (SELECT p_partkey AS item, (p_size - 25.5) / 14.5::DOUBLE AS b FROM part)"
RATE = """rate_score AS (
  SELECT item, ln((sum(1 - y) + 0.5)::DOUBLE / (sum(y) + 0.5)::DOUBLE) AS b FROM panel GROUP BY 1)"""
BANK = """bank AS (
  SELECT item, b, 0.8::DOUBLE + p_size / 100.0::DOUBLE AS a, s FROM (
    SELECT item, ln((sum(1 - y) + 0.5)::DOUBLE / (sum(y) + 0.5)::DOUBLE) AS b,
           1 / sqrt(count(*) * 0.25::DOUBLE + 1) AS s FROM panel GROUP BY 1)
  JOIN part ON p_partkey = item)"""


def rank_sql(value: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    tie = f"PARTITION BY {by + ', ' if by else ''}{value}"
    return (f"(rank() OVER ({part}ORDER BY {value}) "
            f"+ (count(*) OVER ({tie}) - 1) / 2.0::DOUBLE)")


def auroc_sql(src: str, by: str = "") -> str:
    """auroc per group over a relation with y and p."""
    sel, grp = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""SELECT {sel}CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN
      (sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y)::DOUBLE * (sum(y) + 1) / 2)
      / (sum(y)::DOUBLE * sum(1 - y)) END AS auroc
      FROM (SELECT *, {rank_sql('p', by)} AS r FROM {src}) {grp}"""
