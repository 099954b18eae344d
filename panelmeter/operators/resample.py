"""Cluster bootstrap: whole item types are drawn with replacement.

A replicate only changes how often each cluster counts, so it is a vector of
cluster weights. Statistics are written as forms in these weights and the data
are read once, whatever the number of replicates:

* a mean is a ratio of two linear forms in per-cluster sums;
* a rank correlation is built from cubic forms: the centred rank of an item is
  linear in the weights (items of each cluster below it), and a product of two
  ranks summed over items adds one more weight.

The cubic form needs clusters^3 numbers. Above CUBIC_CLUSTERS clusters the
replicates are instead ranked directly, a few at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import hash_int
from ..session import cut_lineage, parallelism
from .rank import running_before, value_buckets

REPLICATES = 10_000           # fixed value: replicates of a reported interval
LEVELS = (0.025, 0.975)
CUBIC_CLUSTERS = 64
CONSTANT = 1e-9             # a side with a smaller sum of squares counts as constant
REPLICATES_PER_PASS = 200


def cluster_index(df: DataFrame, cluster: str) -> DataFrame:
    """(cluster, c): clusters numbered in sorted order."""
    names = df.select(F.col(cluster).alias("cluster")).distinct()
    from .rank import text_index
    return cut_lineage(text_index(names, "cluster", "c"), "clusters")


def bootstrap_weights(clusters: DataFrame, n_clusters: int, replicates: int,
                      seed: int) -> DataFrame:
    """(rep, cluster, c, w): how often each cluster is drawn; undrawn ones have no row."""
    spark = clusters.sparkSession
    slots = spark.range(replicates).withColumnRenamed("id", "rep").select(
        "rep", F.explode(F.sequence(F.lit(0), F.lit(n_clusters - 1))).alias("slot"))
    drawn = slots.select("rep", (hash_int(F.lit(seed), F.col("rep"), F.col("slot"))
                                 % F.lit(n_clusters)).alias("c"))
    return (drawn.groupBy("rep", "c").agg(F.count("*").alias("w"))
            .join(clusters, "c").select("rep", "cluster", "c", "w"))


def bootstrap_mean(df: DataFrame, cluster: str, values: Sequence[str], replicates: int,
                   seed: int = 0) -> DataFrame:
    """(rep, value...) means of row values when clusters are resampled."""
    clusters = cluster_index(df, cluster)
    n = clusters.count()
    sums = df.groupBy(F.col(cluster).alias("cluster")).agg(
        F.count("*").alias("_n"), *[F.sum(v).alias(v) for v in values])
    weights = bootstrap_weights(clusters, n, replicates, seed)
    return weights.join(sums, "cluster").groupBy("rep").agg(
        *[(F.sum(F.col("w") * F.col(v)) / F.sum(F.col("w") * F.col("_n"))).alias(v)
          for v in values])


def bootstrap_spearman(df: DataFrame, cluster: str, y: str, predictors: Sequence[str],
                       replicates: int = REPLICATES, seed: int = 0,
                       cubic_clusters: int = CUBIC_CLUSTERS) -> DataFrame:
    """(rep, predictor...) rank correlations with y on the same resamples.

    One row of df per item. NULL where a resample leaves one side constant.
    """
    predictors = list(predictors)
    clusters = cluster_index(df, cluster)
    n = clusters.count()
    base = (df.select(F.col(cluster).alias("cluster"), y, *predictors)
            .dropna().join(F.broadcast(clusters) if n <= 1_000_000 else clusters, "cluster"))
    base = cut_lineage(base.select("c", y, *predictors), "bootbase")
    if n <= cubic_clusters:
        return _cubic(base, clusters, n, y, predictors, replicates, seed)
    return _ranked(base, clusters, n, y, predictors, replicates, seed)


def _centred_ranks(base: DataFrame, value: str, n: int) -> DataFrame:
    """(value, r): items of each cluster below the value, ties half, less half the cluster."""
    dist = cut_lineage(base.groupBy(F.col(value).alias("v"), "c").agg(F.count("*").alias("n")),
                       "distinct")
    bucketed = value_buckets(dist, "v", parallelism(base.sparkSession))
    per = bucketed.groupBy("_bucket", "c").agg(F.sum("n").alias("t"))
    # buckets x clusters numbers: a small table on every node
    rows = per.collect()
    n_buckets = max(r["_bucket"] for r in rows) + 1
    totals = np.zeros((n_buckets, n))
    for r in rows:
        totals[r["_bucket"], r["c"]] = r["t"]
    before = totals.cumsum(0) - totals
    half = totals.sum(0) / 2

    def rank_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        values, where = np.unique(pdf["v"].to_numpy(), return_inverse=True)
        counts = np.zeros((len(values), n))
        np.add.at(counts, (where, pdf["c"].to_numpy()), pdf["n"].to_numpy())
        below = before[int(pdf["_bucket"].iloc[0])] + counts.cumsum(0) - counts
        return pd.DataFrame({"v": values, "r": list(below + counts / 2 - half)})

    kind = dist.schema["v"].dataType.simpleString()
    return bucketed.groupBy("_bucket").applyInPandas(
        rank_bucket, f"v {kind}, r array<double>")


def _cubic(base, clusters, n, y, predictors, replicates, seed) -> DataFrame:
    pairs = [(y, y)] + [p for x in predictors for p in ((x, y), (x, x))]
    ranked = base
    for k, value in enumerate([y, *predictors]):
        r = _centred_ranks(base, value, n).select(
            F.col("v").alias(value), F.col("r").alias(f"_r{k}"))
        ranked = ranked.join(r, value)
    slot = {value: f"_r{k}" for k, value in enumerate([y, *predictors])}
    ranked = ranked.select("c", *slot.values())

    def partial(batches):
        total = np.zeros((len(pairs), n, n * n))
        for pdf in batches:
            mats = {v: np.vstack(pdf[s].to_numpy()) for v, s in slot.items()} if len(pdf) else {}
            owner = pdf["c"].to_numpy()
            for c in np.unique(owner):
                rows = owner == c
                for k, (left, right) in enumerate(pairs):
                    total[k, c] += (mats[left][rows].T @ mats[right][rows]).ravel()
        for k in range(len(pairs)):
            keep = np.flatnonzero(np.abs(total[k]).any(1))
            yield pd.DataFrame({"k": [k] * len(keep), "c": keep, "t": list(total[k][keep])})

    sums = (ranked.mapInPandas(partial, "k int, c bigint, t array<double>").groupBy("k", "c")
            .agg(vector_to_array(Summarizer.sum(array_to_vector("t"))).alias("t")).collect())
    form = np.zeros((len(pairs), n, n, n))
    for r in sums:
        form[r["k"], r["c"]] = np.asarray(r["t"]).reshape(n, n)

    w = bootstrap_weights(clusters, n, replicates, seed)
    per_rep = w.groupBy("rep").agg(F.collect_list("c").alias("c"), F.collect_list("w").alias("w"))

    def solve(batches):
        for pdf in batches:
            weight = np.zeros((len(pdf), n))
            for i, (c, v) in enumerate(zip(pdf["c"], pdf["w"])):
                weight[i, np.asarray(c, dtype=int)] = v
            got = []
            for k in range(len(pairs)):
                inner = np.einsum("rd,re,cde->rc", weight, weight, form[k], optimize=True)
                got.append((inner * weight).sum(1))
            out = {"rep": pdf["rep"].to_numpy()}
            for j, x in enumerate(predictors):
                xy, xx = got[1 + 2 * j], got[2 + 2 * j]
                ok = (xx > CONSTANT) & (got[0] > CONSTANT)
                out[x] = np.where(ok, xy / np.sqrt(np.where(ok, xx * got[0], 1.0)), np.nan)
            yield pd.DataFrame(out)

    schema = "rep bigint, " + ", ".join(f"`{x}` double" for x in predictors)
    solved = per_rep.repartition(parallelism(base.sparkSession), "rep").mapInPandas(solve, schema)
    return solved.select("rep", *[F.nanvl(x, F.lit(None).cast("double")).alias(x)
                                  for x in predictors])


def _ranked(base, clusters, n, y, predictors, replicates, seed) -> DataFrame:
    weights = cut_lineage(bootstrap_weights(clusters, n, replicates, seed), "weights")
    out = None
    for lo in range(0, replicates, REPLICATES_PER_PASS):
        some = weights.where(F.col("rep").between(lo, lo + REPLICATES_PER_PASS - 1))
        drawn = cut_lineage(base.join(some.select("rep", "c", "w"), "c")
                            .groupBy("rep", y, *predictors).agg(F.sum("w").alias("w")), "drawn")
        ranked = drawn
        for value in [y, *predictors]:
            dist = cut_lineage(drawn.groupBy("rep", value).agg(F.sum("w").alias("_t")), "ranks")
            placed = running_before(dist, value, ["_t"], ["rep"])
            centred = F.col("before__t") + F.col("_t") / 2.0 - F.col("total__t") / 2.0
            ranked = ranked.join(placed.select("rep", value, centred.alias(f"_r_{value}")),
                                 ["rep", value])

        def moment(a, b):
            return F.sum(F.col("w") * F.col(f"_r_{a}") * F.col(f"_r_{b}"))

        sums = ranked.groupBy("rep").agg(
            moment(y, y).alias("_yy"), *[moment(x, y).alias(f"_xy_{x}") for x in predictors],
            *[moment(x, x).alias(f"_xx_{x}") for x in predictors])
        part = cut_lineage(sums.select("rep", *[
            F.when((F.col("_yy") > CONSTANT) & (F.col(f"_xx_{x}") > CONSTANT),
                   F.col(f"_xy_{x}") / F.sqrt(F.col(f"_xx_{x}") * F.col("_yy"))).alias(x)
            for x in predictors]), "reps")
        out = part if out is None else out.unionByName(part)
    return out


def percentile_interval(reps: DataFrame, values: Sequence[str]) -> DataFrame:
    """(statistic, lo, hi, mean): percentile interval of each column over replicates."""
    long = reps.unpivot(["rep"], list(values), "statistic", "value")
    return long.groupBy("statistic").agg(
        F.percentile("value", F.lit(LEVELS[0])).alias("lo"),
        F.percentile("value", F.lit(LEVELS[1])).alias("hi"), F.avg("value").alias("mean"))


def paired_difference(reps: DataFrame, first: str, second: str) -> DataFrame:
    """One row: interval of first - second and how often it exceeds zero."""
    d = F.col(first) - F.col(second)
    return reps.where(d.isNotNull()).select(d.alias("d")).agg(
        F.percentile("d", F.lit(LEVELS[0])).alias("lo"),
        F.percentile("d", F.lit(LEVELS[1])).alias("hi"), F.avg("d").alias("mean"),
        F.avg((F.col("d") > 0).cast("double")).alias("exceedance"),
        F.count("*").alias("n_reps"))
