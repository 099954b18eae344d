"""The most informative next items for all raters at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.logistic import ENTROPY_FLOOR
from ..session import cut_lineage, parallelism
from .posterior import _curve_rows, _np_sig
from .rank import text_index

# Items that score alike are one kind. A task scores one block of kinds against one chunk
# of raters, KIND_ROWS x SCORE_ROWS at a time, and no pair ever becomes a row.
ITEM_BLOCK, RATER_CHUNK, KIND_ROWS, SCORE_ROWS = 16_384, 4_096, 4_096, 256
PROBIT_LOGIT = 2.9           # fixed value: constant of the shrunk information
GAIN_DIGITS = 12             # equal gains are equal only after rounding float noise


def _entropy(p: np.ndarray) -> np.ndarray:
    q = np.clip(p, ENTROPY_FLOOR, 1 - ENTROPY_FLOOR)
    return -(q * np.log(q) + (1 - q) * np.log(1 - q))


def _eig_score(raters: pd.DataFrame, items: pd.DataFrame) -> Callable:
    m = (np.vstack(items["m"].to_numpy()) if "m" in items else
         _curve_rows(*items[["b", "a", "s"]].to_numpy(dtype=float).T))
    h = _entropy(m).T

    def score(part: slice) -> np.ndarray:
        post = np.vstack(raters["post"].iloc[part].to_numpy())
        return _entropy(post @ m.T) - post @ h
    return score


def _fisher_score(raters: pd.DataFrame, items: pd.DataFrame) -> Callable:
    a, b = items["a"].to_numpy(dtype=float), items["b"].to_numpy(dtype=float)
    theta = raters["theta"].to_numpy(dtype=float)

    def score(part: slice) -> np.ndarray:
        p = _np_sig(a[None, :] * (theta[part, None] - b[None, :]))
        return a[None, :] ** 2 * p * (1 - p)
    return score


def _shrunk_score(raters: pd.DataFrame, items: pd.DataFrame) -> Callable:
    b, s2 = items["b"].to_numpy(dtype=float), items["s2"].to_numpy(dtype=float)
    theta = raters["theta"].to_numpy(dtype=float)

    def score(part: slice) -> np.ndarray:
        p = _np_sig((theta[part, None] - b[None, :]) / np.sqrt(1 + s2[None, :] / PROBIT_LOGIT))
        return p * (1 - p)
    return score


def _block_scorer(score: Callable, k: int) -> Callable:
    def run(raters: pd.DataFrame, kinds: pd.DataFrame) -> pd.DataFrame:
        out = {"rater": [np.empty(0, dtype=object)], "bank_ord": [np.empty(0, dtype="int64")], "gain": [np.empty(0)]}
        ids = raters["rater"].to_numpy(dtype=object)
        for lo in range(0, len(kinds), KIND_ROWS):
            some = kinds.iloc[lo:lo + KIND_ROWS]
            members = some["members"].to_numpy()
            size = some["size"].to_numpy()
            where = {kind: at for at, kind in enumerate(some["kind"].tolist())}
            scored = score(raters, some)
            for at in range(0, len(raters), SCORE_ROWS):
                part = slice(at, at + SCORE_ROWS)
                gain = np.round(scored(part), GAIN_DIGITS)
                gain[~np.isfinite(gain)] = -np.inf
                answered = [_by_kind(done, where) for done in raters["done"].iloc[part]]
                for row, seen in enumerate(answered):
                    for kind, own in seen.items():
                        if len(own) == size[kind]:
                            gain[row, kind] = -np.inf
                # the k best items are of kinds that gain no less than the k-th best kind
                kth = min(k, gain.shape[1])
                least = np.partition(gain, gain.shape[1] - kth, axis=1)[:, gain.shape[1] - kth]
                rows, best = np.nonzero((gain >= least[:, None]) & (gain > -np.inf))
                for row, found in zip(np.unique(rows), np.split(best, np.flatnonzero(np.diff(rows)) + 1)):
                    seen = answered[row]
                    left = [[i for i in members[kind] if i not in seen[kind]][:k] if kind in seen
                            else members[kind][:k] for kind in found.tolist()]
                    ords = np.concatenate(left).astype("int64")
                    own = np.repeat(gain[row, found], [len(x) for x in left])
                    first = np.lexsort((ords, -own))[:k]      # the larger gain, then the smaller item
                    out["rater"].append(np.repeat(ids[at + row:at + row + 1], len(first)))
                    out["bank_ord"].append(ords[first])
                    out["gain"].append(own[first])
        return pd.DataFrame({c: np.concatenate(v) for c, v in out.items()})
    return run


def _by_kind(done, where: dict) -> dict[int, set]:
    """Answered items of a rater by the place of their kind."""
    found: dict[int, set] = {}
    for one in done if done is not None else ():
        if one["kind"] in where:
            found.setdefault(where[one["kind"]], set()).add(one["bank_ord"])
    return found


def _best_items(raters: DataFrame, items: DataFrame, administered: DataFrame, k: int,
                score: Callable) -> DataFrame:
    """Top k items per rater among those the rater has not answered.

    Items with the same parameters gain the same, so a rater is scored against each
    distinct set of parameters once: a kind, known by its first item. A kind carries its
    first items, k more than any rater has answered of one kind. raters and kinds meet in
    blocks: a rater row is copied once per block of kinds, a kind once per rater chunk,
    and each meeting returns k rows per rater and KIND_ROWS kinds.
    """
    params = [c for c in items.columns if c != "item"]
    placed = cut_lineage(text_index(items, "item", "bank_ord"), "bank")
    raters = cut_lineage(raters, "candidates")
    kinds = placed.groupBy(*params).agg(F.min("bank_ord").alias("kind"), F.count("*").alias("size"))
    kinds = cut_lineage(kinds, "kinds")
    n_kinds, n_raters, n = kinds.count(), raters.count(), parallelism(raters.sparkSession)
    n_blocks = -(-n_kinds // ITEM_BLOCK)
    if not n_blocks or not n_raters:
        empty = raters.limit(0).select("rater")
        return empty.withColumn("rank", F.lit(1)).withColumn("item", F.lit(None)).withColumn(
            "gain", F.lit(0.0))
    # more chunks cost copies of parameters only, so there is work for every task
    n_chunks = max(-(-n_raters // RATER_CHUNK), min(n_raters, -(-n // n_blocks)))
    block = F.pmod(F.xxhash64("kind"), F.lit(n_blocks)).cast("int").alias("block")
    same = [placed[c].eqNullSafe(kinds[c]) for c in params]
    members = cut_lineage(placed.join(kinds, same).select("item", "bank_ord", "kind", block), "members")
    done = (administered.select("rater", "item").distinct().join(members, "item")
            .groupBy("rater", "block").agg(F.collect_list(F.struct("kind", "bank_ord")).alias("done")))
    done = cut_lineage(done, "done")
    most = done.select("rater", F.explode("done.kind").alias("kind")).groupBy("rater", "kind").count().agg(
        F.max("count")).first()[0] or 0
    first = Window.partitionBy("kind").orderBy("bank_ord")
    lists = (members.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + most)
             .groupBy("kind").agg(F.sort_array(F.collect_list("bank_ord")).alias("members")))
    chunk = F.pmod(F.xxhash64("rater"), F.lit(n_chunks)).cast("int").alias("chunk")
    left = raters.select(
        "*", chunk, F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    left = left.join(done, ["rater", "block"], "left")
    right = kinds.join(lists, "kind").select(
        "*", block, F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("chunk"))
    left, right = (side.repartition(n, "block", "chunk") for side in (left, right))
    kind = raters.schema["rater"].dataType.simpleString()
    scored = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInPandas(
        _block_scorer(score, k), f"rater {kind}, bank_ord bigint, gain double")
    order = Window.partitionBy("rater").orderBy(F.desc("gain"), "bank_ord")
    top = scored.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)
    return top.join(placed.select("bank_ord", "item"), "bank_ord").select(
        "rater", "rank", "item", "gain")


def next_item(posts: DataFrame, bank: DataFrame, administered: DataFrame,
              k: int = 1) -> DataFrame:
    """Items with the largest expected information gain about ability.

    gain = h(E m) - E h(m) over the rater's posterior, difficulty integrated out
    inside m. Equal gains go to the smaller item. A rater who has answered the
    whole bank has no row. posts (rater, post); bank (item, b, a, s), whose curves are
    made where they are scored, or ready curves (item, m).
    """
    params = ["m"] if "m" in bank.columns else [F.col(c).cast("double").alias(c) for c in ("b", "a", "s")]
    return _best_items(posts.select("rater", "post"), bank.select("item", *params),
                       administered, k, _eig_score)


def next_item_fisher(thetas: DataFrame, bank: DataFrame, administered: DataFrame,
                     k: int = 1) -> DataFrame:
    """Items with the largest a^2 p(1-p) at the rater's ability."""
    return _best_items(thetas.select("rater", "theta"), bank.select("item", "b", "a"),
                       administered, k, _fisher_score)


def next_item_shrunk(thetas: DataFrame, predicted: DataFrame, administered: DataFrame,
                     k: int = 1) -> DataFrame:
    """Items by p(1-p) with the predicted difficulty's own variance s2 shrunk in."""
    return _best_items(thetas.select("rater", "theta"), predicted.select("item", "b", "s2"),
                       administered, k, _shrunk_score)


def residual_variance(predicted: DataFrame, fold: str = "fold") -> DataFrame:
    """(fold, s2, n_items): variance of residuals on the training side of each fold.

    A fold leaves out the items of its own value, so its training side is the whole
    less that group: moments are summed once per group and never per fold. They are
    taken about the overall mean, which keeps the subtraction exact enough. NULL where
    nothing is left to train on.
    """
    d = F.col("b") - F.col("b_tilde")
    middle = predicted.agg(F.coalesce(F.avg(d), F.lit(0.0)).alias("m")).first()["m"]
    each = predicted.groupBy(fold).agg(
        F.count(d).alias("n"), F.sum(d - middle).alias("s"), F.sum((d - middle) ** 2).alias("ss"))
    whole = each.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "s", "ss")]).first()
    n, s, ss = (F.lit(whole[c]) - F.col(c) for c in ("n", "s", "ss"))
    return each.select(fold, F.when(n > 0, ss / n - (s / n) ** 2).alias("s2"), n.alias("n_items"))
