"""Ability posterior on a grid and the success rate it implies.

What a rater's responses add up to is asked for in one of two ways. From a bank
(item, b, a, s), responses carry three parameters each, are ordered by rater and
item over equal ranges, and the curves are made where they are summed: a range
sends one vector per rater in it, however many responses that rater has, and a
rater with a third of all responses is simply many ranges. From ready curves
(item, m), for curves of another kind, each response is joined to its vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import GRID_SIZE, ability_grid, ability_prior, difficulty_nodes
from ..functions.grid import GRID_LOW, GRID_STEP, LIKELIHOOD_FLOOR, prior_column
from ..functions.logistic import SIG_BOUND
from ..session import cut_lineage, parallelism

INTERVAL = (0.025, 0.975)     # fixed value: 95 % interval
CURVE_CHUNK = 256             # items whose node table is in memory at once
CURVES_KEPT = 32_768          # curves a task remembers (64 MB); more are made again
STEP_BLOCK = 1_000            # steps of one rater that are accumulated in one group


def _np_sig(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -SIG_BOUND, SIG_BOUND)))


def _curve_rows(b: np.ndarray, a: np.ndarray, s: np.ndarray) -> np.ndarray:
    """One row of grid chances per item."""
    grid = ability_grid()
    x, w = difficulty_nodes()
    out = np.empty((len(b), GRID_SIZE))
    for k in range(0, len(b), CURVE_CHUNK):
        bb, aa, ss = (v[k:k + CURVE_CHUNK, None] for v in (b, a, s))
        plain = _np_sig(aa * (grid[None, :] - bb))
        wide = ss[:, 0] > 0
        if wide.any():
            drawn = bb[wide] + ss[wide] * x[None, :]
            z = aa[wide][:, :, None] * (grid[None, :, None] - drawn[:, None, :])
            plain[wide] = _np_sig(z) @ w
        out[k:k + CURVE_CHUNK] = plain
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _curve(b: pd.Series, a: pd.Series, s: pd.Series) -> pd.Series:
    return pd.Series(list(_curve_rows(*(v.to_numpy(dtype=float) for v in (b, a, s)))))


def item_curves(bank: DataFrame, marginalise: bool = True) -> DataFrame:
    """(item, m): chance of a pass at each grid ability, difficulty integrated out.

    bank (item, b, a, s). s <= 0, or marginalise=False, gives the plain curve.
    Map-only; write it once and reuse it, every later operator only reads it.
    """
    s = F.col("s").cast("double") if marginalise else F.lit(0.0)
    # a few bytes per item become much arithmetic: spread by count, not by size
    bank = bank.repartition(parallelism(bank.sparkSession), "item")
    return bank.select("item", _curve(F.col("b").cast("double"), F.col("a").cast("double"), s)
                       .alias("m"))


def _with_log_curves(curves: DataFrame) -> DataFrame:
    """Log-likelihood of a pass and of a failure, once per item."""
    floor = f"{LIKELIHOOD_FLOOR!r}D"
    return curves.select(
        "item", "m", F.expr(f"transform(m, x -> ln(x + {floor}))").alias("ll_pass"),
        F.expr(f"transform(m, x -> ln(1 - x + {floor}))").alias("ll_fail"))


def _item_vectors(curves: DataFrame, moments: bool = False) -> DataFrame:
    """(item, v_pass, v_fail): what one response adds, as vectors made once per item.

    The log-likelihood at every grid point, with moments followed by the three
    cumulants of the outcome. Written once, so no response row repeats the work.
    """
    logs = _with_log_curves(curves)
    more = f", {', '.join(_cumulants())}" if moments else ""
    both = logs.selectExpr("item", f"concat(ll_pass{more}) AS p", f"concat(ll_fail{more}) AS f")
    return cut_lineage(both.select("item", array_to_vector("p").alias("v_pass"),
                                   array_to_vector("f").alias("v_fail")), "itemvectors")


class _Curves:
    """Curves by parameters, or what else is made of them; a bounded number is remembered within a task."""

    def __init__(self, kept: int = CURVES_KEPT, make: Callable | None = None, shape: tuple = (GRID_SIZE,)):
        self.kept, self.n, self.make, self.shape = kept, 0, make or _curve_rows, shape
        self.place: dict[tuple, int] = {}
        self.rows = np.empty((0, *shape))

    def of(self, params: np.ndarray) -> np.ndarray:
        """(rows, grid) for rows of b, a, s."""
        at = self.at(params)
        return self.rows[at]

    def at(self, params: np.ndarray) -> np.ndarray:
        """Places in self.rows for rows of b, a, s, good until the next call."""
        own, at = np.unique(params, axis=0, return_inverse=True)
        keys = list(map(tuple, own.tolist()))
        new = [k for k, key in enumerate(keys) if key not in self.place]
        if self.n + len(new) > self.kept:
            self.place, self.n, new = {}, 0, list(range(len(keys)))
        if self.n + len(new) > len(self.rows):
            more = np.empty((max(self.n + len(new), min(2 * len(self.rows), self.kept)), *self.shape))
            more[:self.n] = self.rows[:self.n]
            self.rows = more
        self.rows[self.n:self.n + len(new)] = self.make(*own[new].T)
        self.place.update((keys[k], self.n + i) for i, k in enumerate(new))
        self.n += len(new)
        return np.array([self.place[key] for key in keys], dtype=int)[at.reshape(-1)]


def _outcome_sums(moments: bool) -> Callable:
    """Sums of what responses add, per rater of a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        curves = _Curves()
        for batch in batches:
            if not batch.num_rows:
                continue
            b, a, s, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("b", "a", "s", "y"))
            m = curves.of(np.stack([b, a, s], axis=1))
            parts = [np.log(np.where(y[:, None] == 1, m, 1 - m) + LIKELIHOOD_FLOOR)]
            if moments:
                spread = m * (1 - m)
                parts += [m, spread, spread * (1 - 2 * m)]
            # dictionary codes keep ids of any type as they are, also null ones
            raters = batch.column("rater").dictionary_encode(null_encoding="encode")
            code = raters.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
            v = np.hstack([np.add.reduceat(part[order], first, axis=0) for part in parts])
            offsets = np.arange(0, v.size + 1, v.shape[1], dtype="int32")
            passed = np.add.reduceat(np.nan_to_num(y)[order], first)
            yield pa.RecordBatch.from_arrays(
                [raters.dictionary, pa.ListArray.from_arrays(offsets, v.reshape(-1)), pa.array(passed),
                 pa.array(np.diff(np.r_[first, len(y)]), pa.int64())], ["rater", "v", "passed", "n"])
    return run


def _bank_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cumulants of the outcomes of all items of a batch."""
    for pdf in batches:
        if len(pdf):
            m = _curve_rows(*pdf[["b", "a", "s"]].to_numpy(dtype=float).T)
            spread = m * (1 - m)
            v = np.hstack([m.sum(0), spread.sum(0), (spread * (1 - 2 * m)).sum(0)])
            yield pd.DataFrame({"v": [v], "n": [len(pdf)]})


def _parameters(bank: DataFrame) -> DataFrame:
    return bank.select("item", *[F.col(c).cast("double").alias(c) for c in ("b", "a", "s")])


def response_sums(responses: DataFrame, bank: DataFrame, moments: bool = False) -> DataFrame:
    """(rater, v, passed, n_administered) for settled responses.

    v is the log-likelihood at every grid point, with moments followed by the three
    cumulants of the outcome. bank is (item, b, a, s) or (item, m), see above. Items
    outside the bank are ignored.
    """
    if "m" in bank.columns:
        parts = responses.join(_item_vectors(bank, moments), "item").select(
            "rater", F.expr("IF(y = 1, v_pass, v_fail)").alias("v"),
            F.col("y").cast("double").alias("passed"), F.lit(1).alias("n"))
    else:
        known = responses.select("rater", "item", F.col("y").cast("double").alias("y")).join(
            _parameters(bank), "item")
        # item is part of the key, so one rater may fill many ranges
        placed = known.repartitionByRange(parallelism(responses.sparkSession), "rater", "item").sortWithinPartitions(
            "rater")
        kind = responses.schema["rater"].dataType.simpleString()
        parts = placed.select("rater", "y", "b", "a", "s").mapInArrow(
            _outcome_sums(moments), f"rater {kind}, v array<double>, passed double, n bigint").select(
                "rater", array_to_vector("v").alias("v"), "passed", "n")
    return parts.groupBy("rater").agg(
        vector_to_array(Summarizer.sum(F.col("v"))).alias("v"), F.sum("passed").alias("passed"),
        F.sum("n").alias("n_administered"))


def _bank_totals(bank: DataFrame) -> tuple[list[float], int]:
    """Cumulants over the whole bank at every grid point, and its number of items."""
    if "m" in bank.columns:
        parts = bank.select(F.expr(f"concat({', '.join(_cumulants())})").alias("v"), F.lit(1).alias("n"))
    else:
        spread = _parameters(bank).repartition(parallelism(bank.sparkSession), "item")
        parts = spread.mapInPandas(_bank_sums, "v array<double>, n bigint")
    whole = parts.agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"),
                      F.sum("n").alias("n")).first()
    return (list(whole["v"]), whole["n"]) if whole["n"] else ([0.0] * (3 * GRID_SIZE), 0)


def last_outcome(responses: DataFrame, order: str = "step") -> DataFrame:
    """The last outcome per (rater, item), as a mapping from item to outcome keeps it."""
    return responses.groupBy("rater", "item").agg(F.max_by("y", order).alias("y"))


def settled(responses: DataFrame, order: str | None = None) -> DataFrame:
    """One outcome per (rater, item): the last by `order`, or by a column `step` if there is one.

    Responses without either are taken to be one per rater and item already.
    """
    order = order or ("step" if "step" in responses.columns else None)
    return last_outcome(responses, order) if order else responses


def posterior_from_loglik(sums: DataFrame, ll: str = "ll", keep=("rater",)) -> DataFrame:
    """Normalise summed log-likelihoods times the prior; NULL sums give the prior."""
    flat = f"array_repeat(0D, {GRID_SIZE})"
    return (sums.selectExpr(*keep, f"coalesce({ll}, {flat}) AS ll_")
            .withColumn("prior", prior_column())
            .selectExpr(*keep, "prior", "ll_", "array_max(ll_) AS top")
            .selectExpr(*keep, "transform(ll_, (v, g) -> exp(v - top) * prior[g]) AS q")
            .selectExpr(*keep, "q", "aggregate(q, 0D, (acc, x) -> acc + x) AS total")
            .selectExpr(*keep, "transform(q, v -> v / total) AS post"))


def theta_posterior(responses: DataFrame, bank: DataFrame,
                    raters: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """(rater, post, n_administered). Raters without a usable response get the prior.

    bank is (item, b, a, s) or curves (item, m). Of repeated outcomes the last counts,
    see `settled`.

    Log-likelihoods add up, so each rater is one vector sum with partial sums on
    the map side: nothing is gathered per rater, however long its log.
    """
    sums = response_sums(settled(responses, order), bank).select(
        "rater", F.col("v").alias("ll"), "n_administered")
    if raters is not None:
        sums = raters.select("rater").join(sums, "rater", "left")
    sums = sums.withColumn("n_administered", F.coalesce("n_administered", F.lit(0)))
    return posterior_from_loglik(sums, keep=("rater", "n_administered"))


def posterior_mode(posts: DataFrame) -> DataFrame:
    """Add theta, the first grid point where the posterior is largest, and its SD."""
    at = F.array_position("post", F.array_max("post")) - 1
    first = F.expr(f"aggregate(transform(post, (q, g) -> q * ({GRID_LOW}D + {GRID_STEP}D * g)), "
                   "0D, (acc, x) -> acc + x)")
    second = F.expr(f"aggregate(transform(post, (q, g) -> q * pow({GRID_LOW}D + {GRID_STEP}D * g, "
                    "2D)), 0D, (acc, x) -> acc + x)")
    return (posts.withColumn("theta", F.lit(GRID_LOW) + F.lit(GRID_STEP) * at)
            .withColumn("_m1", first).withColumn("_m2", second)
            .withColumn("theta_sd", F.sqrt(F.greatest(F.col("_m2") - F.col("_m1") ** 2,
                                                      F.lit(0.0))))
            .drop("_m1", "_m2"))


# --- success rate over the bank --------------------------------------------------

def _erf(x: np.ndarray) -> np.ndarray:
    # Fixed coefficients of the classical rational approximation (1.5e-7).
    p, c = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    t = 1.0 / (1.0 + p * np.abs(x))
    poly = np.zeros_like(x)
    for k in reversed(c):
        poly = (poly + k) * t
    return np.sign(x) * (1.0 - poly * np.exp(-x * x))


def _count_cdf(k, mean, var, third):
    """P(count <= k) for independent outcomes with these summed cumulants.

    Normal with the skewness term; a count without variance is a step.
    """
    sd = np.sqrt(np.maximum(var, 1e-300))
    x = np.clip((k[:, None] + 0.5 - mean) / sd, -40, 40)
    phi = np.exp(-0.5 * x * x) / np.sqrt(2 * np.pi)
    skew = third / sd ** 3
    smooth = 0.5 * (1 + _erf(x / np.sqrt(2))) + skew * (1 - x * x) * phi / 6
    return np.where(var > 1e-9, np.clip(smooth, 0, 1), (k[:, None] + 0.5 >= mean) * 1.0)


@F.pandas_udf(T.StructType([T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())]))
def _rate_interval(post: pd.Series, mean: pd.Series, var: pd.Series, third: pd.Series,
                   passed: pd.Series, rest: pd.Series, bank: pd.Series) -> pd.DataFrame:
    """Quantiles of (passed + count)/bank under the posterior mixture, by bisection."""
    if not len(post):
        return pd.DataFrame({"lo": [], "hi": []}, dtype="float64")
    q, m, v, k3 = (np.vstack(c.to_numpy()) for c in (post, mean, var, third))
    v = np.maximum(v, 0.0)
    n = rest.to_numpy(dtype=float)
    cols = {}
    for name, level in zip(("lo", "hi"), INTERVAL):
        low, high = -np.ones(len(q)), n.copy()       # F(low) < level <= F(high)
        while (high - low > 1).any():
            mid = np.floor((low + high) / 2)
            ok = (q * _count_cdf(mid, m, v, k3)).sum(1) >= level
            high, low = np.where(ok, mid, high), np.where(ok, low, mid)
        cols[name] = (passed.to_numpy(dtype=float) + high) / bank.to_numpy(dtype=float)
    return pd.DataFrame(cols)


def _cumulants(m: str = "m") -> list[str]:
    return [m, f"transform({m}, x -> x * (1 - x))",
            f"transform({m}, x -> x * (1 - x) * (1 - 2 * x))"]


def success_rate(responses: DataFrame, bank: DataFrame,
                 raters: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """Posterior and success rate over the bank, all raters in one job.

    bank is (item, b, a, s) or curves (item, m). Of repeated outcomes the last counts,
    see `settled`.

    Observed outcomes count as they are, the others follow their curves. Per
    grid point the number of passes among unanswered items is a sum of
    independent outcomes, so its moments are bank totals minus the totals of the
    rater's own items: no rater x item table. sr_mean and sr_se are exact; the
    interval inverts the mixture of these counts.
    Returns rater, post, n_administered, n_bank, sr_mean, sr_se, sr_lo, sr_hi.
    """
    totals, n_bank = _bank_totals(bank)
    sums = response_sums(settled(responses, order), bank, moments=True)
    if raters is not None:
        sums = raters.select("rater").join(sums, "rater", "left")
    n = GRID_SIZE
    bank_c = F.array(*[F.lit(float(x)) for x in totals])
    sums = (sums.withColumn("n_administered", F.coalesce("n_administered", F.lit(0)))
            .withColumn("passed", F.coalesce("passed", F.lit(0.0)))
            .withColumn("n_bank", F.lit(n_bank).cast("bigint")).withColumn("bank_c", bank_c)
            .selectExpr("rater", "passed", "n_administered", "n_bank", f"slice(v, 1, {n}) AS ll",
                        f"IF(v IS NULL, bank_c, zip_with(bank_c, slice(v, {n + 1}, {3 * n}), "
                        "(x, y) -> x - y)) AS c"))
    keep = ("rater", "passed", "n_administered", "n_bank", "c")
    posts = posterior_from_loglik(sums, keep=keep).selectExpr(
        "rater", "passed", "n_administered", "n_bank", "post", f"slice(c, 1, {n}) AS s1",
        f"slice(c, {n + 1}, {n}) AS s2", f"slice(c, {2 * n + 1}, {n}) AS s3",
        "n_bank - n_administered AS rest")
    total = "aggregate(zip_with(post, {}, (q, x) -> q * x), 0D, (acc, x) -> acc + x)"
    square = "zip_with(s1, s2, (s, v) -> greatest(v, 0D) + s * s)"
    moments = posts.selectExpr("*", f"{total.format('s1')} AS e1", f"{total.format(square)} AS e2")
    done = moments.withColumn("ci", _rate_interval("post", "s1", "s2", "s3", "passed", "rest",
                                                   "n_bank"))
    return done.selectExpr(
        "rater", "post", "n_administered", "n_bank",
        "IF(rest = 0, passed, passed + e1) / n_bank AS sr_mean",
        "IF(rest = 0, 0D, sqrt(greatest(e2 - e1 * e1, 0D))) / n_bank AS sr_se",
        "ci.lo AS sr_lo", "ci.hi AS sr_hi")


def estimate_raters(responses: DataFrame, bank: DataFrame,
                    raters: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """Ability and success rate of every rater; items outside the bank are ignored.

    theta_sd belongs to theta and sr_se to the success rate; they are two columns.
    """
    return posterior_mode(success_rate(responses, bank, raters, order)).select(
        "rater", "theta", "theta_sd", "sr_mean", "sr_lo", "sr_hi", "sr_se",
        "n_administered", "n_bank")


# --- precision after every step --------------------------------------------------

def _step_rows(b: np.ndarray, a: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Log-likelihood of a failure and of a pass, and information, of each item at every grid point."""
    m, p = _curve_rows(b, a, s), _curve_rows(b, a, np.zeros_like(s))
    return np.stack([np.log(1 - m + LIKELIHOOD_FLOOR), np.log(m + LIKELIHOOD_FLOOR), (a * a)[:, None] * p * (1 - p)], axis=1)


class _Steps:
    """Log-likelihood and information of responses; a task makes those of an item once."""

    def __init__(self):
        self.items = _Curves(make=_step_rows, shape=(3, GRID_SIZE))

    def of(self, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Both for every row at every grid point."""
        at = self.items.at(pdf[["b", "a", "s"]].to_numpy(dtype=float))
        return self.items.rows[at, (pdf["y"].to_numpy(dtype=float) == 1).astype(int)], self.items.rows[at, 2]

    def total(self, pdf: pd.DataFrame) -> pd.DataFrame:
        ll, info = self.of(pdf)
        return pd.DataFrame({"rater": pdf["rater"].iloc[:1].to_list(),
                             "block": pdf["block"].iloc[:1].to_list(),
                             "t": [np.concatenate([ll.sum(0), info.sum(0)])]})

    def running(self, pdf: pd.DataFrame) -> pd.DataFrame:
        grid, prior = ability_grid(), ability_prior()
        carry = pdf.loc[pdf["carry"].notna(), "carry"]
        steps = pdf[pdf["step"].notna()].sort_values("step")
        if steps.empty:
            return pd.DataFrame({c: [] for c in ("rater", "step", "theta", "theta_sd", "se")})
        ll, info = self.of(steps)
        if len(carry):
            start = np.asarray(carry.iloc[0], dtype=float)
            ll[0] += start[:GRID_SIZE]
            info[0] += start[GRID_SIZE:]
        np.cumsum(ll, axis=0, out=ll)
        np.cumsum(info, axis=0, out=info)
        ll -= ll.max(1, keepdims=True)
        q = np.exp(ll, out=ll)
        q *= prior
        q /= q.sum(1, keepdims=True)
        mode = q.argmax(1)
        mean = q @ grid
        return pd.DataFrame({
            "rater": steps["rater"].to_numpy(), "step": steps["step"].astype("int64").to_numpy(),
            "theta": grid[mode], "theta_sd": np.sqrt(np.maximum(q @ grid ** 2 - mean ** 2, 0.0)),
            "se": 1.0 / np.sqrt(info[np.arange(len(q)), mode] + 1.0)})


def precision_by_step(log: DataFrame, bank: DataFrame, marginalise: bool = True) -> DataFrame:
    """(rater, step, theta, theta_sd, se) after each response of an ordered log.

    theta is the running posterior mode, se = 1/sqrt(sum a^2 p(1-p) + 1) there.
    Steps are unique within a rater. A log is cut into blocks of steps; for logs
    longer than a block the block totals are summed first and carried in, so one
    very long log is worked on in many places. The log with its parameters is written
    once, as it is read for the ends, the totals and the steps. Only item parameters
    travel; a curve is computed once by each task that meets it.
    """
    s = F.col("s").cast("double") if marginalise else F.lit(0.0)
    params = bank.select("item", F.col("b").cast("double").alias("b"),
                         F.col("a").cast("double").alias("a"), s.alias("s"))
    known = cut_lineage(log.join(params, "item").select(
        "rater", F.col("step").cast("bigint").alias("step"),
        F.floor(F.col("step") / STEP_BLOCK).cast("bigint").alias("block"),
        F.col("y").cast("double").alias("y"), "b", "a", "s"), "steplog")
    kind = known.schema["rater"].dataType.simpleString()
    none, steps = F.lit(None), _Steps()
    rows = known.withColumn("carry", none.cast("array<double>"))
    last = cut_lineage(known.groupBy("rater").agg(F.max("block").alias("_last"), F.min("block").alias("_first"))
                       .where(F.col("_last") > F.col("_first")), "longlogs")
    if last.limit(1).count():
        earlier = (known.join(last, "rater").where(F.col("block") < F.col("_last")).select(*known.columns))
        totals = earlier.groupBy("rater", "block").applyInPandas(
            lambda pdf: steps.total(pdf), f"rater {kind}, block bigint, t array<double>")
        # totals of all blocks before the next one, element by element
        upto = Window.partitionBy("rater", "g").orderBy("block")
        carry = (totals.select("rater", "block", F.posexplode("t").alias("g", "v"))
                 .select("rater", (F.col("block") + 1).alias("block"), "g",
                         F.sum("v").over(upto).alias("v"))
                 .groupBy("rater", "block")
                 .agg(F.sort_array(F.collect_list(F.struct("g", "v"))).getField("v").alias("carry")))
        rows = rows.unionByName(
            carry.select("rater", none.cast("bigint").alias("step"), "block",
                         *[none.cast("double").alias(c) for c in ("y", "b", "a", "s")], "carry"))
    rows = rows.repartition(parallelism(log.sparkSession), "rater", "block")
    return rows.groupBy("rater", "block").applyInPandas(
        lambda pdf: steps.running(pdf), f"rater {kind}, step bigint, theta double, theta_sd double, se double")


def rollouts_to_precision(steps: DataFrame, tau: float = 0.35) -> DataFrame:
    """(rater, n_items): first step with se below tau; NULL if it is never reached."""
    return steps.groupBy("rater").agg(
        F.min(F.when(F.col("se") < tau, F.col("step"))).alias("n_items"),
        F.max("step").alias("n_logged"))
