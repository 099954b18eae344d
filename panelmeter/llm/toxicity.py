"""Toxicity of whole texts by a factorization machine over hashed terms.

Terms are the distinct lower-case words of a text and their first four and six
bytes, hashed into buckets; a text is the set of its buckets. The machine adds a
weight per term and the inner products of the factors of every pair of terms, so
that two terms together, an insult and the group it is aimed at, can weigh more or
less than their sum. A text of n known terms gives each the value 1 / sqrt(n). Both
parts are learned together by AdaGrad on the logistic loss, over four fifths of a
bounded labelled sample in a fixed order; the last fifth fits the line from the
machine's value to log-odds.

Null and empty texts have no term and score by the bias alone. Without labelled
rows every score is 0.25. Labels other than 0 and 1 and labels without doc_id are
not learned from; repeated rows are scored alike. A doc_id that is null hashes as
an empty text. Labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import learn, tables
from . import words as W
from .tables import bucket, pick, shielded

FOLDS, HELD = 5, 0
LIMIT = 0.5
FACTORS, BATCH = 4, 128
#: passes over the sample, more where it is small
EPOCHS, LEAST_STEPS = 5, 400
STEP_WEIGHT, STEP_FACTOR = 2.0, 0.1
SHRINK_WEIGHT, SHRINK_FACTOR = 1e-6, 1e-6
LEAST_DOCS = 10
SEED = 17


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    row, word, heads = W.words(column, W.TERMS, (4, 6))
    return learn.as_buckets([(row, word), *((row, h) for h in heads)], len(column))


def raw_score(bias, weight, factor, row, at, n_rows):
    """Value of every row, the factor sums, and the value and scaled factors of each term."""
    x = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n_rows), 1))[row]
    own = factor[at] * x[:, None]
    sums = np.stack([np.bincount(row, own[:, f], n_rows) for f in range(factor.shape[1])], axis=1)
    pairs = (sums ** 2).sum(axis=1) - np.bincount(row, (own ** 2).sum(axis=1), n_rows)
    return bias + np.bincount(row, weight[at] * x, n_rows) + 0.5 * pairs, sums, x, own


def _part(sample: learn.Sample, rows: np.ndarray):
    sizes = np.diff(sample.limits)[rows]
    spans = [sample.at[sample.limits[r]:sample.limits[r + 1]] for r in rows]
    return np.repeat(np.arange(len(rows)), sizes), np.concatenate([np.zeros(0, np.int64), *spans])


def train(sample: learn.Sample) -> dict[str, np.ndarray]:
    n, rng = len(sample.known), np.random.RandomState(SEED)
    every = rng.permutation(len(sample.y))
    own, rest = every[:len(every) - len(every) // 5], every[len(every) - len(every) // 5:]
    weight, factor, bias = np.zeros(n), rng.normal(0, 0.01, (n, FACTORS)), learn.prior(sample.y)
    seen_w, seen_v, seen_b = np.full(n, 1e-6), np.full((n, FACTORS), 1e-6), 1e-6
    passes = max(EPOCHS, -(-LEAST_STEPS // max(1, -(-len(own) // BATCH))))
    for _ in range(passes if n else 0):
        order = own[rng.permutation(len(own))]
        for k in range(0, len(order), BATCH):
            rows = order[k:k + BATCH]
            local, at = _part(sample, rows)
            value, sums, x, scaled = raw_score(bias, weight, factor, local, at, len(rows))
            error = learn.sigmoid(value) - sample.y[rows]
            known, place = np.unique(at, return_inverse=True)
            pull = error[local] * x / len(rows)
            g = np.bincount(place, pull, len(known)) + SHRINK_WEIGHT * weight[known]
            gv = np.stack([np.bincount(place, pull * (sums[local, f] - scaled[:, f]), len(known))
                           for f in range(FACTORS)], axis=1) + SHRINK_FACTOR * factor[known]
            gb = error.mean()
            seen_w[known] += g * g
            seen_v[known] += gv * gv
            seen_b += gb * gb
            weight[known] -= STEP_WEIGHT * g / np.sqrt(seen_w[known])
            factor[known] -= STEP_FACTOR * gv / np.sqrt(seen_v[known])
            bias -= STEP_WEIGHT * gb / np.sqrt(seen_b)
    line = (1.0, 0.0)
    if n and min(sample.y[rest].sum(), len(rest) - sample.y[rest].sum()) >= 2:
        parts = [rest[k:k + BATCH] for k in range(0, len(rest), BATCH)]
        value = np.concatenate([raw_score(bias, weight, factor, *_part(sample, p), len(p))[0] for p in parts])
        line = learn.platt(value, sample.y[rest])
    return {"known": sample.known, "bias": np.array([bias]), "weight": weight.astype(np.float32),
            "factor": factor.astype(np.float32), "line": np.array(line)}


def probability(model, row, at, n_rows) -> np.ndarray:
    value = raw_score(model["bias"][0], model["weight"], model["factor"], row, at, n_rows)[0]
    return learn.sigmoid(model["line"][0] * value + model["line"][1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = learn.TRAIN_ROWS) -> dict:
    """The model as named arrays, learned from rows outside the held-out fold."""
    return learn.fit(learn.labelled_sample(docs, labels, "toxic", FOLDS, HELD, most), terms, train,
                     LEAST_DOCS)


def score_toxicity(docs: DataFrame, model: dict, column: str = "score", text: str = "text") -> DataFrame:
    """docs with the score of every whole text in a new column."""
    return learn.scored(docs, terms, probability, model, column, text)


def judge(docs: DataFrame, labels: DataFrame, most: int = learn.TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = fit_toxicity(docs, labels, most)
    return score_toxicity(pick(docs, "doc_id", "text"), model).select(
        "doc_id", (bucket(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score",
        (F.col("score") >= LIMIT).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, most: int = learn.TRAIN_ROWS) -> DataFrame:
    """The rows of docs that are not judged toxic, with all their columns."""
    model = fit_toxicity(docs, labels, most)
    safe = shielded(docs)
    rows = score_toxicity(safe, model, text=tables.at(docs, "text"))
    return rows.filter(F.col("score") < LIMIT).select(*safe.columns).toDF(*docs.columns)
