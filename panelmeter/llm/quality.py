"""Quality of whole texts by naive-Bayes support vectors over hashed n-grams.

A text is the set of its n-grams: words and pairs of words as written, single and
paired word endings of two bytes, and runs of three or six words that each repeat
one of the two before. An indicator is scaled by its class log-count ratio, the
scaled text is put to length 1, and a linear hinge-loss model is fitted by dual
coordinate descent, one multiplier per text of a bounded labelled sample. Two
models on halves of the sample give margins for texts they have not seen, from
which the margin's probability is fitted; the last model learns from all.

Null and empty texts have no n-gram: their margin is that of the bias. Without
labelled rows of both classes the score is the prior of the sample (0.25 without
rows). Labels other than 0 and 1 and labels without doc_id are not learned from;
repeated rows are scored alike. A doc_id that is null hashes as an empty text.
Labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import learn
from . import words as W
from .tables import bucket, pick

FOLDS, HELD = 4, 2
LIMIT = 0.7
COST, EPOCHS = 1.0, 12
SMOOTH = 1.0
SEED = 19


def repeats(row: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Whether a word equals one of the two before it in its text."""
    out = np.zeros(len(word), dtype=bool)
    for k in (1, 2):
        out[k:] |= (word[k:] == word[:-k]) & (row[k:] == row[:-k])
    return out


def ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    row, word, (end,) = W.words(column, W.PLAIN, (-2,))
    flag = repeats(row, word).astype(W.U)
    parts = [(row, word), W.grams(row, word, 2), (row, end), W.grams(row, end, 2)]
    for n in (3, 6):
        all_same = W.grams(row, flag, n)
        told = W.grams(np.zeros(n, np.int64), np.ones(n, W.U), n)[1]
        keep = np.isin(all_same[1], told)
        parts.append((all_same[0][keep], all_same[1][keep]))
    return learn.as_buckets(parts, len(column))


def log_count_ratio(y: np.ndarray, row: np.ndarray, at: np.ndarray, n: int, smooth: float = SMOOTH):
    """log of each term's share among texts of label 1 over its share among those of label 0."""
    p = smooth + np.bincount(at, y[row], n)
    q = smooth + np.bincount(at, 1 - y[row], n)
    return np.log((p / p.sum()) / (q / q.sum()))


def descend(y: np.ndarray, limits: np.ndarray, at: np.ndarray, x: np.ndarray, n: int,
            cost=COST, epochs=EPOCHS, seed=SEED) -> np.ndarray:
    """Weights (the last one is the bias) of the hinge-loss model, by dual coordinate descent.

    Texts of the rarer class cost as much in all as those of the other.
    """
    sign = np.where(y > 0, 1.0, -1.0)
    share = np.array([(sign < 0).sum(), (sign > 0).sum()], dtype=float)
    bound = np.where(sign > 0, cost * len(y) / (2 * share[1]), cost * len(y) / (2 * share[0]))
    w, alpha, rng = np.zeros(n + 1), np.zeros(len(y)), np.random.RandomState(seed)
    spans = [slice(a, b) for a, b in zip(limits[:-1], limits[1:])]
    square = np.array([float(x[s] @ x[s]) + 1 for s in spans])
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            s = spans[i]
            terms, values = at[s], x[s]
            slope = sign[i] * (w[terms] @ values + w[n]) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), bound[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[terms] += step * values
                w[n] += step
                alpha[i] = new
    return w


def _unit_rows(ratio, row, at, n_rows):
    x = ratio[at]
    length = np.sqrt(np.bincount(row, x * x, n_rows))
    return x / np.where(length > 0, length, 1)[row]


def margins(weight, ratio, row, at, n_rows) -> np.ndarray:
    return np.bincount(row, _unit_rows(ratio, row, at, n_rows) * weight[at], n_rows) + weight[-1]


def train(sample: learn.Sample) -> dict[str, np.ndarray]:
    y, n = sample.y, len(sample.known)
    if not len(y) or y.min() == y.max() or min(y.sum(), len(y) - y.sum()) < 4:
        return {"known": sample.known, "ratio": np.zeros(n), "weight": np.zeros(n + 1),
                "line": np.array([0.0, learn.prior(y)])}

    def part(rows):
        sizes = np.diff(sample.limits)[rows]
        at = np.concatenate([sample.at[sample.limits[r]:sample.limits[r + 1]] for r in rows])
        row = np.repeat(np.arange(len(rows)), sizes)
        return row, at, np.concatenate([[0], np.cumsum(sizes)])

    def learned(rows):
        row, at, limits = part(rows)
        ratio = log_count_ratio(y[rows], row, at, n)
        return ratio, descend(y[rows], limits, at, _unit_rows(ratio, row, at, len(rows)), n)

    order = np.random.RandomState(SEED).permutation(len(y))
    order = np.concatenate([order[y[order] > 0], order[y[order] == 0]])
    margin = np.zeros(len(y))
    for own, other in ((order[::2], order[1::2]), (order[1::2], order[::2])):
        ratio, weight = learned(own)
        row, at, _ = part(other)
        margin[other] = margins(weight, ratio, row, at, len(other))
    ratio, weight = learned(np.arange(len(y)))
    return {"known": sample.known, "ratio": ratio.astype(np.float32), "weight": weight,
            "line": np.array(learn.platt(margin, y))}


def probability(model, row, at, n_rows) -> np.ndarray:
    a, b = model["line"]
    return learn.sigmoid(a * margins(model["weight"], model["ratio"].astype(np.float64), row, at, n_rows) + b)


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = learn.TRAIN_ROWS) -> dict:
    """The model as named arrays, learned from rows outside the held-out fold."""
    return learn.fit(learn.labelled_sample(docs, labels, "quality", FOLDS, HELD, most), ngrams, train)


def judge(docs: DataFrame, labels: DataFrame, most: int = learn.TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = fit_quality(docs, labels, most)
    return learn.scored(pick(docs, "doc_id", "text"), ngrams, probability, model).select(
        "doc_id", (bucket(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score",
        (F.col("score") >= LIMIT).cast("int").alias("predicted"))
