"""What the two text classifiers share: the bounded labelled sample, its features as one
sparse table, and scoring of whole tables with a model of bounded size.

Rows are learned from only where a fold rule on the doc_id allows it. The sample is
the `most` allowed labelled rows with the smallest hash of their doc_id. It is the one
thing that is bounded; scoring reads every row and every text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import bucket, pick

#: hashed terms fall into this many buckets
BUCKETS = 1 << 22
#: a bucket is learned if so many documents of the sample have it
LEAST_DOCS = 5
TRAIN_ROWS = 20_000

Features = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def as_buckets(parts: list[tuple[np.ndarray, np.ndarray]], n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each row, ascending by row, from several (row, hash) lists."""
    row = np.concatenate([r for r, _ in parts])
    value = np.concatenate([W.mix(h + W.seeded(41, k)) % W.U(BUCKETS) for k, (_, h) in enumerate(parts)])
    both = np.sort((row.astype(W.U) << W.U(32)) | value)
    if len(both):
        both = both[np.append(True, both[1:] != both[:-1])]
    return (both >> W.U(32)).astype(np.int64), (both & W.U(0xFFFFFFFF)).astype(np.int32)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int,
                    held: int, most: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, y) of at most `most` labelled rows outside the held-out fold."""
    chosen = (pick(labels, "doc_id", label).select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("y"))
              .filter(F.col("_id").isNotNull() & F.col("y").isin(0, 1) & (bucket(F.col("_id"), folds) != held))
              .orderBy(F.xxhash64("_id"), "_id", "y").limit(most))
    # at most `most` pairs of numbers, so the broadcast has a fixed bound
    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").join(
        F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "y")


def feature_table(sample: DataFrame, features: Features) -> DataFrame:
    """(doc_id, y, terms) of a sample."""
    @W.frugal
    def run(it):
        for batch in it:
            for a, b in W.batches(batch.column("text")):
                row, term = features(batch.column("text").slice(a, b - a))
                cuts = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("y").slice(a, b - a),
                     pa.ListArray.from_arrays(pa.array(cuts), pa.array(term))],
                    names=["doc_id", "y", "terms"])

    return sample.mapInArrow(run, "doc_id long, y int, terms array<int>")


class Sample:
    """Sparse rows over the buckets that enough documents have: row i has the places
    at[limits[i]:limits[i + 1]] in known. Memory beside that is a few arrays of BUCKETS integers."""

    def __init__(self, y: np.ndarray, limits: np.ndarray, terms: np.ndarray, least: int = LEAST_DOCS):
        count = np.zeros(BUCKETS, dtype=np.int64)
        for k in range(0, len(terms), BUCKETS):
            count += np.bincount(terms[k:k + BUCKETS], minlength=BUCKETS)
        self.known = np.flatnonzero(count >= least).astype(np.int32)
        place = np.full(BUCKETS, -1, dtype=np.int32)
        place[self.known] = np.arange(len(self.known), dtype=np.int32)
        at = place[terms]
        keep = at >= 0
        sizes = [np.count_nonzero(keep[a:b]) for a, b in zip(limits[:-1], limits[1:])]
        self.limits = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.at = at[keep]
        self.y = y.astype(np.float64)


def look_up(known: np.ndarray, row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (row, place in known) of the terms that are known."""
    if not len(known):
        return row[:0], term[:0].astype(np.int64)
    at = np.searchsorted(known, term)
    ok = known[np.minimum(at, len(known) - 1)] == term
    return row[ok], at[ok]


def fit(sample: DataFrame, features: Features, train: Callable[[Sample], dict[str, np.ndarray]],
        least: int = LEAST_DOCS) -> dict:
    """Train on the bounded sample in one task, in order of the doc_ids; returns its arrays."""
    table = feature_table(sample, features).repartition(1).sortWithinPartitions("doc_id", "y", "terms")

    @W.frugal
    def run(it):
        y, sizes, terms = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for batch in it:
            y.append(batch.column("y").to_numpy())
            sizes.append(batch.column("terms").value_lengths().to_numpy())
            terms.append(batch.column("terms").flatten().to_numpy())
        limits = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
        whole = np.concatenate(terms)
        terms.clear()
        found = Sample(np.concatenate(y), limits, whole, least)
        del whole
        model = train(found)
        for name, value in model.items():
            value = np.asarray(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([str(value.dtype)]), pa.array([list(value.shape)], pa.list_(pa.int64())),
                 pa.array([value.tobytes()])], names=["name", "kind", "shape", "data"])

    rows = table.mapInArrow(run, "name string, kind string, shape array<long>, data binary").collect()
    if not rows:                                # no task runs over a table without rows
        return train(Sample(np.zeros(0), np.zeros(1, np.int64), np.zeros(0, np.int32), least))
    return {r.name: np.frombuffer(bytes(r.data), dtype=r.kind).reshape(r.shape) for r in rows}


def scored(docs: DataFrame, features: Features, score: Callable[[dict, np.ndarray, np.ndarray, int], np.ndarray],
           model: dict, column: str = "score", text: str = "text") -> DataFrame:
    """docs with a score of every whole text; score(model, row, place, n_rows)."""
    from pyspark.sql.types import DoubleType, StructField, StructType
    at = docs.columns.index(text)
    schema = StructType(docs.schema.fields + [StructField(column, DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @W.frugal
    def run(it):
        own = shared.value
        for batch in it:
            for a, b in W.batches(batch.column(at)):
                row, term = features(batch.column(at).slice(a, b - a))
                value = score(own, *look_up(own["known"], row, term), b - a)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(a, b - a).columns, pa.array(value)], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, schema)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def prior(y: np.ndarray) -> float:
    """Log-odds of label 1, pulled to 1 : 3; that is what a sample without rows gives."""
    p = (y.sum() + 0.5) / (len(y) + 2)
    return float(np.log(p / (1 - p)))


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope (not below 0) and offset of the log-odds by Newton steps on smoothed targets.

    Margins are put to unit spread first, and a step that does not lower the loss is halved.
    """
    spread = float(np.abs(margin).mean()) or 1.0
    margin = margin / spread
    up, down = y.sum(), len(y) - y.sum()
    goal = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))

    def loss(a, b):
        z = a * margin + b
        return float((np.logaddexp(0, z) - goal * z).sum())

    a, b = 0.0, float(np.log((up + 1) / (down + 1)))
    for _ in range(steps):
        p = sigmoid(a * margin + b)
        d, h = p - goal, p * (1 - p) + 1e-9
        g = np.array([d @ margin, d.sum()]) + 1e-6 * np.array([a, b])
        hess = np.array([[h @ (margin * margin), h @ margin], [h @ margin, h.sum()]]) + 1e-6 * np.eye(2)
        da, db = np.linalg.solve(hess, g)
        size, now = 1.0, loss(a, b)
        while size > 1e-6 and loss(a - size * da, b - size * db) > now:
            size /= 2
        a, b = a - size * da, b - size * db
        if size * (abs(da) + abs(db)) < 1e-9:
            break
    if a <= 0:                                  # the margin says nothing: the share alone
        return 0.0, float(np.log((up + 1) / (down + 1)))
    return float(a) / spread, float(b)
