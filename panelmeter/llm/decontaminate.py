"""Benchmark items inside documents: size-partitioned MinHash containment, verified exactly.

An item of q distinct five-word shingles belongs to the size class c with
2^c <= q < 2^(c+1). For every class that occurs, a document's run of shingles is
cut into windows of 2^(c+2) that overlap by half, so that a passage of an item's
length lies whole in one of them and the two sets are of comparable size: a
containment of t gives a window Jaccard of t / (4 + 1 - t) or more. A window and
an item that agree in one of HASHES minima are a candidate; a true hit is missed
with probability (1 - 0.19)^HASHES at most for t = 0.8. Every candidate is then
settled on the whole document: shared distinct shingles over the item's shingles.

Items go to the tasks in blocks of at most ITEMS_PER_BLOCK, one pass over the
documents for each block, so the driver and a task hold one block at a time. No
document is shuffled.

Items of one to four words stand for one shingle of that many words; items
without words match nothing. Null texts are empty. Rows without doc_id or item_id
take part and are reported with a null; repeated rows are reported as often.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .tables import cut_lineage, pick, shielded

WORDS = 5
CONTAINMENT = 0.8
HASHES = 32
ITEMS_PER_BLOCK = 50_000
U = np.uint64
SEEDS = np.array([W.seeded(31, k) for k in range(HASHES)], dtype=U)


class ItemBlock:
    """The shingles and class-wise minima of a bounded block of items."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        row, word, _ = W.words(pa.array(texts, pa.string()))
        r, s, _ = W.distinct(*W.shingles(row, word, WORDS), len(texts))
        sizes = np.bincount(row, minlength=len(texts)) if len(row) else np.zeros(len(texts), int)
        cuts = np.searchsorted(r, np.arange(len(texts) + 1))
        self.ids = ids
        self.sets = [s[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        #: widths below WORDS that some item needs
        self.widths = sorted({int(n) for n in sizes if 0 < n < WORDS})
        self.short = {(int(n), int(x[0])): [] for n, x in zip(sizes, self.sets) if 0 < n < WORDS}
        groups: dict[int, list[int]] = {}
        for i, (n, x) in enumerate(zip(sizes, self.sets)):
            if 0 < n < WORDS:
                self.short[int(n), int(x[0])].append(i)
            elif len(x):
                groups.setdefault(int(len(x)).bit_length() - 1, []).append(i)
        #: class -> per hash, the sorted minima and the items they belong to
        self.classes = {}
        for c, members in groups.items():
            minima = np.array([[W.mix(self.sets[i] ^ k).min() for k in SEEDS] for i in members], dtype=U)
            order = np.argsort(minima, axis=0, kind="stable")
            self.classes[c] = (np.take_along_axis(minima, order, 0), np.array(members)[order])

    def candidates(self, row: np.ndarray, shingle: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) with a shared window minimum; row and shingle in text order."""
        found: set[tuple[int, int]] = set()
        if not len(shingle):
            return found
        limits = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        lengths = np.diff(np.append(limits, len(row)))
        cuts = {}
        for c in self.classes:
            half = 1 << (c + 1)
            n = -(-lengths // half)         # half windows of each row, the last one may be short
            first = np.repeat(np.cumsum(n) - n, n)
            owner = np.repeat(row[limits], n)
            cuts[c] = (np.repeat(limits, n) + (np.arange(n.sum()) - first) * half, owner,
                       owner[:-1] == owner[1:])
        for k in range(HASHES):
            hashed = W.mix(shingle ^ SEEDS[k])
            for c, (minima, members) in self.classes.items():
                start, owner, pair = cuts[c]
                low = np.minimum.reduceat(hashed, start)
                window = low.copy()
                window[:-1][pair] = np.minimum(low[:-1], low[1:])[pair]
                at = np.searchsorted(minima[:, k], window)
                hit = np.flatnonzero(minima[np.minimum(at, len(minima) - 1), k] == window)
                for w in hit:
                    j = int(at[w])
                    while j < len(minima) and minima[j, k] == window[w]:
                        found.add((int(owner[w]), int(members[j, k])))
                        j += 1
        return found

    def hits(self, column: pa.Array, containment: float):
        """(row, item, shared, size) of every item contained in a text of the column."""
        for a, b in W.batches(column, 1 << 20):
            row, word, _ = W.words(column.slice(a, b - a))
            rows, runs = W.grams(row, word, WORDS)
            near = sorted(self.candidates(rows, runs))
            cuts = np.searchsorted(rows, np.arange(b - a + 1))
            for r, i in near:
                own, item = runs[cuts[r]:cuts[r + 1]], self.sets[i]
                shared = int(np.isin(item, own).sum())
                if shared >= containment * len(item):
                    yield a + r, i, shared, len(item)
            for width in self.widths:
                rows_k, runs_k = W.grams(row, word, width)
                wanted = np.array(sorted(h for n, h in self.short if n == width), dtype=U)
                hit = np.isin(runs_k, wanted)
                for r, h in sorted({(int(x), int(y)) for x, y in zip(rows_k[hit], runs_k[hit])}):
                    for i in self.short[width, h]:
                        yield a + r, i, 1, 1


def item_blocks(items: DataFrame, most: int = ITEMS_PER_BLOCK):
    """Blocks of at most about `most` items, brought to the driver one at a time."""
    rows = cut_lineage(pick(items, "item_id", "text").select(F.col("item_id").cast("long"), "text"), "items")
    n = max(1, -(-rows.count() // most))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        part = rows.filter(block == k).collect() if n > 1 else rows.collect()
        yield ItemBlock([r.item_id for r in part], [r.text for r in part])


def contaminated_pairs(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT,
                       most: int = ITEMS_PER_BLOCK) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) of documents that hold an item."""
    schema = "doc_id long, item_id long, shared long, item_shingles long"
    source = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")

    def finder(block: ItemBlock):
        @W.frugal
        def run(it):
            for batch in it:
                ids = batch.column("doc_id")
                got = list(block.hits(batch.column("text"), containment))
                if got:
                    r, i, shared, size = zip(*got)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(r)), pa.array([block.ids[x] for x in i], pa.int64()),
                         pa.array(shared, pa.int64()), pa.array(size, pa.int64())],
                        names=["doc_id", "item_id", "shared", "item_shingles"])
        return run

    found = None
    for block in item_blocks(items, most):
        part = source.mapInArrow(finder(block), schema)
        found = part if found is None else found.unionByName(part)
    return found.withColumn("containment", F.col("shared") / F.col("item_shingles"))


def drop_contaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT,
                      most: int = ITEMS_PER_BLOCK) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    names, place, docs = docs.columns, docs.columns.index("text"), shielded(docs)

    def keeper(block: ItemBlock):
        @W.frugal
        def run(it):
            for batch in it:
                clean = np.ones(batch.num_rows, dtype=bool)
                for r, *_ in block.hits(batch.column(place), containment):
                    clean[r] = False
                yield batch.filter(pa.array(clean))
        return run

    for block in item_blocks(items, most):
        docs = docs.mapInArrow(keeper(block), docs.schema)
    return docs.toDF(*names)


def benchmark(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/benchmark.parquet")
