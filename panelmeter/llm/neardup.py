"""Near-duplicate documents by DartMinHash signatures, bands and verified links.

A text is the set of its five-word shingles, each of weight 1 however often it is
seen, as links are similarities of sets. Hashed darts fall on the plane (weight, rank) of every shingle,
one per unit of area on average, and belong to one of K coordinates. A text sees
the darts below its weights and keeps the earliest rank of each coordinate, so
two texts agree in a coordinate with the probability of their Jaccard similarity,
the one that links use, and the work per text is its number of shingles plus about K ln K.

Texts that agree in a whole band of the signature share a bucket. Nothing emits
all pairs of a bucket: its smallest member is compared with the others, on whole
texts, and members are then set aside by the triangle inequality of the Jaccard
distance, and by the share of their shingles that no other member has. What is left
in a bucket with several classes is compared pair by pair where both bounds allow it.

Inputs in general: null texts are empty; texts without a word are copies of each
other; a row without doc_id is a document like any other and comes last among
equals; repeated rows are copies. Other columns are ignored.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import words as W
from .graph import extended
from .tables import any_row, at, cut_lineage, pick, shielded

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
SEED = 5
U = np.uint64
#: members of one hub that one task compares with a copy of it
PER_SALT = 128
HUB_ROUNDS = 2
#: shingle sets are counted in so many hash parts to bound how much two of them share
PARTS = 64


# --- signatures ---------------------------------------------------------------------

def _rank_cells(limit: float):
    """Cells of the rank axis, doubling to width 16, then of width 16."""
    low, high = 0.0, 1 / 64
    while low < limit:
        yield low, high
        low, high = high, high * 2 if high < 16 else high + 16


def _weight_cells(limit: float):
    low, high = 0.0, 1.0
    while low < limit:
        yield low, high
        low, high = high, high * 2


@cache
def _poisson(area: float) -> np.ndarray:
    """Distribution function of the number of darts on an area."""
    n = int(area + 12 * math.sqrt(area) + 12)
    k = np.arange(n)
    logs = k * math.log(area) - area - np.concatenate([[0], np.cumsum(np.log(k[1:]))])
    return np.minimum(np.cumsum(np.exp(logs)), 1)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(np.float64) / float(1 << 53)


def _throw(best, row, element, weight, reach, k, seed):
    """Lower best[row, coordinate] to the earliest dart under (weight, reach)."""
    for c, (w0, w1) in enumerate(_weight_cells(float(weight.max(initial=0)))):
        heavy = weight > w0
        for d, (r0, r1) in enumerate(_rank_cells(float(reach.max(initial=0)))):
            at = np.flatnonzero(heavy & (reach > r0))
            if not len(at):
                continue
            cell = W.mix(element[at] ^ W.seeded(seed, c, d))
            n = np.searchsorted(_poisson((w1 - w0) * (r1 - r0)), _unit(cell), "right")
            dart = np.repeat(np.arange(len(at)), n)
            if not len(dart):
                continue
            turn = np.arange(len(dart)) - np.repeat(np.cumsum(n) - n, n)
            name = W.mix(cell[dart] + (turn + 1).astype(U) * U(W.BASE))
            rank = r0 + (r1 - r0) * _unit(W.mix(name + W.seeded(seed, 1)))
            high = w0 + (w1 - w0) * _unit(W.mix(name + W.seeded(seed, 2)))
            src = at[dart]
            ok = (rank <= reach[src]) & (high < weight[src])
            src, name, rank = src[ok], name[ok], rank[ok]
            place = row[src] * k + (W.mix(name + W.seeded(seed, 3)) % U(k)).astype(np.int64)
            packed = (rank.astype(np.float32).view(np.uint32).astype(U) << U(32)) | (name >> U(32))
            np.minimum.at(best, place, packed)


def dart_signatures(row, element, weight, n_rows, k=BANDS * ROWS, seed=SEED) -> np.ndarray:
    """n_rows x k dart names (uint32); rows of a set with no element stay at the largest value."""
    empty = np.iinfo(U).max
    best = np.full(n_rows * k, empty, dtype=U)
    total = np.bincount(row, weights=weight, minlength=n_rows) if len(row) else np.zeros(n_rows)
    darts, todo = k * math.log(k) + 2 * k, total > 0
    while todo.any():
        reach = np.zeros(n_rows)
        reach[todo] = darts / total[todo]
        use = todo[row]
        _throw(best, row[use], element[use], weight[use], reach[row[use]], k, seed)
        todo &= (best.reshape(n_rows, k) == empty).any(axis=1)
        darts *= 2
    return (best & U(0xFFFFFFFF)).astype(np.uint32).reshape(n_rows, k)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band."""
    out = np.zeros((len(signature), bands), dtype=U)
    for b in range(bands):
        key = np.full(len(signature), W.seeded(21, b), dtype=U)
        for c in range(b * rows, (b + 1) * rows):
            key = W.mix(key + signature[:, c].astype(U) * U(W.BASE))
        out[:, b] = key
    return out.view(np.int64)


def _digest(column: pa.Array, bands: int, rows: int):
    for a, b in W.batches(column):
        part, n = column.slice(a, b - a), b - a
        row, word, _ = W.words(part)
        h1, h2 = W.fingerprints(row, word, n)
        r, s, _ = W.distinct(*W.shingles(row, word, WORDS), n)
        sig = dart_signatures(r, s, np.ones(len(s)), n, bands * rows)
        has = np.bincount(row, minlength=n) > 0 if len(row) else np.zeros(n, bool)
        yield a, b, h1.view(np.int64), h2.view(np.int64), has, band_keys(sig, bands, rows)


def digests(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, row_id, h1, h2 (hash of the words) and the band keys of every row.

    Texts without a word have no keys.
    """
    schema = "doc_id long, h1 long, h2 long, keys array<long>"

    @W.frugal
    def run(it):
        for batch in it:
            for a, b, h1, h2, has, keys in _digest(batch.column("text"), bands, rows):
                limits = np.concatenate([[0], np.cumsum(np.where(has, bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a).cast(pa.int64()), pa.array(h1), pa.array(h2),
                     pa.ListArray.from_arrays(pa.array(limits), pa.array(keys[has].ravel()))],
                    names=["doc_id", "h1", "h2", "keys"])

    return (pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
            .withColumn("row_id", F.monotonically_increasing_id()))


def with_word_hash(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs with h1 and h2 added under the names _h1 and _h2."""
    schema = StructType(docs.schema.fields + [StructField("_h1", LongType()), StructField("_h2", LongType())])
    place = docs.columns.index(text)

    @W.frugal
    def run(it):
        for batch in it:
            column = batch.column(place)
            for a, b in W.batches(column):
                row, word, _ = W.words(column.slice(a, b - a))
                h1, h2 = W.fingerprints(row, word, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(a, b - a).columns, pa.array(h1.view(np.int64)),
                     pa.array(h2.view(np.int64))], names=[*batch.schema.names, "_h1", "_h2"])

    return docs.mapInArrow(run, schema)


# --- verified links -----------------------------------------------------------------

def _sets(texts: pa.Array):
    """Sorted distinct shingles of each text, one after the other."""
    for a, b in W.batches(texts):
        row, word, _ = W.words(texts.slice(a, b - a))
        r, s, _ = W.distinct(*W.shingles(row, word, WORDS), b - a)
        cuts = np.searchsorted(r, np.arange(b - a + 1))
        for i in range(b - a):
            yield s[cuts[i]:cuts[i + 1]]


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sorted arrays without repeats."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    at = np.searchsorted(x, y)
    both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
    return both / (len(x) + len(y) - both)


def similarities(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, sim): exact shingle Jaccard of unit pairs. pairs: a, b; texts: unit, text.

    The pairs of one a go to ceil(n / PER_SALT) salts, each with one copy of its
    text; a task walks its sorted rows and holds one such text at a time.
    """
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PER_SALT).cast("int").alias("salts"))
    salts = cut_lineage(salts, "salts")
    right = (pairs.join(salts, "a").join(texts.withColumnRenamed("unit", "b"), "b").select(
        "a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b", "text"))
    left = salts.join(texts.withColumnRenamed("unit", "a"), "a").select(
        "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        F.lit(None).cast("long").alias("b"), "text")
    rows = (left.unionByName(right).repartition("a", "salt")
            .sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()))

    @W.frugal
    def run(it):
        head, own = None, None
        for batch in it:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            salt, out = batch.column("salt").to_pylist(), []
            for i, s in enumerate(_sets(batch.column("text"))):
                if b[i] is None:
                    head, own = (a[i], salt[i]), s
                else:
                    assert head == (a[i], salt[i]), "a pair without its first text"
                    out.append((a[i], b[i], _jaccard(own, s)))
            if out:
                x, y, z = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(z, pa.float64())],
                    names=["a", "b", "sim"])

    return rows.mapInArrow(run, "a long, b long, sim double")


def _shared_buckets(units: DataFrame) -> DataFrame:
    """(bucket, unit) of buckets with two or more units."""
    long = units.select("unit", F.explode("keys").alias("bucket"))
    many = long.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    return long.join(cut_lineage(many, "buckets"), "bucket")


def _several(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets whose units are in two or more classes, with the class."""
    named = rows.drop("label").join(labels.withColumnRenamed("node", "unit"), "unit", "left").withColumn(
        "label", F.coalesce("label", "unit"))
    mixed = named.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter(
        "x <> y").select("bucket")
    return named.join(mixed, "bucket")


def _bounded(rows: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """rows with n, a unit's shingles, and parts: how many of them some other unit of rows has
    too, by hash part. Rows that this alone keeps from any link in their bucket are left out.

    Two sets of similarity t share t / (1 + t) (n + m) shingles or more, and never more than
    the sum over parts of the smaller count.
    """
    wanted = texts.join(rows.select("unit").distinct(), "unit").select("unit", "text")

    def sets(it, emit):
        for batch in it:
            for a, b in W.batches(batch.column("text")):
                part = batch.slice(a, b - a)
                row, word, _ = W.words(part.column("text"))
                r, v, _ = W.distinct(*W.shingles(row, word, WORDS), b - a)
                yield emit(part.column("unit"), r, v)

    def single(unit, r, v):
        return pa.RecordBatch.from_arrays([unit.take(pa.array(r)), pa.array(v.view(np.int64))],
                                          names=["unit", "shingle"])

    def counted(unit, r, v):
        n = len(unit)
        own = np.bincount(r * PARTS + (v % U(PARTS)).astype(np.int64), minlength=n * PARTS).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [unit, pa.array(np.bincount(r, minlength=n)),
             pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * PARTS, pa.int32()), pa.array(own))],
            names=["unit", "n", "parts"])

    alone = (wanted.mapInArrow(lambda it: sets(it, single), "unit long, shingle long")
             .groupBy("shingle").agg(F.count("*").alias("c"), F.min("unit").alias("unit")).filter("c = 1")
             .groupBy("unit", F.pmod("shingle", F.lit(PARTS)).cast("int").alias("part")).agg(
                 F.count("*").cast("int").alias("c"))
             .groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("part", "c"))).alias("alone")))
    alone = cut_lineage(alone, "alone")
    sizes = wanted.mapInArrow(lambda it: sets(it, counted), "unit long, n long, parts array<int>").join(
        alone, "unit", "left").select("unit", "n", F.transform("parts", lambda c, i: c - F.coalesce(
            F.element_at("alone", i), F.lit(0))).alias("parts"))
    told = rows.join(cut_lineage(sizes, "sizes"), "unit")
    least = told.groupBy("bucket").agg(F.min("n").alias("least"))
    return told.join(least, "bucket").filter(
        F.aggregate("parts", F.lit(0), lambda x, c: x + c)
        >= similarity / (1 + similarity) * (F.col("n") + F.col("least")) - 1e-6).drop("least")


def links(docs: DataFrame, units: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(links a, b, sim; labels node, label) of units (unit, doc_id, h1, h2, keys) of docs.

    Labels list the units that have a link.
    """
    spark = docs.sparkSession
    rows = cut_lineage(_shared_buckets(units), "buckets")
    wanted = units.join(rows.select("unit").distinct(), "unit").select("unit", "doc_id", "h1", "h2")
    seen = with_word_hash(pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text"))
    texts = cut_lineage(
        seen.join(wanted, (seen["_h1"] == wanted["h1"]) & (seen["_h2"] == wanted["h2"])
                  & seen["doc_id"].eqNullSafe(wanted["doc_id"])).select("unit", "text")
        .dropDuplicates(["unit"]), "texts")
    found = spark.createDataFrame([], "a long, b long, sim double")
    labels = spark.createDataFrame([], "node long, label long")
    for step in range(HUB_ROUNDS + 1):
        if not any_row(rows):
            break
        if step < HUB_ROUNDS:
            # first one hub for many bands, so few comparisons; then another one in every bucket
            order = F.col("unit") if step == 0 else F.xxhash64("bucket", "unit")
            hubs = cut_lineage(rows.groupBy("bucket").agg(F.min_by("unit", order).alias("hub")), "hubs")
            tied = rows.join(hubs, "bucket").filter("unit <> hub")
            pairs = tied.select(F.col("hub").alias("a"), F.col("unit").alias("b"))
        else:
            # a pair of several common buckets comes from the smallest of them
            common = rows.groupBy("unit").agg(F.collect_list("bucket").alias("all"))
            rows = cut_lineage(rows.join(common, "unit"), "rest")
            other = rows.select("bucket", *[F.col(c).alias(f"{c}2") for c in ("unit", "label", "n", "parts", "all")])
            share = similarity / (1 + similarity)
            pairs = rows.join(other, "bucket").filter(
                (F.col("unit") < F.col("unit2")) & (F.col("label") != F.col("label2"))
                & (F.aggregate(F.zip_with("parts", "parts2", lambda x, y: F.least(x, y)), F.lit(0), lambda x, c: x + c)
                   >= share * (F.col("n") + F.col("n2")) - 1e-6)
                & (F.array_min(F.array_intersect("all", "all2")) == F.col("bucket"))).select(
                F.col("unit").alias("a"), F.col("unit2").alias("b"))
        sims = cut_lineage(similarities(cut_lineage(pairs.distinct(), "pairs"), texts), "sims")
        linked = sims.filter(F.col("sim") >= similarity)
        found = found.unionByName(linked)
        labels = extended(labels, linked)
        if step == HUB_ROUNDS:
            break
        # of distance d to the hub: linked d <= t, unlinked but near d <= 2t, far. A link joins
        # units whose distances differ by t at most, so none joins linked and far ones.
        near = 1 - 2 * (1 - similarity)
        told = tied.join(sims.select(F.col("a").alias("hub"), F.col("b").alias("unit"), "sim"),
                         ["hub", "unit"])
        between = told.groupBy("bucket").agg(F.max(
            ((F.col("sim") < similarity) & (F.col("sim") >= near)).cast("int")).alias("between"))
        left = told.join(between, "bucket").filter(
            (F.col("sim") < similarity) | (F.col("between") == 1)).drop("hub", "sim", "between")
        rows = cut_lineage(_several(left, labels), "buckets")
        if step == 0:
            rows = cut_lineage(_several(cut_lineage(_bounded(rows, texts, similarity), "bounded"), labels),
                               "buckets")
    return found, labels


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of docs: doc_id, class_id, class_size, kept, h1, h2.

    Classes are the connected parts of links of the given shingle similarity or
    more among texts that share a bucket. class_id is the smallest doc_id of the
    class (null if no member has one); that document stays, once.
    """
    every = cut_lineage(digests(docs, bands, rows), "digests")
    copies = cut_lineage(every.groupBy("h1", "h2").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row_id")).alias("first"),
        F.count("*").alias("n")), "copies").select(
        "h1", "h2", "n", F.col("first.doc_id").alias("doc_id"), F.col("first.row_id").alias("unit"))
    units = cut_lineage(copies.join(every.select(F.col("row_id").alias("unit"), "keys"), "unit"), "units")
    _, labels = links(docs, units.filter(F.size("keys") > 0), similarity)
    member = units.join(labels.withColumnRenamed("node", "unit"), "unit", "left").select(
        "h1", "h2", "doc_id", "unit", "n", F.coalesce("label", "unit").alias("label"))
    classes = member.groupBy("label").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "unit")).alias("first"),
        F.sum("n").alias("class_size"))
    named = cut_lineage(member.select("h1", "h2", "label").join(cut_lineage(classes, "classes"), "label"),
                        "named")
    return every.select("doc_id", "row_id", "h1", "h2").join(named, ["h1", "h2"]).select(
        "doc_id", F.col("first.doc_id").alias("class_id"), "class_size",
        (F.col("row_id") == F.col("first.unit")).alias("kept"), "h1", "h2")


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that stay, one of each class, with all their columns."""
    classes = near_duplicates(docs, **how)
    same = Window.partitionBy("doc_id", "h1", "h2")
    stays = cut_lineage(classes.withColumn("same", F.count("*").over(same)).filter("kept").select(
        F.col("doc_id").alias("_id"), F.col("h1").alias("_k1"), F.col("h2").alias("_k2"), "same"), "stays")
    safe = shielded(docs)
    seen = with_word_hash(safe, at(docs, "text"))
    rows = seen.join(stays, (seen["_h1"] == stays["_k1"]) & (seen["_h2"] == stays["_k2"])
                     & seen[at(docs, "doc_id")].cast("long").eqNullSafe(stays["_id"]))
    if any_row(stays.filter("same > 1")):      # rows that repeat both id and words
        rows = rows.filter("same = 1").unionByName(
            rows.filter("same > 1").dropDuplicates(["_id", "_k1", "_k2"]))
    return rows.select(*safe.columns).toDF(*docs.columns)
