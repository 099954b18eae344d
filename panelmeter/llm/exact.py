"""Exact duplicates by composable polynomial fingerprints and chunkwise comparison.

The fingerprint of a byte string is (h1, h2, length) with h = sum of b_i r^(n-1-i)
modulo a prime near 2^31, twice. Chunks hash on their own and combine by shifting:
h(xy) = h(x) r^|y| + h(y). A text of up to HUGE bytes is hashed where it is read; the
chunks of a longer one are rows of their own, hashed by any task and combined by
`combine_fingerprints`.

Texts are equal when their bytes are, after each run of white space became one
space. A fingerprint only proposes: rows of a repeated fingerprint are dealt over salts,
a salt's rows are compared with its first one chunk by chunk in a sorted stream, and the
first ones of the salts are compared in the same way, level by level, until a
fingerprint has one salt. Where a row differs, that fingerprint's rows are told apart
by their SHA-256. A filter of fixed size (FILTER_BITS) over the repeated fingerprints keeps
other texts where they are; a false hit only moves a text that is then dropped.

Null texts count as empty. Of equal texts the smallest doc_id stays; a row without
doc_id stays only if no equal row has one; of repeated rows one stays. Rows are told
apart by their place in the input, so any number may share a doc_id or have none. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import SPACE, any_row, cut_lineage, pick
from .words import frugal

CHUNK = 1 << 16
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1812433253)
PER_SALT = 256
#: bytes of a text above which its chunks are hashed by other tasks
HUGE = 16 * CHUNK
FILTER_BITS = 1 << 24
#: longer white-space runs, or one white-space sign other than a space
MARK = ["h1", "h2", "n"]
NOT_PLAIN = re.compile(r"[\t-\r][\t-\r ]*| [\t-\r ]+")


def normalised(text: str | None) -> bytes:
    return NOT_PLAIN.sub(" ", text or "").encode("utf-8", "surrogatepass")


def _powers(base: int, prime: int, n: int = CHUNK) -> np.ndarray:
    out, filled = np.ones(n, dtype=np.uint64), 1
    while filled < n:
        step = pow(base, filled, prime)
        more = min(filled, n - filled)
        out[filled:filled + more] = out[:more] * np.uint64(step) % np.uint64(prime)
        filled += more
    return out[::-1].copy()


POWERS = [_powers(b, p) for b, p in zip(BASES, PRIMES)]


def chunk_hash(data: bytes) -> tuple[int, int]:
    """Of at most CHUNK bytes."""
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    return tuple(int((b * w[CHUNK - len(b):]).sum() % np.uint64(p)) for w, p in zip(POWERS, PRIMES))


def combine(left: tuple[int, int, int], right: tuple[int, int, int]) -> tuple[int, int, int]:
    """Fingerprint of two strings after each other."""
    return (*((x * pow(r, right[2], p) + y) % p
              for x, y, r, p in zip(left[:2], right[:2], BASES, PRIMES)), left[2] + right[2])


def fingerprint(data: bytes) -> tuple[int, int, int]:
    out = (0, 0, 0)
    for at in range(0, len(data), CHUNK):
        piece = data[at:at + CHUNK]
        out = combine(out, (*chunk_hash(piece), len(piece)))
    return out


def combine_fingerprints(parts: DataFrame, key: str, order: str) -> DataFrame:
    """(key, h1, h2, n) of texts in parts: one row (key, order, h1, h2, n) per part.

    A part is shifted by the bytes behind it, so sums over the parts are the fingerprint.
    """
    behind = F.sum("n").over(Window.partitionBy(key).orderBy(F.col(order).desc())
                             .rowsBetween(Window.unboundedPreceding, -1))
    rows = parts.withColumn("_behind", F.coalesce(behind, F.lit(0)))
    cols = [c for c in rows.columns]

    @frugal
    def run(it):
        for batch in it:
            t = batch.to_pydict()
            for i, (p, r) in enumerate(zip(PRIMES, BASES)):
                t[f"h{i + 1}"] = [h * pow(r, n, p) % p for h, n in zip(t[f"h{i + 1}"], t["_behind"])]
            yield pa.RecordBatch.from_pydict({c: t[c] for c in cols}, schema=batch.schema)

    return rows.mapInArrow(run, rows.schema).groupBy(key).agg(
        *[(F.sum(f"h{i + 1}") % p).alias(f"h{i + 1}") for i, p in enumerate(PRIMES)], F.sum("n").alias("n"))


def _numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text, row_id: the same ids in every scan, as they only depend on the input's splits."""
    return pick(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row_id"))


def _is_huge(text: str | None, huge: int) -> bool:
    return bool(text) and len(text) * 4 > huge and len(text.encode("utf-8", "surrogatepass")) > huge


def chunk_fingerprints(docs: DataFrame, huge: int = HUGE) -> DataFrame:
    """row_id, h1, h2, n of texts above `huge` bytes, whose chunks are hashed side by side."""
    @frugal
    def cut(it):
        for batch in it:
            for row, text in zip(batch.column("row_id").to_pylist(), batch.column("text").to_pylist()):
                data = normalised(text)
                for a in range(0, max(1, len(data)), 16 * CHUNK):
                    some = [data[k:k + CHUNK] for k in range(a, min(max(1, len(data)), a + 16 * CHUNK), CHUNK)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(some), pa.int64()),
                         pa.array(range(a // CHUNK, a // CHUNK + len(some)), pa.int64()), pa.array(some, pa.binary())],
                        names=["row_id", "chunk", "piece"])

    @frugal
    def hashed(it):
        for batch in it:
            marks = [(*chunk_hash(x), len(x)) for x in batch.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), batch.column("chunk"), *[pa.array([m[k] for m in marks], pa.int64()) for k in range(3)]],
                names=["row_id", "chunk", *MARK])

    pieces = (_numbered(docs).filter(F.octet_length("text") > huge)
              .mapInArrow(cut, "row_id long, chunk long, piece binary").repartition("row_id", "chunk"))
    return combine_fingerprints(pieces.mapInArrow(hashed, "row_id long, chunk long, h1 long, h2 long, n long"),
                                "row_id", "chunk")


def digests(docs: DataFrame, hashed=fingerprint, huge: int = HUGE) -> DataFrame:
    """doc_id, row_id, h1, h2, n (bytes) and text_sha256 of every row."""
    @frugal
    def run(it):
        for batch in it:
            out = [[], [], [], []]
            for text in batch.column("text").to_pylist():
                data = normalised(text)
                mark = (None, None, None) if _is_huge(text, huge) else hashed(data)
                for x, v in zip(out, (*mark, hashlib.sha256(data).hexdigest())):
                    x.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_id"), *[pa.array(x, pa.int64()) for x in out[:3]],
                 pa.array(out[3], pa.string())], names=["doc_id", "row_id", *MARK, "text_sha256"])

    rows = _numbered(docs).mapInArrow(run, "doc_id long, row_id long, h1 long, h2 long, n long, text_sha256 string")
    long = cut_lineage(chunk_fingerprints(docs, huge), "huge").select("row_id", *[F.col(c).alias(f"c_{c}") for c in MARK])
    return rows.join(long, "row_id", "left").select(
        "doc_id", "row_id", *[F.coalesce(c, f"c_{c}").cast("long").alias(c) for c in MARK], "text_sha256")


def _same(left: bytes, right: bytes) -> bool:
    """Chunk by chunk; stops at the first difference."""
    return len(left) == len(right) and all(
        left[i:i + CHUNK] == right[i:i + CHUNK] for i in range(0, len(left), CHUNK))


def _first() -> Column:
    """The row with the smallest doc_id, one without only among such."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row_id")).alias("first")


def _filter_place(h1, h2):
    """Bit of a fingerprint, for columns and arrays alike."""
    return (h1 * 40503 + h2) % FILTER_BITS


def repeated_filter(groups: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, set where a repeated fingerprint falls; built as bitmaps in Spark."""
    place = _filter_place(F.col("h1"), F.col("h2")) + 1        # buckets of bits are counted from 1
    maps = groups.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in maps.collect():                                   # at most FILTER_BITS / 8 bytes in all
        at = (r["part"] - 1) * len(r["bits"])
        out[at:at + len(r["bits"])] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out


def differing(docs: DataFrame, groups: DataFrame, hashed=fingerprint) -> DataFrame:
    """The fingerprints (h1, h2, n) under which not all texts are the same.

    groups: h1, h2, n, size.
    """
    seen = docs.sparkSession.sparkContext.broadcast(repeated_filter(groups))

    @frugal
    def prints(it):
        bits = seen.value
        for batch in it:
            bodies = list(map(normalised, batch.column("text").to_pylist()))
            marks = np.array([hashed(d) for d in bodies], dtype=np.int64).reshape(-1, 3)
            at = _filter_place(marks[:, 0], marks[:, 1])
            keep = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id").take(pa.array(keep)), *[pa.array(marks[keep, k]) for k in range(3)],
                 pa.array([bodies[k] for k in keep], pa.binary())], names=["row_id", *MARK, "body"])

    rows = (_numbered(docs).mapInArrow(prints, "row_id long, h1 long, h2 long, n long, body binary")
            .join(groups.select(*MARK, "size").hint("merge"), MARK))           # one plan at every size
    found = None
    while True:
        salts = F.ceil(F.col("size") / PER_SALT)
        met = (rows.withColumn("salt", F.pmod(F.xxhash64("row_id"), salts)).select(*MARK, "salt", "size", "row_id", "body")
               .repartition(*MARK, "salt").sortWithinPartitions(*MARK, "salt"))
        told = cut_lineage(met.mapInArrow(_compared, "row_id long, h1 long, h2 long, n long, size long, body binary"), "compared")
        bad = told.filter("body IS NULL").select(*MARK)
        found = bad if found is None else found.union(bad)
        rows = told.filter("body IS NOT NULL")
        if not any_row(rows):
            return found.distinct()


@frugal
def _compared(it):
    """Rows that differ from the first of their salt, without a body, and that first row where
    its fingerprint has more salts, with the number of them."""
    at, head = None, None
    for batch in it:
        out = []
        keys = zip(*[batch.column(c).to_pylist() for c in (*MARK, "salt", "size", "row_id")])
        for (*key, size, row), body in zip(keys, batch.column("body")):
            body = body.as_py()
            if key != at:
                at, head = key, body
                if size > PER_SALT:
                    out.append((row, *key[:3], -(-size // PER_SALT), body))
            elif not _same(head, body):
                out.append((row, *key[:3], size, None))
        if out:
            *ids, body = zip(*out)
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in ids], pa.array(body, pa.binary())],
                                             names=["row_id", *MARK, "size", "body"])


def exact_duplicates(docs: DataFrame, hashed=fingerprint, huge: int = HUGE) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    every = cut_lineage(digests(docs, hashed, huge), "digests")
    groups = every.groupBy(*MARK).agg(F.count("*").alias("size")).filter("size > 1")
    mixed = cut_lineage(differing(docs, cut_lineage(groups, "groups"), hashed), "mixed")
    if any_row(mixed):
        marked = every.join(mixed.withColumn("part", F.lit(True)), MARK, "left").withColumn(
            "part", F.when(F.col("part"), F.col("text_sha256")).otherwise(""))
    else:
        marked = every.withColumn("part", F.lit(""))
    kept = cut_lineage(marked.groupBy(*MARK, "part").agg(_first(), F.count("*").alias("group_size")), "kept")
    return marked.join(kept, [*MARK, "part"]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
        (F.col("row_id") == F.col("first.row_id")).alias("kept"), "text_sha256")


SQL = f"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{SPACE}+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)"""
