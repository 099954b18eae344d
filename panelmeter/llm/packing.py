"""Packing of token documents into sequences of fixed capacity, by large-item matching.

A document is its ids and an end id. One longer than the capacity is cut into full
pieces and one shorter first piece; nothing else is cut. Pieces above a third of the
capacity meet at most twice in a sequence, so they are a matching: the longest takes the
longest partner that still fits, which gives as many pairs as any matching. The others,
longest first, go where the least room is left.

Only lengths matter to that, and there are no more of them than the capacity. Spark
counts the pieces of each length; `plan` packs counts instead of pieces, in steps like
"ranks 700 to 899 of length 512 lie four to a sequence in the sequences from 31 on"; and
every piece finds its place by its rank among those of its length. A step fills up or
uses up whole groups of equal sequences, so the plan's size is bounded by the capacity
(under 200,000 steps for 2,048) whatever the number of pieces; it is all the driver holds.
Ranks come from a counter per length in each task and prefix sums of the tasks' counts,
so a length that a third of all pieces have is no group of its own anywhere.

Null and empty texts hold the end id alone. Rows with the same doc_id, or none, are
documents of their own; a table without rows packs into none. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byteids import ByteIds
from .tables import cut_lineage, pick
from .words import batches, frugal

CAPACITY = 2048
END = 0


def vocabulary_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, first rank, pieces in a sequence, sequences, first sequence, offset)."""
    left = {length: n for length, n in counts.items() if n > 0}
    handed: dict[int, int] = defaultdict(int)
    steps, opened = [], 0
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)   # gap: (first sequence, sequences)
    gaps: list[int] = []

    def put(length, copies, sequences, first, offset):
        steps.append((length, handed[length], copies, sequences, first, offset))
        handed[length] += copies * sequences
        left[length] -= copies * sequences

    def leave(gap, first, sequences):
        if gap and sequences:
            if not room[gap]:
                insort(gaps, gap)
            room[gap].append((first, sequences))

    large = sorted(length for length in left if 3 * length > capacity)
    while large:
        length = large[-1]
        others = bisect_right(large, capacity - length)
        if others == len(large) and left[length] == 1:       # not with itself
            others -= 1
        partner = large[others - 1] if others else None
        if partner == length:
            n = left[length] // 2
            put(length, 2, n, opened, 0)
        elif partner:
            n = min(left[length], left[partner])
            put(length, 1, n, opened, 0)
            put(partner, 1, n, opened, length)
        else:
            n = left[length]
            put(length, 1, n, opened, 0)
        leave(capacity - length - (partner or 0), opened, n)
        opened += n
        large = [x for x in large if left[x]]

    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(gaps, length)
            if at == len(gaps):                               # no gap is wide enough
                gap, first, n = capacity, opened, -(-left[length] // (capacity // length))
                opened += n
            else:
                gap = gaps[at]
                first, n = room[gap].pop()
                if not room[gap]:
                    gaps.pop(at)
            copies = gap // length
            full = min(n, left[length] // copies)
            if full:
                put(length, copies, full, first, capacity - gap)
                leave(gap - copies * length, first, full)
            if full < n:
                rest = left[length]
                if rest:
                    put(length, rest, 1, first + full, capacity - gap)
                    leave(gap - rest * length, first + full, 1)
                leave(gap, first + full + bool(rest), n - full - bool(rest))
    return steps


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END,
           with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 [, ids: little-endian unsigned 32-bit] of every piece,
    with part, the task that cut it, and turn, its place among that task's pieces of its length."""
    path = vocabulary or vocabulary_file()
    last = np.array([end], dtype="<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "turn"] + ["ids"] * with_ids

    @frugal
    def run(it):
        encoder, part = ByteIds(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in it:
            for a, b in batches(batch.column("text")):
                of, piece, start, length, crc, ids = [], [], [], [], [], []
                texts = [t or "" for t in batch.column("text").slice(a, b - a).to_pylist()]
                for row, found in enumerate(encoder.encode(texts)):
                    found += last
                    n = len(found) // 4
                    for k in range(-(-n // capacity)):
                        low = max(0, n - capacity * (-(-n // capacity) - k))
                        high = n - capacity * (-(-n // capacity) - k - 1)
                        own = memoryview(found)[4 * low:4 * high]
                        of.append(a + row)
                        piece.append(k)
                        start.append(low)
                        length.append(high - low)
                        crc.append(zlib.crc32(own))
                        if with_ids:
                            ids.append(bytes(own))
                size = np.array(length, dtype=np.int64)
                order = np.argsort(size, kind="stable")
                first = np.searchsorted(size[order], size[order])
                turn = np.empty(len(size), dtype=np.int64)
                turn[order] = seen[size[order]] + np.arange(len(size)) - first
                seen += np.bincount(size, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(of)), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(size), pa.array(crc, pa.int64()),
                     pa.array(np.full(len(size), part)), pa.array(turn)] + [pa.array(ids, pa.binary())] * with_ids,
                    names=names)

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, turn long"
             + (", ids binary" if with_ids else ""))


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END,
         with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset [, ids] of every piece of docs."""
    cut = cut_lineage(pieces(docs, vocabulary, capacity, end, with_ids), "pieces")
    by_task = cut_lineage(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = by_task.select("part", "length", (F.sum("n").over(
        Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    steps = sorted(plan(counts, capacity)) or [(0, 0, 1, 0, 0, 0)]
    length, rank, copies, _, first, offset = (np.array(c, dtype=np.int64) for c in zip(*steps))
    key = (length << 42) + rank                               # up to 4 * 10^12 pieces of a length
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(it):
        for batch in it:
            own = batch.column("length").to_numpy()
            place = batch.column("before").to_numpy() + batch.column("turn").to_numpy()
            at = np.searchsorted(key, (own << 42) + place, "right") - 1
            place = place - rank[at]
            found = {"sequence_id": pa.array(first[at] + place // copies[at]),
                     "offset": pa.array(offset[at] + place % copies[at] * own)}
            yield pa.RecordBatch.from_arrays([found[c] if c in found else batch.column(c) for c in names], names=names)

    return cut.join(before, ["part", "length"]).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
             + (", ids binary" if with_ids else ""))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, n_tokens, starts of its pieces: the packed sequences of pack(with_ids=True).

    A group is one sequence, so it holds no more ids than the capacity.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(b""), lambda all_, x: F.concat(all_, x["ids"])).alias("ids"),
        F.aggregate("p", F.lit(0), lambda n, x: n + F.octet_length(x["ids"]).cast("int")).alias("n_bytes"),
        F.col("p.offset").alias("starts")).select(
            "sequence_id", "ids", (F.col("n_bytes") / 4).cast("long").alias("n_tokens"), "starts")
