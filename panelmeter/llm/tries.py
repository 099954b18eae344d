"""Prefix trie of conversations, with subtree totals by time-forward processing.

A node is a distinct sequence of first turns. It is known by two 64-bit sums of mixed
(turn, place) hashes, so the sums of a prefix come from running sums and no path is ever
built; its smallest member and depth name it in the result.

Subtree totals flow from the deepest level up. Nodes are sorted by reverse level order; a
node takes the messages that wait for it in a priority queue ordered the same way, and
sends its totals to its parent through it. A queue that grows beyond QUEUE_ROOM messages
writes sorted runs to the shared folder and merges them as it is read, so memory is bounded.

Shards are sets of whole subtrees of bounded size. A node whose members have more than
`limit` turns left (the larger of LEAST_SHARD and 1/SHARDS of all turns) is heavy, the
others are light: a light node below a heavy one, a shard root, has at most `limit` nodes
under it, however hot its turns are. Light subtrees are dealt to tasks by their root's hash
and totalled there; what the shard roots send is added up by parent, and one ordered pass
over the heavy nodes, at most SHARDS on a level, carries it to the root.

Turns of a conversation are ordered by turn (null first), equal ones by a digest of role
and text. Null roles and texts are empty ones. Rows without conv_id belong to no
conversation and are left out; remainders of negative ids have their sign. A table
without conversations has no nodes. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merkle import crc_sql
from .tables import bucket, cut_lineage, pick, shared_folder
from .tokens import _store
from .words import frugal

#: conversations c - c % FAMILY ... share the beginning of the first of them
FAMILY = 5
#: at most this many turns less one are shared
SHARED = 9
SHARDS = 1 << 16
LEAST_SHARD = 2048
QUEUE_ROOM = 1 << 20
CHUNK = 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()
U = np.uint64


def running(rows: DataFrame, group: str, order: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """rows with place (from 1) in their group and, for each of sums, the sum modulo 2^64 up to
    the row (all_<s>) and before it (pre_<s>). group and sums are longs without nulls.

    Rows are dealt by ranges of (group, order) and summed inside them; only the last group of
    a range reaches into the next one, so one row for each range is carried over.
    """
    keys = [F.col(group), *[F.col(c).asc_nulls_first() for c in order]]
    names, sums = rows.columns, list(sums)
    extra = ["place", *[f"all_{s}" for s in sums]]

    @frugal
    def local(it):
        part, line, last, carried = TaskContext.get().partitionId(), 0, None, None
        for batch in it:
            if not batch.num_rows:
                continue
            own = batch.column(names.index(group)).to_numpy()
            values = np.stack([np.ones(len(own), U)] + [batch.column(names.index(s)).to_numpy().view(U) for s in sums])
            total = np.cumsum(values, axis=1, dtype=U)
            first = np.append(True, own[1:] != own[:-1])
            begin = np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))
            total -= np.where(begin > 0, total[:, begin - 1], U(0))
            if last == own[0]:
                total[:, begin == 0] += carried[:, None]
            last, carried = own[-1], total[:, -1].copy()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(t.view(np.int64)) for t in total],
                 pa.array(np.full(len(own), part)), pa.array(np.arange(line, line + len(own)))],
                names=[*names, *extra, "part", "line"])
            line += len(own)

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    longs = ", ".join(f"{c} long" for c in [*extra, "part", "line"])
    dealt = cut_lineage(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
                        .mapInArrow(local, f"{kinds}, {longs}"), "running")
    ranges = (dealt.groupBy("part").agg(F.min(group).alias("low"), F.max_by(F.struct(group, *extra), "line").alias("end"))
              .orderBy("part").collect())                     # one row a range
    held, carry = None, {}
    for r in ranges:
        add = held[1] if held and held[0] == r["low"] else None
        if add is not None:
            carry[r["part"]] = held
        end = np.array([int(r["end"][c]) for c in extra], np.int64).view(U)
        held = (r["end"][group], end + add if add is not None and r["end"][group] == r["low"] else end)

    def whole(it):
        for batch in it:
            total = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in extra]).view(U)
            own, part = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in (group, "part"))
            for p in np.unique(part):
                if p in carry:
                    rest, add = carry[p]
                    total[:, (part == p) & (own == rest)] += add[:, None]
            before = [pa.array((t - batch.column(batch.schema.get_field_index(s)).to_numpy().view(U)).view(np.int64))
                      for s, t in zip(sums, total[1:])]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(c)) for c in names], *[pa.array(t.view(np.int64)) for t in total],
                 *before], names=[*names, *extra, *[f"pre_{s}" for s in sums]])

    return dealt.mapInArrow(whole, ", ".join([kinds, *[f"{c} long" for c in [*extra, *[f"pre_{s}" for s in sums]]]]))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, len, size (bytes of the text) and p1, p2 (hashes of the turn at its place)
    of every turn of the rebuilt conversations, with a row of depth 0 for each of them."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    own = (pick(conversations, "conv_id", "turn", "role", "text")
           .select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"))
           .filter("conv_id IS NOT NULL")
           .select("conv_id", "turn", F.xxhash64(F.lit(1), "role", "text").alias("h1"),
                   F.xxhash64(F.lit(2), "text", "role").alias("h2"), F.octet_length("text").cast("long").alias("size")))
    placed = cut_lineage(running(own, "conv_id", ["turn", "h1", "h2"], []), "placed")
    counts = cut_lineage(placed.groupBy("conv_id").agg(F.count("*").alias("n")), "counts")
    base = (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")
    convs = (counts.select("conv_id", "n", base, bucket(F.col("conv_id"), SHARED).alias("h"))
             .join(counts.select(F.col("conv_id").alias("base"), F.col("n").alias("has")), "base", "left")
             .select("conv_id", "base", "h", "n", F.least("h", F.coalesce("has", F.lit(0))).alias("keep"))
             .withColumn("len", F.col("keep") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).drop("n"))
    convs = cut_lineage(convs, "convs")
    rest = placed.join(convs, "conv_id").filter("place > h").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("keep")).alias("depth"), "len", "size", "h1", "h2")
    begun = (placed.filter((F.col("conv_id") % FAMILY == 0) & (F.col("place") < SHARED))
             .withColumnRenamed("conv_id", "base").join(convs, "base").filter("place <= keep")
             .select("conv_id", F.col("place").alias("depth"), "len", "size", "h1", "h2"))
    zero = F.lit(0).cast("long")
    tops = convs.select("conv_id", zero.alias("depth"), "len", zero.alias("size"), zero.alias("p1"), zero.alias("p2"))
    return rest.union(begun).select(
        "conv_id", "depth", "len", "size", F.xxhash64("h1", "depth").alias("p1"),
        F.xxhash64(F.lit(3), "h2", "depth").alias("p2")).union(tops)


class Queue:
    """Smallest tuple of longs first; beyond `room` of them sorted runs go to the shared folder."""

    def __init__(self, width: int, folder: str, room: int = QUEUE_ROOM):
        self.heap, self.room, self.width, self.folder = [], room, width, folder
        self.runs, self.files = [], []

    def push(self, item: tuple[int, ...]):
        if len(self.heap) >= self.room + len(self.runs):
            self._spill()
        heapq.heappush(self.heap, (item, -1))

    def _spill(self):
        own = sorted(x for x, run in self.heap if run < 0)
        store, root = _store(self.folder)
        store.create_dir(root, recursive=True)
        path = f"{root}/{uuid.uuid4().hex}"
        with store.open_output_stream(path) as f:
            for k in range(0, len(own), 10_000):
                f.write(np.array(own[k:k + 10_000], "<i8").tobytes())
        self.files.append((store, path))
        self.heap = [x for x in self.heap if x[1] >= 0]
        heapq.heapify(self.heap)
        self.runs.append(self._read(store, path))
        self._next(len(self.runs) - 1)

    def _read(self, store, path):
        with store.open_input_stream(path) as f:
            while data := f.read(80_000 * self.width):
                yield from map(tuple, np.frombuffer(data, "<i8").reshape(-1, self.width).tolist())

    def _next(self, run: int):
        item = next(self.runs[run], None)
        if item is not None:
            heapq.heappush(self.heap, (item, run))

    def head(self) -> tuple[int, ...] | None:
        return self.heap[0][0] if self.heap else None

    def pop(self) -> tuple[int, ...]:
        item, run = heapq.heappop(self.heap)
        if run >= 0:
            self._next(run)
        return item

    def close(self):
        for store, path in self.files:
            store.delete_file(path)


TOTALS = ["n_children", "n_leaves", "saved_tokens"]
SENT = "conv_id long, depth long, parent long, n_children long, n_leaves long, saved_tokens long"


def forward(nodes: DataFrame, folder: str, room: int = QUEUE_ROOM) -> DataFrame:
    """conv_id, depth, parent and the totals of nodes, whose partitions hold whole trees.

    nodes: conv_id, depth, parent, own (its own saving), top (its parent is elsewhere) and
    the totals that have reached it from elsewhere.
    """
    @frugal
    def run(it):
        queue = Queue(4, folder, room)
        try:
            for batch in it:
                out = []
                cols = [batch.column(batch.schema.get_field_index(c)).to_pylist()
                        for c in ("conv_id", "depth", "parent", "own", "top", *TOTALS)]
                for conv, depth, parent, own, top, children, leaves, saved in zip(*cols):
                    while (head := queue.head()) and head[0] == -depth and head[1] == conv:
                        _, _, more, less = queue.pop()
                        children, leaves, saved = children + 1, leaves + more, saved + less
                    leaves, saved = leaves or 1, saved + own
                    out.append((conv, depth, parent, children, leaves, saved))
                    if not top:
                        queue.push((1 - depth, parent, leaves, saved))
                if queue.head() and out and queue.head()[0] < -out[-1][1]:
                    raise RuntimeError("a node's parent is not in its shard")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 6,
                    names=["conv_id", "depth", "parent", *TOTALS])
        finally:
            queue.close()

    return nodes.sortWithinPartitions(F.col("depth").desc(), "conv_id").mapInArrow(run, SENT)


def endings(ends: DataFrame) -> DataFrame:
    """e1, e2, ends_sha256: SHA-256 of the ascending conv_ids, comma-joined, that end in each node.

    Ids are dealt by ranges and joined to chunks there; a node's chunks then pass through
    one hash in order, which keeps nothing but its state.
    """
    @frugal
    def joined(it):
        for batch in it:
            keys = [batch.column(k).to_numpy() for k in range(2)]
            ids = batch.column(2).to_pylist()
            new = (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(ids)] if ids else [0]
            spans = [(k, min(k + CHUNK // 8, b)) for a, b in zip(cuts, cuts[1:]) for k in range(a, b, CHUNK // 8)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(c[a]) for a, _ in spans], pa.int64()) for c in keys]
                + [pa.array([ids[a] for a, _ in spans], pa.int64()),
                   pa.array([",".join(map(str, ids[a:b])) for a, b in spans], pa.string())],
                names=["e1", "e2", "first", "ids"])

    @frugal
    def hashed(it):
        at, state, done = None, None, []
        for batch in it:
            for e1, e2, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if at == (e1, e2):
                    state.update(b",")
                else:
                    if at is not None:
                        done.append((*at, state.hexdigest()))
                    at, state = (e1, e2), hashlib.sha256()
                state.update(ids.encode())
            if len(done) > 5000:
                yield shown(done)
                done = []
        if at is not None:
            yield shown([*done, (*at, state.hexdigest())])

    def shown(rows):
        a, b, c = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())],
                                          names=["e1", "e2", "ends_sha256"])

    keys = ["e1", "e2", "conv_id"]
    chunks = (ends.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
              .mapInArrow(joined, "e1 long, e2 long, first long, ids string"))
    return (chunks.repartition("e1", "e2").sortWithinPartitions("e1", "e2", "first")
            .mapInArrow(hashed, "e1 long, e2 long, ends_sha256 string"))


def trie(conversations: DataFrame, shards: int = SHARDS, least_shard: int = LEAST_SHARD,
         room: int = QUEUE_ROOM) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    folder = f"{shared_folder(spark)}/panelmeter/queue-{uuid.uuid4().hex}"
    key = ["depth", "all_p1", "all_p2"]
    paths = cut_lineage(running(rebuilt(conversations), "conv_id", ["depth"], ["p1", "p2"]).drop("place", "p1", "p2"), "paths")
    nodes = cut_lineage(paths.groupBy(*key, "pre_p1", "pre_p2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("size"),
        F.sum(F.col("len") - F.col("depth") + 1).alias("below")), "nodes")
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("all_p1").alias("pre_p1"),
                      F.col("all_p2").alias("pre_p2"), F.col("conv_id").alias("parent"))
    whole = nodes.filter("depth = 0").select("below").first()
    limit = max(least_shard, (whole["below"] if whole else 0) // shards)
    heavy = cut_lineage(nodes.filter(F.col("below") > limit).select(*key), "heavy")
    # the first light node on each conversation's path is the root of its shard
    roots = (paths.join(heavy, key, "left_anti").groupBy("conv_id")
             .agg(F.min(F.struct("depth", "all_p1", "all_p2")).alias("root")))
    zeros = [F.lit(0).cast("long").alias(c) for c in TOTALS]
    named = cut_lineage(
        nodes.join(up, ["depth", "pre_p1", "pre_p2"], "left").join(roots, "conv_id", "left").select(
            "conv_id", "depth", "parent", "n_convs", "all_p1", "all_p2", "below",
            ((F.col("n_convs") - 1) * F.col("size")).alias("own"),
            F.col("root.all_p1").alias("shard"), (F.col("root.depth") == F.col("depth")).alias("is_root")), "named")
    light = (named.filter(F.col("below") <= limit)
             .select("conv_id", "depth", "parent", "own", (F.col("is_root") | F.col("parent").isNull()).alias("top"),
                     *zeros, "shard").repartition("shard"))
    summed = cut_lineage(forward(light, folder, room), "light")
    sent = (summed.join(named.filter("is_root").select("conv_id", "depth"), ["conv_id", "depth"])
            .groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
            .agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
                 F.sum("saved_tokens").alias("saved_tokens")))
    above = (named.filter(F.col("below") > limit).join(sent, ["conv_id", "depth"], "left")
             .select("conv_id", "depth", "parent", "own", F.col("parent").isNull().alias("top"),
                     *[F.coalesce(c, F.lit(0)).alias(c) for c in TOTALS]))
    totals = summed.union(forward(above.repartition(1), folder, room)).drop("parent")
    ended = endings(paths.filter("depth = len").select(
        F.col("all_p1").alias("e1"), F.col("all_p2").alias("e2"), "conv_id"))
    return (named.join(totals, ["conv_id", "depth"])
            .join(ended, (F.col("all_p1") == F.col("e1")) & (F.col("all_p2") == F.col("e2")), "left")
            .select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", *TOTALS,
                    F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")))


SQL = f"""
WITH placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place,
         {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said
  FROM conversations WHERE conv_id IS NOT NULL),
whole AS (SELECT conv_id, list(said ORDER BY place) AS said FROM placed GROUP BY conv_id),
built AS (
  SELECT w.conv_id, list_concat(coalesce(b.said, [])[:w.h], w.said[w.h + 1:]) AS said
  FROM (SELECT *, {crc_sql('conv_id::VARCHAR')} % {SHARED} AS h FROM whole) w
  LEFT JOIN whole b ON b.conv_id = w.conv_id - w.conv_id % {FAMILY}),
steps AS (
  SELECT conv_id, d AS depth, said[:d] AS path, len(said) = d AS ends,
         CASE WHEN d > 0 THEN strlen(said[d].text) ELSE 0 END AS size
  FROM (SELECT *, unnest(range(len(said) + 1)) AS d FROM built)),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM steps GROUP BY path, depth),
kids AS (SELECT path[:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
valued AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children, (n_convs - 1) * size AS own FROM nodes n LEFT JOIN kids k USING (path)),
totals AS (
  SELECT path[:a] AS path, sum((n_children = 0)::BIGINT) AS n_leaves, sum(own) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS a FROM valued) GROUP BY 1)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children,
       t.n_leaves::BIGINT AS n_leaves, t.saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM valued v JOIN totals t USING (path) LEFT JOIN nodes p ON v.depth > 0 AND p.path = v.path[:v.depth - 1]"""
