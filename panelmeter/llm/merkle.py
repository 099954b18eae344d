"""Merkle manifest of a table of documents, with levels kept as concatenated strings.

H is the lower-case hex SHA-256 of its inputs one after the other. A leaf is H of a row's
fields. The leaves of a source, by doc_id (null first, then equal ids by leaf), are cut
into aligned blocks of BLOCK nodes. A block keeps a level as one string of 64 signs a node,
so 1,024 signs are a run of 16 and `substring` cuts runs, parents and the flanks of a node
(its siblings left and right) without a row per digest. A block leaves one node to the
next round, in which the blocks of a source are nodes of larger blocks, and so on until
one is left: the subroot. Subroots, by source (null first, bytewise), go through the
same rounds to the root. Since blocks are aligned and a power of 16 wide, runs never
cross them.

On the way back each block gets the flanks above it, so a leaf's path is made where its
block is: proofs are hashed in place and no list of siblings is ever moved for a leaf.

A row moves twice, as its ids and digests without the text: to its place in the order
(by ranges of source and doc_id, so a hot source has many parts) and to its block. There
are log(rows) / log(BLOCK) rounds, each 1/BLOCK the size of the one before.

Null fields count as "-"; null texts stay null under tampering. Repeated rows are leaves of
their own. A table without rows has no leaves. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import bucket, cut_lineage, pick

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN, DIGEST = 16, 64
#: nodes of a block, a power of FAN; its lowest level is a string of 16 KB
LEVELS = 2
BLOCK = FAN ** LEVELS
#: every so many documents, by crc32 of the doc_id, is read as if it had been tampered with
TAMPERED = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def h(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_of(*fields: Column) -> Column:
    """H of the fields, each with its UTF-8 length before it."""
    shown = []
    for f in fields:
        value = f.cast("string")
        shown.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return h(*shown)


def leaves(docs: DataFrame, tampered: int = TAMPERED) -> DataFrame:
    """doc_id, source, leaf, and other: the leaf of the row as it is read later."""
    rows = pick(docs, *FIELDS).select(F.col("doc_id").cast("long"), "source", "lang", F.col("n_chars").cast("long"), "text")
    own = leaf_of(*[F.col(c) for c in FIELDS])
    changed = leaf_of(*[F.col(c) for c in FIELDS[:-1]], F.translate("text", UPPER, LOWER))
    return rows.select("doc_id", "source", own.alias("leaf"),
                       F.when(bucket(F.col("doc_id"), tampered) == 0, changed).alias("other")).select(
                           "doc_id", "source", "leaf", F.coalesce("other", "leaf").alias("other"))


def ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with at, the place of a row among those of its group (nulls are a group), from 0.

    Rows are dealt by ranges and sorted inside them, and written; a group's first place in
    a range is the number of its rows in the ranges before.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    dealt = cut_lineage(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
                        .withColumn("line", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("line", 33).alias("part")
    spans = dealt.groupBy(group, part).agg(F.min("line").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(group).orderBy("part")
    spans = spans.select(F.col(group).alias("_g"), F.col("part").alias("_p"), "first",
                         (F.sum("n").over(before) - F.col("n")).alias("before"))
    return (dealt.join(spans, dealt[group].eqNullSafe(spans["_g"]) & (F.shiftright("line", 33) == F.col("_p")))
            .withColumn("at", F.col("line") - F.col("first") + F.col("before")).drop("_g", "_p", "first", "before", "line"))


def parents(level: Column) -> Column:
    """The next level's string: H of every run."""
    run = FAN * DIGEST
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.length(level) - 1) / run).cast("int")),
                                    lambda k: F.sha2(F.substring(level, k * run + 1, F.lit(run)).cast("binary"), 256)), "")


def flanks(level: Column, place: Column) -> Column:
    """The siblings (left, right) of the node at a place of a level."""
    inside = F.pmod(place, F.lit(FAN)).cast("int")
    return F.struct(
        F.substring(level, ((place - inside) * DIGEST + 1).cast("int"), inside * DIGEST).alias("left"),
        F.substring(level, ((place + 1) * DIGEST + 1).cast("int"), (FAN - 1 - inside) * DIGEST).alias("right"))


def blocks(nodes: DataFrame, *kept: str) -> DataFrame:
    """grp, block, alone, rows, levels, top: the aligned blocks of nodes (grp, at, digest).

    alone: the block is its group's only one, which then ends when one node is left.
    """
    entry = F.struct("at", "digest", *kept)
    held = nodes.groupBy("grp", (F.col("at") / BLOCK).cast("long").alias("block"), "alone").agg(
        F.sort_array(F.collect_list(entry)).alias("rows"))
    held = held.withColumn("level0", F.array_join(F.col("rows.digest"), ""))
    for k in range(LEVELS):
        done = F.col("alone") & (F.length(f"level{k}") == DIGEST)
        held = held.withColumn(f"level{k + 1}", F.when(done, F.col(f"level{k}")).otherwise(parents(F.col(f"level{k}"))))
    kept_levels = F.filter(
        F.array(*[F.when(~(F.col("alone") & (F.length(f"level{k}") == DIGEST)), F.col(f"level{k}"))
                  for k in range(LEVELS)]), lambda x: x.isNotNull())
    return held.select("grp", "block", "alone", "rows", kept_levels.alias("levels"), F.col(f"level{LEVELS}").alias("top"))


def with_size(nodes: DataFrame) -> DataFrame:
    """nodes with alone: whether the group fits one block."""
    wide = nodes.filter(F.col("at") == BLOCK).select(F.col("grp").alias("_g"), F.lit(False).alias("_wide"))
    return nodes.join(wide, F.col("grp").eqNullSafe(F.col("_g")), "left").withColumn(
        "alone", F.col("_wide").isNull()).drop("_g", "_wide")


def inner_path(place: str) -> Column:
    """Flanks of a node in the levels of its block, lowest first."""
    return F.transform("levels", lambda level, k: flanks(
        level, F.floor(F.col(place) / F.pow(F.lit(FAN), k)).cast("int")))


def climbed(first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From the blocks of leaves: (grp, root), and (grp, block, above): flanks above each of them."""
    rounds = [first]
    while True:
        last = rounds[-1]
        up = last.filter(~F.col("alone")).select("grp", F.col("block").alias("at"), F.col("top").alias("digest"))
        if not up.limit(1).count():
            break
        rounds.append(cut_lineage(blocks(with_size(up)), "blocks"))
    roots = rounds[0].filter("alone").select("grp", F.col("top").alias("root"))
    for r in rounds[1:]:
        roots = roots.union(r.filter("alone").select("grp", F.col("top").alias("root")))
    empty = F.array().cast("array<struct<left:string,right:string>>")
    above = rounds[-1].select("grp", "block", empty.alias("above"))
    for k in range(len(rounds) - 1, 0, -1):
        held = rounds[k].join(above.withColumnsRenamed({"grp": "_g", "block": "_b"}),
                              F.col("grp").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b")))
        below = held.select("grp", F.posexplode("rows").alias("place", "row"), "levels", "above").select(
            "grp", F.col("row.at").alias("block"), F.concat(inner_path("place"), "above").alias("above"))
        own = rounds[k - 1].filter("alone").select("grp", "block", empty.alias("above"))
        above = cut_lineage(below.union(own), "above")
    return roots, above


def manifest(docs: DataFrame, tampered: int = TAMPERED) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    nodes = with_size(ranked(leaves(docs, tampered), "source", "doc_id", "leaf")
                      .withColumnsRenamed({"source": "grp", "leaf": "digest"}))
    first = cut_lineage(blocks(nodes, "doc_id", "other"), "blocks")
    roots, above = climbed(first)
    roots = cut_lineage(roots, "subroots")
    # the subroots are nodes of one group; a source is a row here, so they are ranked like rows
    tops = ranked(roots.select(F.lit(0).alias("grp"), F.col("grp").alias("source"), F.col("root").alias("digest")),
                  "grp", "source")
    crown = cut_lineage(blocks(with_size(tops), "source"), "blocks")
    root, over = climbed(crown)
    ends = (crown.join(over, ["grp", "block"])
            .select(F.posexplode("rows").alias("place", "row"), "levels", "above")
            .select(F.col("row.source").alias("_s"), F.col("row.digest").alias("subroot"),
                    F.concat(inner_path("place"), "above").alias("crown"))
            .crossJoin(F.broadcast(root.select("root"))))                # one row
    ends = cut_lineage(ends, "ends")
    placed = first.join(above.withColumnsRenamed({"grp": "_g", "block": "_b"}),
                        F.col("grp").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b"))).drop("_g", "_b")
    placed = placed.join(ends, F.col("grp").eqNullSafe(F.col("_s"))).withColumn("above", F.concat("above", "crown"))
    rows = placed.select(F.col("grp").alias("source"), F.posexplode("rows").alias("place", "row"), "levels", "above",
                         "subroot", "root")
    path = rows.select("source", F.col("row.doc_id").alias("doc_id"), F.col("row.digest").alias("leaf"), "subroot", "root",
                       F.col("row.other").alias("other"), F.concat(inner_path("place"), "above").alias("path"))
    fold = F.aggregate("path", F.col("other"), lambda node, p: h(p["left"], node, p["right"]))
    proof = h(F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), ""))
    return path.select("doc_id", "source", "leaf", "subroot", "root", proof.alias("proof_sha256"),
                       fold.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def crc_sql(text: str) -> str:
    """DuckDB: the unsigned crc32 of an ASCII text, bit by bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), "
            "lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)")


def _field(name: str, value: str | None = None) -> str:
    value = value or f"{name}::VARCHAR"
    return f"coalesce(strlen({value})::VARCHAR || ':' || {value}, '-')"


def _levels(name: str, first: str, levels: int) -> str:
    """DuckDB: <name>_path (g, i, root, lefts, rights): flanks of each node of `first` (g, i, d) by level."""
    out, at = [], first
    for k in range(levels):
        run = "PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN"
        out.append(f"""{name}_f{k} AS (
  SELECT *, coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {at}))""")
        out.append(f"""{name}_{k + 1} AS (
  SELECT g, i // 16 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END AS d
  FROM {name}_f{k} GROUP BY ALL)""")
        at = f"{name}_{k + 1}"
    joins = " ".join(f"JOIN {name}_f{k} f{k} ON f{k}.g = f0.g AND f{k}.i = f0.i // {16 ** k}" for k in range(1, levels))
    pairs = ", ".join(f"CASE WHEN f{k}.n > 1 THEN {{'l': f{k}.l, 'r': f{k}.r}} END" for k in range(levels))
    out.append(f"""{name}_path AS (
  SELECT f0.g, f0.i, t.d AS root, list_filter([{pairs}], lambda x: x IS NOT NULL) AS path
  FROM {name}_f0 f0 {joins} JOIN {at} t ON t.g = f0.g)""")
    return ",\n".join(out)


_OWN = " || ".join(_field(c) for c in FIELDS)
_OTHER = " || ".join([_field(c) for c in FIELDS[:-1]] + [_field("text", f"translate(text, '{UPPER}', '{LOWER}')")])
#: sources of up to 16^6 rows, 16^3 sources
SQL = f"""
WITH hashed AS (
  SELECT doc_id, source, sha256({_OWN}) AS leaf,
         CASE WHEN {crc_sql("coalesce(doc_id::VARCHAR, '')")} % {TAMPERED} = 0 THEN sha256({_OTHER}) END AS other
  FROM documents),
leaf_0 AS (
  SELECT *, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS g, leaf AS d,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM hashed),
{_levels("leaf", "leaf_0", 6)},
top_0 AS (SELECT DISTINCT 0 AS g, g AS i, root AS d FROM leaf_path),
{_levels("top", "top_0", 3)},
paths AS (
  SELECT n.doc_id, n.source, n.leaf, coalesce(n.other, n.leaf) AS other, p.root AS subroot, t.root, list_concat(p.path, t.path) AS path
  FROM leaf_0 n JOIN leaf_path p USING (g, i) JOIN top_path t ON t.i = n.g),
folded AS (
  SELECT *, list_reduce(list_prepend({{'l': other, 'r': ''}}, path), lambda a, p: {{'l': sha256(p.l || a.l || p.r), 'r': ''}}).l AS folded_root
  FROM paths)
SELECT doc_id, source, leaf, subroot, root,
       sha256(list_aggregate(list_prepend('', list_transform(path, lambda p: p.l || p.r)), 'string_agg', '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM folded"""
