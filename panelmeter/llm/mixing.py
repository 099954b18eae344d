"""Mix sources to target weights by Sainte-Laguë apportionment of equal blocks of words.

1. Targets. Sources share `share` of all words by weight; a source gets at most
   `most` times its own words and the excess is shared again by weight. The fixed
   point is min(cap, weight x level); with sources ordered by cap / weight, the
   level is the first remaining amount over remaining weight that caps no more.
2. Seats. A source's documents are dealt by a seeded hash to shards of about
   SHARD_WORDS words and shards to racks. Blocks of BLOCK_WORDS words are seats:
   they go to sources by the highest quotients target / (2 k + 1), a source's
   seats to its racks and a rack's to its shards by words in the same way, each
   unit having at most `most` seats per block it holds. Every window of this
   hierarchy covers the units of one parent.
3. Blocks. A shard's documents stand in seeded order as one run of words, cut into
   blocks. Every block is taken floor(seats / blocks) times, and the remaining
   seats take blocks spread evenly from a seeded start. A document's words follow
   from running counts at its first and last word.

All of it is DataFrame operations. Rows with null text have size 0; a null source
is a source of its own and comes last; a row without doc_id counts and is dealt
like any other; rows that repeat a doc_id are told apart by their text. Without
any word every target and every taken count is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import SPACE, any_row, at, cut_lineage, pick, shielded

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)          # 150 percent, as a fraction
MOST = 2
BLOCK_WORDS = 16
SHARD_WORDS = 32768
RACK_SHARDS = 1024
SEED = "mix-1"
WORD = SPACE.replace("[", "[^", 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"{WORD}+")), F.lit(0)).cast("long")


def draw(*parts: Column | str) -> Column:
    """A 60-bit number from a text of the seed and the parts, the same in any engine with md5."""
    text = F.concat_ws("|", F.lit(SEED), *[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(totals: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """(source, source_size, place, target) from (source, source_size), one row per source."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = totals.withColumn("place", place).withColumn("weight", weight).withColumn(
        "cap", F.col("source_size") * most)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = F.sum("source_size").over(every) * share[0] / F.lit(float(share[1]))
    rows = rows.withColumn("level", (whole - F.coalesce(F.sum("cap").over(before), F.lit(0)))
                           / (F.sum("weight").over(every)
                              - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    open_ = F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level"))
    rows = rows.withColumn("level", F.min_by(open_, F.when(open_.isNotNull(), F.struct(
        F.col("cap") / F.col("weight"), F.col("place")))).over(every))
    reach = F.col("level") * F.col("weight")
    return rows.select("source", "source_size", "place", F.when(
        F.col("level").isNull() | (F.col("cap") <= reach), F.col("cap").cast("double"))
        .otherwise(reach).alias("target"))


def apportion(units: DataFrame, parent: list[str], key: str, votes: str, seats: str, cap: str) -> DataFrame:
    """units with a column `got`: the parent's seats dealt by the highest quotients.

    A unit's k-th seat (from 0) has the quotient votes / (2 k + 1); seats beyond its
    cap do not stand. Ties go to the smaller key. Rounding votes / d for the divisor
    d gives a first try; only the quotients around it are listed and ranked, the seats
    below are given at once. Where the limit falls outside of what a unit lists, the
    listing is widened and done again, so the result is that of ranking all quotients.
    """
    whole = Window.partitionBy(*parent)
    rows = units.withColumn("_n", F.least(F.col(seats), F.sum(cap).over(whole)))
    full = F.sum(votes).over(whole)
    rows = rows.withColumn("_try", F.least(F.col(cap), F.when(
        full > 0, F.floor(F.col(votes) / full * F.col("_n") + 0.5)).otherwise(0)))
    short = F.abs(F.col("_n") - F.sum("_try").over(whole)) + F.count("*").over(whole)
    room = F.sum(F.when(F.col("_try") < F.col(cap), F.col(votes)).otherwise(0)).over(whole)
    rows = cut_lineage(rows.withColumn("_margin", F.ceil(F.when(room > 0, F.least(
        short * F.col(votes) / room, short.cast("double"))).otherwise(0.0)) + 2), "units")
    order = (F.col(votes) / (2 * F.col("_k") + 1)).desc()
    wide = 1
    while True:
        low = F.greatest(F.col("_try") - wide * F.col("_margin"), F.lit(0)).cast("long")
        high = F.least(F.col("_try") + wide * F.col("_margin"), F.col(cap)).cast("long")
        tried = rows.withColumn("_low", low).withColumn("_high", high).withColumn(
            "_left", F.col("_n") - F.sum("_low").over(whole))
        near = tried.filter("_high > _low").select(*parent, key, votes, "_left", F.explode(
            F.sequence(F.col("_low"), F.col("_high") - 1)).alias("_k"))
        won = near.withColumn("_rank", F.row_number().over(whole.orderBy(order, key, "_k"))).filter(
            "_rank <= _left").groupBy(*parent, key).agg(F.count("*").alias("_won"))
        out = cut_lineage(tried.join(won, [*parent, key], "left").withColumn(
            "got", (F.col("_low") + F.coalesce("_won", F.lit(0))).cast("long")), "seats")
        edge = out.filter(((F.col("got") == F.col("_low")) & (F.col("_low") > 0))
                          | ((F.col("got") == F.col("_high")) & (F.col("_high") < F.col(cap))))
        if not any_row(edge):
            return out.select(*units.columns, "got")
        wide *= 8


def _ceil_div(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / b).cast("long")


def place_documents(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST,
                    block: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, place (of its source), size, source_size, target,
    base and the running counts that place it in its shard: start, blocks, extra, turn."""
    sized = cut_lineage(pick(docs, "doc_id", "source", "text").select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"),
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest")), "sized")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = cut_lineage(targets(totals, weights, share, most), "targets")

    dealt = sized.join(goal, sized["source"].eqNullSafe(goal["source"])).drop("source")
    shards = F.greatest(_ceil_div(F.col("source_size"), SHARD_WORDS), F.lit(1))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("?"), "digest"))
    dealt = cut_lineage(dealt.withColumn("shard", draw("shard", name) % shards).withColumn(
        "rack", F.floor(F.col("shard") / RACK_SHARDS)).withColumn("turn_at", draw("order", name)), "dealt")

    units = dealt.groupBy("place", "rack", "shard").agg(F.sum("size").alias("words")).withColumn(
        "blocks", _ceil_div(F.col("words"), block)).withColumn("cap", F.col("blocks") * most)
    units = cut_lineage(units, "shards")
    racks = units.groupBy("place", "rack").agg(F.sum("words").alias("words"), F.sum("cap").alias("cap"))
    all_seats = F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long")
    tops = racks.groupBy("place").agg(F.sum("cap").alias("cap")).join(
        goal.select("place", "target"), "place").withColumn("seats", all_seats)
    tops = apportion(tops, [], "place", "target", "seats", "cap")
    racks = racks.join(tops.select("place", F.col("got").alias("seats")), "place")
    racks = apportion(racks, ["place"], "rack", "words", "seats", "cap")
    units = units.join(racks.select("place", "rack", F.col("got").alias("seats")), ["place", "rack"])
    units = apportion(units, ["place", "rack"], "shard", "words", "seats", "cap").select("place", "shard", "blocks", "got")

    run = Window.partitionBy("place", "shard").orderBy("turn_at", "doc_id", "digest").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("start", F.sum("size").over(run) - F.col("size"))
    return placed.join(units, ["place", "shard"]).select(
        "doc_id", "place", "shard", "size", "source_size", "target", "digest", "start", "blocks",
        F.when(F.col("blocks") > 0, F.floor(F.col("got") / F.col("blocks"))).otherwise(0).alias("base"),
        F.when(F.col("blocks") > 0, F.col("got") % F.col("blocks")).otherwise(0).alias("extra"),
        F.when(F.col("blocks") > 0, draw("start", F.col("place").cast("string"), F.col("shard").cast("string"))
               % F.col("blocks")).otherwise(0).alias("turn"))


def chosen_before(block_no: Column) -> Column:
    """How many of a shard's first blocks the remaining seats take."""
    return F.when(F.col("blocks") > 0, F.floor(
        (block_no * F.col("extra") + F.col("turn")) / F.col("blocks"))).otherwise(0).cast("long")


def taken_before(word_no: Column, block: int = BLOCK_WORDS) -> Column:
    """How many of a shard's first words the remaining seats take."""
    no = F.floor(word_no / block)
    picked = chosen_before(no + 1) - chosen_before(no)
    return chosen_before(no) * block + (word_no - no * block) * picked


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target (of the source), taken (words the mix takes)."""
    start, end = F.col("start"), F.col("start") + F.col("size")
    return place_documents(docs, **how).select(
        "doc_id", "size", "source_size", "target",
        (F.col("base") * F.col("size") + taken_before(end) - taken_before(start)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself with the columns of docs: a row per pass over a document's taken words.

    Pass p holds the words whose block is taken p times or more, with the white
    space after each; n_chars, where docs has it, is counted again. A text taken
    whole is unchanged. Documents of which no word is taken have no row.
    """
    plan = place_documents(docs, **how).filter("size > 0")
    first, end = F.col("start"), F.col("start") + F.col("size")
    plan = plan.withColumn("picked", (taken_before(end) - taken_before(first)).cast("long")).withColumn(
        "passes", F.col("base") + (F.col("picked") > 0).cast("long"))
    again = Window.partitionBy("doc_id", "digest").orderBy("start", "shard")
    plan = cut_lineage(plan.select(
        F.col("doc_id").alias("_id"), "digest", "start", "size", "blocks", "base", "extra", "turn",
        "picked", "passes", F.row_number().over(again).alias("copy")), "plan")
    safe, text, own = shielded(docs), at(docs, "text"), at(docs, "doc_id")
    keyed = safe.withColumn("_digest", F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    match = (F.col("_digest") == F.col("digest")) & keyed[own].cast("long").eqNullSafe(F.col("_id"))
    if any_row(plan.filter("copy > 1")):       # rows that repeat both id and text
        keyed = keyed.withColumn("_copy", F.row_number().over(
            Window.partitionBy(own, "_digest").orderBy(own)))
        match = match & (F.col("_copy") == F.col("copy"))
    rows = keyed.join(plan.filter("passes > 0"), match)
    rows = rows.withColumn("_pass", F.explode(F.sequence(F.lit(1), F.col("passes").cast("int"))))
    whole = (F.col("_pass") <= F.col("base")) | (F.col("picked") == F.col("size"))
    parts = F.regexp_extract_all(text, F.lit(f"{WORD}+{SPACE}*"), F.lit(0))

    def stays(_, i):
        block = F.floor((F.col("start") + i) / BLOCK_WORDS)
        return chosen_before(block + 1) > chosen_before(block)

    cut = F.rtrim(F.array_join(F.filter(parts, stays), ""))
    rows = rows.withColumn(text, F.when(whole, F.col(text)).otherwise(cut))
    if "n_chars" in docs.columns:
        rows = rows.withColumn(at(docs, "n_chars"), F.length(text).cast(docs.schema["n_chars"].dataType))
    return rows.select(*safe.columns).toDF(*docs.columns)
