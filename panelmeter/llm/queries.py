"""The queries of this subpackage, each over its whole table, beside SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (decontaminate, exact, merkle, mixing, neardup, packing, quality, secrets, tokens, toxicity, tries, urls,
               warc)
from .tables import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return add


def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


def pages(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet")


@register("op1_secret_formats")
def op1(spark, sf):
    return secrets.find_secrets(documents(spark, sf))


@register("op2_toxicity_factors")
def op2(spark, sf):
    return toxicity.judge(documents(spark, sf), labels(spark, sf))


@register("op3_token_files")
def op3(spark, sf):
    return tokens.encoded(documents(spark, sf))


@register("op4_url_ngrams")
def op4(spark, sf):
    return urls.judge(pages(spark, sf), urls.labelled(spark))


@register("op5_benchmark_containment")
def op5(spark, sf):
    return decontaminate.contaminated_pairs(documents(spark, sf), decontaminate.benchmark(spark, sf))


@register("op6_polynomial_dedup", exact.SQL)
def op6(spark, sf):
    return exact.exact_duplicates(documents(spark, sf))


@register("op7_dart_near_duplicates")
def op7(spark, sf):
    return neardup.near_duplicates(documents(spark, sf)).select("doc_id", "class_id", "class_size", "kept")


@register("op8_nb_support_vectors")
def op8(spark, sf):
    return quality.judge(documents(spark, sf), labels(spark, sf))


@register("op9_warc_derivatives", warc.SQL)
def op9(spark, sf):
    return warc.derive(warc.responses(pages(spark, sf)))


def _draw_sql(*parts: str) -> str:
    text = " || '|' || ".join([f"'{mixing.SEED}'", *parts])
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


def _seats_sql(name: str, units: str, parent: str, key: str, votes: str) -> str:
    """All quotients of all units, the best of them within the parent's seats."""
    cols = f"{parent + ', ' if parent else ''}{key}"
    part = f"PARTITION BY {parent}" if parent else ""
    return f"""{name}_q AS (
  SELECT {cols}, seats, row_number() OVER ({part} ORDER BY {votes}::DOUBLE / (2 * k + 1) DESC, {key}, k) AS r
  FROM (SELECT *, unnest(range(cap::BIGINT)) AS k FROM {units})),
{name} AS (SELECT {cols}, count(*) AS got FROM {name}_q WHERE r <= seats GROUP BY {cols})"""


_CHOSEN = "(({0}) * extra + turn) // greatest(blocks, 1)"


def _taken_sql(word: str) -> str:
    b = mixing.BLOCK_WORDS
    at = f"({word}) // {b}"
    first, after = _CHOSEN.format(at), _CHOSEN.format(f"{at} + 1")
    return f"(({first}) * {b} + (({word}) - ({at}) * {b}) * (({after}) - ({first})))"


MIX_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(text, '')) AS digest FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, source_size * {mixing.MOST} AS cap, [3, 1, 2][place % 3 + 1] AS weight FROM totals),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM totals) * 3 / 2.0::DOUBLE
             - coalesce(sum(cap) OVER w, 0))::DOUBLE
            / ((SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed WINDOW w AS (ORDER BY cap::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT level FROM levels WHERE cap::DOUBLE / weight > level ORDER BY cap::DOUBLE / weight, place LIMIT 1),
goal AS (
  SELECT source, source_size, place, CASE WHEN l IS NULL OR cap <= l * weight THEN cap::DOUBLE
         ELSE l * weight END AS target
  FROM (SELECT *, (SELECT level FROM level) AS l FROM weighed)),
named AS (
  SELECT s.*, g.source_size, g.place, g.target, coalesce(s.doc_id::VARCHAR, '?' || digest) AS name,
         greatest((g.source_size + {mixing.SHARD_WORDS - 1}) // {mixing.SHARD_WORDS}, 1) AS shards
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
dealt AS (
  SELECT *, shard // {mixing.RACK_SHARDS} AS rack, {_draw_sql("'order'", "name")} AS turn_at
  FROM (SELECT *, {_draw_sql("'shard'", "name")} % shards AS shard FROM named)),
held AS (
  SELECT place, rack, shard, sum(size)::BIGINT AS words,
         (sum(size)::BIGINT + {mixing.BLOCK_WORDS - 1}) // {mixing.BLOCK_WORDS} AS blocks
  FROM dealt GROUP BY ALL),
tops AS (
  SELECT h.place, g.target, h.cap, (SELECT round(sum(target) / {mixing.BLOCK_WORDS})::BIGINT FROM goal) AS seats
  FROM (SELECT place, sum(blocks) * {mixing.MOST} AS cap FROM held GROUP BY 1) h JOIN goal g USING (place)),
{_seats_sql("top_seats", "tops", "", "place", "target")},
racks AS (
  SELECT h.*, t.got AS seats FROM (
    SELECT place, rack, sum(words) AS words, sum(blocks) * {mixing.MOST} AS cap FROM held GROUP BY 1, 2) h
  JOIN top_seats t USING (place)),
{_seats_sql("rack_seats", "racks", "place", "rack", "words")},
shards AS (
  SELECT h.place, h.rack, h.shard, words, blocks * {mixing.MOST} AS cap, r.got AS seats
  FROM held h JOIN rack_seats r USING (place, rack)),
{_seats_sql("shard_seats", "shards", "place, rack", "shard", "words")},
placed AS (
  SELECT d.*, h.blocks, coalesce(q.got, 0) // greatest(h.blocks, 1) AS base,
         coalesce(q.got, 0) % greatest(h.blocks, 1) AS extra,
         {_draw_sql("'start'", "d.place::VARCHAR", "d.shard::VARCHAR")} % greatest(h.blocks, 1) AS turn,
         (sum(size) OVER (PARTITION BY d.place, d.shard ORDER BY turn_at, doc_id NULLS FIRST, digest
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS start
  FROM dealt d JOIN held h USING (place, rack, shard) LEFT JOIN shard_seats q USING (place, rack, shard))
SELECT doc_id, size, source_size, target,
       (base * size + {_taken_sql("start + size")} - {_taken_sql("start")})::BIGINT AS taken
FROM placed"""


@register("op10_mix_sources", MIX_SQL)
def op10(spark, sf):
    return mixing.mix(documents(spark, sf))


@register("op11_matched_packing")
def op11(spark, sf):
    return packing.pack(documents(spark, sf))


@register("op12_merkle_levels", merkle.SQL)
def op12(spark, sf):
    return merkle.manifest(documents(spark, sf))


@register("op13_forward_trie", tries.SQL)
def op13(spark, sf):
    return tries.trie(spark.read.parquet(f"{sf}/conversations.parquet"))
