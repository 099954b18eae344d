"""WARC derivatives: metadata and plain-text conversion records from response records.

A response record carries an HTTP head and an HTML payload. From each one come two
records: `metadata` (title, language, number of outlinks and the source's HTTP headers,
as application/warc-fields) and `conversion` (the visible text as text/plain). Both
refer to the response by id, URI, date and payload digest; the metadata record names
the conversion as concurrent. Record ids are derived from the source, so a rerun gives
the same ids, and every record has its own block digest and length. All of the
derivation is built-in functions, row by row, without a shuffle.

Null pages are empty pages, a null url is an empty URI; a null page_id stays null and
takes part in the id as an empty text; repeated rows give repeated records with the same
ids. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import io
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import pick

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
HTML_TYPE = "text/html; charset=utf-8"

#: what is cut from a page, in this order: (pattern, replacement), alike in Java and RE2
CUTS = [
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<script\b[^>]*>.*?</script\s*>", ""),
    (r"(?is)<style\b[^>]*>.*?</style\s*>", ""),
    (r"(?i)</?(p|div|br|h[1-6]|li|ul|ol|nav|article|section|footer|header|title|tr|table)\b[^>]*>", "\n"),
    (r"<[^>]*>", ""),
]
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
            ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
TIDY = [(r"[\x20\x09\x0B-\x0D]+", " "), (r"\x20?\n[\n\x20]*", "\n"), (r"^[\n\x20]+", ""), (r"[\n\x20]+$", "")]
TITLE = r"(?is)<title[^>]*>(.*?)</title\s*>"
LANG = r"""(?i)<html[^>]*\blang=["']?([A-Za-z-]+)"""
LINK = r"(?i)<a\b[^>]*\bhref="


def _sub(col: Column, pairs) -> Column:
    for pattern, value in pairs:
        col = F.regexp_replace(col, pattern, value)
    return col


def _entities(col: Column) -> Column:
    for name, sign in ENTITIES:
        col = F.replace(col, F.lit(name), F.lit(sign))
    return col


def visible_text(html: Column) -> Column:
    return _sub(_entities(_sub(html, CUTS)), TIDY)


def title(html: Column) -> Column:
    return _sub(_entities(F.regexp_replace(F.regexp_extract(html, TITLE, 1), "<[^>]*>", "")),
                [(r"[\x20\x09-\x0D]+", " "), (r"^\x20|\x20$", "")])


def digest(col: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(col.cast("binary"), 256))


def record_id(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
                                           for x in (F.lit("-"), F.substring(h, a, n))][1:], F.lit(">"))


def octets(col: Column) -> Column:
    return F.octet_length(col).cast("long")


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """One response record per page: page_id, record_id, target_uri, date, http_head, payload
    and payload_digest."""
    url, body = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: {HTML_TYPE}{CRLF}Content-Length: "),
                    octets(body).cast("string"), F.lit(CRLF + CRLF))
    return pick(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("long"),
        record_id("response", F.coalesce(F.col("page_id").cast("string"), F.lit("")), url, F.md5(body.cast("binary"))
                  ).alias("record_id"),
        url.alias("target_uri"), F.lit(date).alias("date"), head.alias("http_head"), body.alias("payload"),
        digest(body).alias("payload_digest"))


def derive(source: DataFrame) -> DataFrame:
    """Two records per response: page_id, record_type, record_id, refers_to, concurrent_to,
    target_uri, date, content_type, source_digest, block_digest, content_length, block."""
    meta_id, text_id = record_id("metadata", F.col("record_id")), record_id("conversion", F.col("record_id"))
    head = F.regexp_replace(F.regexp_replace("http_head", r"^[^\n]*\n", ""), r"(\r\n)+$", "")
    fields = F.concat(
        F.lit("title: "), title(F.col("payload")), F.lit(CRLF + "language: "),
        F.regexp_extract("payload", LANG, 1), F.lit(CRLF + "outlinks: "),
        F.regexp_count("payload", F.lit(LINK)).cast("string"), F.lit(CRLF + "source-status: "),
        F.regexp_extract("http_head", r"^([^\r\n]*)", 1), F.lit(CRLF + "source-"),
        F.regexp_replace(head, r"\r\n", CRLF + "source-"), F.lit(CRLF))

    def record(kind, own, concurrent, content_type, block):
        return F.struct(F.lit(kind).alias("record_type"), own.alias("record_id"), concurrent.alias("concurrent_to"),
                        F.lit(content_type).alias("content_type"), block.alias("block"))

    both = F.array(record("metadata", meta_id, text_id, "application/warc-fields", fields),
                   record("conversion", text_id, F.lit(None).cast("string"), "text/plain; charset=utf-8",
                          visible_text(F.col("payload"))))
    rows = source.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date",
                         F.col("payload_digest").alias("source_digest"), F.inline(both))
    return rows.select("page_id", "record_type", "record_id", "refers_to", "concurrent_to", "target_uri", "date",
                       "content_type", "source_digest", digest(F.col("block")).alias("block_digest"),
                       octets(F.col("block")).alias("content_length"), "block")


def header(records: DataFrame) -> Column:
    """The WARC header of a derived record, ended by an empty line."""
    lines = [("WARC-Type", F.col("record_type")), ("WARC-Record-ID", F.col("record_id")),
             ("WARC-Date", F.col("date")), ("WARC-Target-URI", F.col("target_uri")),
             ("WARC-Refers-To", F.col("refers_to")), ("WARC-Refers-To-Target-URI", F.col("target_uri")),
             ("WARC-Refers-To-Date", F.col("date")), ("WARC-Source-Payload-Digest", F.col("source_digest")),
             ("WARC-Concurrent-To", F.col("concurrent_to")), ("WARC-Block-Digest", F.col("block_digest")),
             ("Content-Type", F.col("content_type")), ("Content-Length", F.col("content_length").cast("string"))]
    return F.concat(F.lit(VERSION + CRLF), *[F.coalesce(F.concat(F.lit(k + ": "), v, F.lit(CRLF)), F.lit(""))
                                             for k, v in lines], F.lit(CRLF))


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Write derived records as gzip members, a file per partition, into a folder all
    executors share; returns (file, records). A task writes under its own name and renames."""
    from .tokens import _store
    rows = records.select(header(records).alias("head"), "block", F.spark_partition_id().alias("part"))

    def run(it):
        n, out = 0, None
        for batch in it:
            for head, block, part in zip(*(batch.column(c).to_pylist() for c in ("head", "block", "part"))):
                if out is None:
                    store, root = _store(folder)
                    store.create_dir(root, recursive=True)
                    name = f"{root}/part-{part:05d}.warc.gz"
                    own = f"{name}.{uuid.uuid4().hex}"
                    out = store.open_output_stream(own, compression=None)
                out.write(gzip.compress((head + block + CRLF + CRLF).encode(), mtime=0))
                n += 1
        if out is not None:
            out.close()
            store.move(own, name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "records"])

    return rows.mapInArrow(run, "file string, records long")


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """(headers, block) of every record of the files of a folder, a file at a time as a stream."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content")

    def run(it):
        for batch in it:
            for content in batch.column("content"):
                with gzip.open(io.BytesIO(content.as_py())) as f:
                    while f.readline().strip():
                        head = {}
                        while line := f.readline().decode().rstrip(CRLF):
                            key, _, value = line.partition(": ")
                            head[key] = value
                        block = f.read(int(head["Content-Length"])).decode()
                        f.read(4)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([list(head.items())], pa.map_(pa.string(), pa.string())), pa.array([block])],
                            names=["headers", "block"])

    return files.mapInArrow(run, "headers map<string,string>, block string")


# --- the same derivation in DuckDB's SQL ---------------------------------------------

def _quoted(text: str) -> str:
    return " || ".join(p for i, part in enumerate(text.split("\n")) for p in (
        ["chr(10)"] if i else []) + ["'" + part.replace("'", "''").replace("\r", "' || chr(13) || '") + "'"])


def _sub_sql(col: str, pairs) -> str:
    for pattern, value in pairs:
        col = f"regexp_replace({col}, {_quoted(pattern)}, {_quoted(value)}, 'g')"
    return col


def _entities_sql(col: str) -> str:
    for name, sign in ENTITIES:
        col = f"replace({col}, {_quoted(name)}, {_quoted(sign)})"
    return col


def _id_sql(*parts: str) -> str:
    h = "md5(" + " || '|' || ".join(parts) + ")"
    cut = " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"('<urn:uuid:' || {cut} || '>')"


_TEXT = _sub_sql(_entities_sql(_sub_sql("payload", CUTS)), TIDY)
_TITLE = _sub_sql(_entities_sql(f"regexp_replace(regexp_extract(payload, {_quoted(TITLE)}, 1), '<[^>]*>', '', 'g')"),
                  [(r"[\x20\x09-\x0D]+", " "), (r"^\x20|\x20$", "")])
SQL = f"""
WITH source AS (
  SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages),
named AS (
  SELECT *, {_id_sql("'response'", "coalesce(page_id::VARCHAR, '')", "target_uri", "md5(payload)")} AS refers_to,
         'sha256:' || sha256(payload) AS source_digest FROM source),
derived AS (
  SELECT page_id, refers_to, target_uri, source_digest, 'conversion' AS record_type,
         {_id_sql("'conversion'", "refers_to")} AS record_id, NULL::VARCHAR AS concurrent_to,
         'text/plain; charset=utf-8' AS content_type, {_TEXT} AS block FROM named
  UNION ALL
  SELECT page_id, refers_to, target_uri, source_digest, 'metadata', {_id_sql("'metadata'", "refers_to")},
         {_id_sql("'conversion'", "refers_to")}, 'application/warc-fields',
         'title: ' || {_TITLE} || {_quoted(CRLF)} || 'language: ' || regexp_extract(payload, {_quoted(LANG)}, 1)
         || {_quoted(CRLF)} || 'outlinks: ' || len(regexp_extract_all(payload, {_quoted(LINK)}))::VARCHAR
         || {_quoted(CRLF + "source-status: HTTP/1.1 200 OK" + CRLF + "source-Content-Type: " + HTML_TYPE + CRLF)}
         || 'source-Content-Length: ' || strlen(payload)::VARCHAR || {_quoted(CRLF)} FROM named)
SELECT page_id, record_type, record_id, refers_to, concurrent_to, target_uri, '{DATE}' AS "date", content_type,
       source_digest, 'sha256:' || sha256(block) AS block_digest, strlen(block)::BIGINT AS content_length, block
FROM derived"""
