import importlib
import json
import os
import zlib

import numpy as np
import pytest

from panelmeter.llm import mixing, tokens, warc
from panelmeter.llm.queries import ORACLES, QUERIES

from test_registered_queries import DATA, load
from .brute import WORD, classes, shingles
from .conftest import SCHEMA, edited, hard_rows, prose


def plain_ids(texts):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(tokens.vocabulary_file())
    return [e.ids + [tokens.END] for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_files_round_trip(spark, hard, none, tmp_path):
    folder = f"file://{tmp_path}/ids"
    manifest = tokens.write_ids(hard, folder, shards=4)
    rows = sorted(((-1 if r[0] is None else r[0], r[1] is not None, r[1] or "") for r in hard_rows()))
    ids = plain_ids([t for *_, t in rows])
    got = tokens.read_ids(spark, folder).toPandas().sort_values("start")
    assert list(got.doc_id.fillna(-1)) == [r[0] for r in rows]
    assert list(got.n_tokens) == [len(x) for x in ids]
    assert list(got.start) == list(np.cumsum([0] + [len(x) for x in ids])[:-1])
    assert list(got.ids_crc32) == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    assert manifest["ids"] == sum(map(len, ids)) and manifest["kind"] == "<u2"
    files = {f for f in os.listdir(tmp_path / "ids") if not f.startswith(".")}
    assert all(f.count(".") == 1 for f in files)          # no file of an unfinished task
    flat = np.concatenate([np.fromfile(tmp_path / "ids" / f"shard-{s['shard']:05d}.bin", "<u2") for s in manifest["shards"]])
    assert flat.tolist() == [x for y in ids for x in y]
    empty = f"file://{tmp_path}/none"
    assert tokens.write_ids(none, empty)["ids"] == 0 and tokens.read_ids(spark, empty).count() == 0


def test_words_are_encoded_as_in_whole_texts():
    texts = ["can't we'll <|endoftext|> END", "a<|startoftext|>b", "x\x1cy \u0085 z\u00a0w", "ΑΣ ΑΣ.", "e\u0301 \u0301x", "q" * 500,
             "12 34,5 !!\t\n", "", "日本語 テキスト"]
    encoder = tokens.Encoder(tokens.vocabulary_file())
    old, tokens.WORD_CACHE = tokens.WORD_CACHE, 3          # forgets all the time
    try:
        for _ in range(2):
            assert [list(x) + [tokens.END] for x in encoder.encode(texts)] == plain_ids(texts)
    finally:
        tokens.WORD_CACHE = old


def quotients(votes, caps, seats):
    """All quotients, one seat at a time."""
    got = [0] * len(votes)
    for _ in range(min(seats, sum(caps))):
        best = max((i for i in range(len(votes)) if got[i] < caps[i]), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
        got[best] += 1
    return got


@pytest.mark.parametrize("votes,caps,seats", [
    ([53, 24, 23], [99] * 3, 10), ([1] * 9, [2] * 9, 7), ([100, 1, 1, 1, 1], [3, 9, 9, 9, 9], 20),
    ([0, 0, 5], [4, 4, 4], 3), ([7, 7, 7], [1, 1, 1], 9), ([1000] + [1] * 40, [10**6] * 41, 333), ([5], [0], 3)])
def test_apportion_is_the_highest_quotients(spark, votes, caps, seats):
    units = spark.createDataFrame([(p, i, v, c, seats) for p in (0, 1) for i, (v, c) in enumerate(zip(votes, caps))],
                                  "p int, k int, v long, c long, n long")
    got = mixing.apportion(units, ["p"], "k", "v", "n", "c").orderBy("p", "k").toPandas().got
    assert list(got) == quotients(votes, caps, seats) * 2


def plain_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    goal, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        whole = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / whole > 2 * sizes[s]}
        if not over:
            return goal | {s: left * w[s] / whole for s in open_}
        for s in over:
            goal[s] = 2.0 * sizes[s]
            left -= goal[s]
        open_ -= over
        if not open_:
            return goal


def test_mix_reaches_its_targets(spark):
    rows = [(i, prose(5 + (i * 37) % 400, i), "", None if i % 9 == 0 else "ß" if i % 9 == 1 else f"s{min(i % 9, 5)}", 0, "", "", "")
            for i in range(500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs).toPandas()
    source = {r[0]: r[3] for r in rows}
    size = {r[0]: len(WORD.findall(r[1])) for r in rows}
    sums = {}
    for i, s in source.items():
        sums[s] = sums.get(s, 0) + size[i]
    goal = plain_targets(sums)
    taken = {}
    for r in got.itertuples():
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == sums[s] and abs(r.target - goal[s]) < 1e-6 * goal[s]
        assert 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - goal[s]) <= 0.01 * goal[s] + 16 for s in goal)
    again = mixing.mix(docs.repartition(5)).toPandas()
    key = ["doc_id"]
    assert got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = {}
    for i, text, *_ in out.collect():
        words[i] = words.get(i, 0) + len(WORD.findall(text))
    assert words == {i: t for i, t in zip(got.doc_id, got.taken) if t}


def test_mix_of_hard_rows_and_empty_tables(spark, hard, none):
    got = mixing.mix(hard).toPandas()
    assert len(got) == hard.count() and (got.taken <= 2 * got["size"]).all()
    words = sum(len(WORD.findall(r[1])) for r in mixing.mixed_documents(hard).collect())
    assert words == got.taken.sum()
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    blank = spark.createDataFrame([(1, "", "", "a", 0, "", "", ""), (2, None, "", None, 0, "", "", "")], SCHEMA)
    assert set(mixing.mix(blank).toPandas().taken) == {0}


def test_warc_files_round_trip(spark, tmp_path):
    rows = [(1, "http://a.b/c", '<html lang="en"><head><title>T &amp; t</title><style>p{}</style></head><body><p>one<br>two '
             '<a href="/x">three</a><script>var a="</p>";</script><!-- no --></body></html>', "x"),
            (2, None, None, "y"), (None, "u", "plain é text", "z"), (1, "http://a.b/c", "", "w"), (3, "v", "<p>" * 3000 + "deep", "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, block string")
    source = warc.responses(pages)
    records = warc.derive(source)
    assert records.count() == 2 * len(rows)
    text = {r.page_id: r for r in records.filter("record_type = 'conversion' AND content_length > 0").collect()}
    assert text[1].block == "T & t\none\ntwo three" and text[None].block == "plain é text" and text[3].block == "deep"
    ids = {r.record_id for r in source.collect()}
    assert {r.refers_to for r in records.collect()} == ids
    folder = f"file://{tmp_path}/warc"
    assert sum(r.records for r in warc.write_warc(records.repartition(3), folder).collect()) == 2 * len(rows)
    back = warc.read_warc(spark, folder).collect()
    want = sorted((r.record_id, r.refers_to, r.source_digest, r.block_digest, r.block) for r in records.collect())
    assert sorted((r.headers["WARC-Record-ID"], r.headers["WARC-Refers-To"], r.headers["WARC-Source-Payload-Digest"],
                   r.headers["WARC-Block-Digest"], r.block) for r in back) == want
    meta = next(r.block for r in records.filter("record_type = 'metadata' AND page_id = 1 AND block LIKE '%T & t%'").collect())
    assert "language: en\r\n" in meta and "outlinks: 1\r\n" in meta and "source-Content-Type: text/html" in meta
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")
def test_queries_match_their_sql(spark):
    check = load("check_queries")
    con = check.connect(DATA)
    for name, sql in ORACLES.items():
        diff = check.compare(QUERIES[name](spark, DATA).toPandas(), con.execute(sql).df())
        assert diff is None, f"{name}: {diff}"


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage's rows from the rows of the one before, by plain definitions."""
    docs = [(i, prose(60 + i % 50, i) + (" vileword groupname" if i % 6 == 0 else ""), "en", f"s{i % 3}", 0) for i in range(150)]
    docs += [(200 + i, edited(docs[i][1], 80, i), "en", "s1", 0) for i in range(1, 20)]
    items = [(k, prose(20, 800 + k)) for k in range(5)]
    docs += [(300 + k, prose(50, 900 + k) + " " + t, "en", "s0", 0) for k, t in items]
    docs += [(400, None, None, None, None), (401, "", "en", "s2", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, table in (("documents", spark.createDataFrame(docs, schema)),
                        ("labels", spark.createDataFrame([(d[0], 1, int("vileword" in (d[1] or ""))) for d in docs],
                                                         "doc_id long, quality int, toxic int")),
                        ("benchmark", spark.createDataFrame(items, "item_id long, text string"))):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    pipeline = importlib.import_module("corpus_pipeline")
    frame, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path))
        seen.append([tuple(r) for r in frame.collect()])
    clean = [d for d in docs if "vileword" not in (d[1] or "")]
    assert sorted(map(json.dumps, seen[0])) == sorted(map(json.dumps, clean))
    clean = sorted(clean)
    part = classes([(d[0], d[1]) for d in clean])
    first = [clean[p] for p in sorted(set(part))]
    assert sorted(seen[1]) == sorted(first)
    left = [d for d in first if not any(len(shingles(t) & shingles(d[1])) >= 0.8 * len(shingles(t)) for _, t in items)]
    assert sorted(seen[2]) == sorted(left) and len(left) < len(first)
    taken = {r.doc_id: r.taken for r in mixing.mix(spark.createDataFrame(left, schema)).collect()}
    words = {}
    for d in seen[3]:
        words[d[0]] = words.get(d[0], 0) + len(WORD.findall(d[1]))
    assert words == {i: n for i, n in taken.items() if n}
    mixed = sorted((d[0], d[1]) for d in seen[3])
    ids = plain_ids([t for _, t in mixed])
    want = [(d, int(s), len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
            for (d, _), s, x in zip(mixed, np.cumsum([0] + [len(x) for x in ids])[:-1], ids)]
    assert sorted(seen[4], key=lambda r: r[1]) == want
    assert sorted(map(tuple, pipeline.run(spark, str(tmp_path)).collect()), key=lambda r: r[1]) == want
