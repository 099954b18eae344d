import numpy as np
import pytest

from panelmeter.llm import exact, graph, neardup
from panelmeter.llm import words as W

from .brute import classes
from .conftest import SCHEMA, edited, hard_rows, prose


def norm(text):
    import re
    return re.sub(r"[\x20\x09-\x0d]+", " ", text or "")


@pytest.mark.parametrize("hashed", [exact.fingerprint, lambda b: (len(b) % 2, 0, 0)])
def test_exact_duplicates_with_a_good_and_a_colliding_hash(spark, hard, hashed):
    got = exact.exact_duplicates(hard, hashed).toPandas()
    rows = [(r[0], norm(r[1])) for r in hard_rows()]
    ids = {}
    for i, t in rows:
        ids.setdefault(t, []).append(i)
    want = sorted((-1 if i is None else i, min(x for x in ids[t] if x is not None) if any(ids[t]) else -1, len(ids[t]))
                  for i, t in rows)
    have = sorted(zip(got.doc_id.fillna(-1), got.keep_id.fillna(-1), got.group_size))
    assert have == want
    assert got.kept.sum() == len(ids)
    assert got[got.kept].text_sha256.nunique() == len(ids)


def test_huge_texts_are_hashed_in_chunks_elsewhere(spark, hard):
    big = prose(40_000, 5)                                     # four chunks
    texts = [(1, big), (2, big.replace(" ", "\n", 1)), (3, big[:-1] + "!"), (4, " " * 300_000), (5, " "), (None, big)]
    docs = spark.createDataFrame([(i, t, *[None] * 6) for i, t in texts], SCHEMA).repartition(3)
    parts = exact.chunk_fingerprints(docs, 100_000).collect()
    assert sorted((r.h1, r.h2, r.n) for r in parts) == sorted(
        exact.fingerprint(norm(t).encode()) for _, t in texts if len(t) > 100_000)
    near, far = (exact.exact_duplicates(docs, huge=n).toPandas().sort_values("doc_id") for n in (100_000, exact.HUGE))
    assert near.fillna(-1).values.tolist() == far.fillna(-1).values.tolist()
    assert list(near.keep_id) == [1, 1, 3, 4, 4, 1]


def test_null_and_repeated_ids_are_linear(spark):
    """Groups are compared in levels of salts by row, whatever the ids are."""
    texts = spark.range(3000).selectExpr("IF(id % 2 = 0, NULL, 7L) AS doc_id", "IF(id = 1999, 'odd one', 'same text') AS text")
    old, exact.PER_SALT = exact.PER_SALT, 8
    try:
        got = exact.exact_duplicates(texts, lambda b: (5, 5, 5)).toPandas()
        rows = spark.range(3000).selectExpr("5L AS h1", "5L AS h2", "5L AS n").groupBy("h1", "h2", "n").count()
        bad = exact.differing(texts, rows.withColumnRenamed("count", "size"), lambda b: (5, 5, 5)).count()
    finally:
        exact.PER_SALT = old
    assert bad == 1 and sorted(set(got.group_size)) == [1, 2999] and got.kept.sum() == 2
    assert set(got.keep_id) == {7}


def test_filter_holds_every_repeated_fingerprint(spark):
    marks = [exact.fingerprint(prose(20, k).encode()) for k in range(400)]
    bits = exact.repeated_filter(spark.createDataFrame([(*m, 2) for m in marks[:200]], "h1 long, h2 long, n long, size long"))
    hit = [bool(bits[(p := exact._filter_place(m[0], m[1])) >> 3] >> (p & 7) & 1) for m in marks]
    assert all(hit[:200]) and sum(hit[200:]) < 5
    assert len(bits) == exact.FILTER_BITS // 8


def test_exact_empty(none):
    assert exact.exact_duplicates(none).count() == 0


def test_fingerprints_compose():
    data = prose(40_000, 9).encode()
    whole = exact.fingerprint(data)
    for cut in (0, 1, 70_000, len(data)):
        assert exact.combine(exact.fingerprint(data[:cut]), exact.fingerprint(data[cut:])) == whole
    slow = 0
    for b in data[:5000]:
        slow = (slow * exact.BASES[0] + b) % exact.PRIMES[0]
    assert exact.fingerprint(data[:5000])[0] == slow


def test_parts_combine_in_spark(spark):
    data = prose(3000, 3).encode()
    parts = [(1, k, *exact.fingerprint(data[a:a + 999])) for k, a in enumerate(range(0, len(data), 999))]
    got = exact.combine_fingerprints(spark.createDataFrame(parts, "doc long, k int, h1 long, h2 long, n long"),
                                     "doc", "k").collect()
    assert tuple(got[0])[1:] == exact.fingerprint(data)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 200), (7, 7)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 130)} == {100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_known_classes_are_walked_as_single_nodes(spark, monkeypatch):
    first = [(0, k) for k in range(1, 30)] + [(50, k) for k in range(51, 80)]
    more = [(k, k + 1) for k in range(28)] + [(5, 60 + k) for k in range(10)] + [(90, 91), (91, 50), (100, 101)]
    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    known, walked, cut = graph.components(frame(first)), [], graph.cut_lineage

    def counted(df, tag):
        out = cut(df, tag)
        walked.extend([out.count()] if tag == "edges" else [])
        return out

    monkeypatch.setattr(graph, "cut_lineage", counted)
    got = {tuple(r) for r in graph.extended(known, frame(more)).collect()}
    assert walked == [2 * 4]           # 0-50, 90-91, 91-50, 100-101
    assert got == {tuple(r) for r in graph.components(frame(first + more)).collect()}
    assert {tuple(r) for r in graph.extended(known, frame([(3, 4)])).collect()} == {tuple(r) for r in known.collect()}


def test_darts_estimate_weighted_jaccard():
    rng = np.random.RandomState(0)
    sets = [{int(x): 1 + (x % 4) for x in rng.randint(0, 1 << 60, 200)}]
    other = dict(list(sets[0].items())[:150]) | {int(x): 2 for x in rng.randint(0, 1 << 60, 40)}
    sets.append(other)
    row = np.concatenate([np.full(len(s), i) for i, s in enumerate(sets)])
    keys = np.concatenate([np.array(list(s), dtype=W.U) for s in sets])
    weight = np.concatenate([np.array(list(s.values()), float) for s in sets])
    sig = neardup.dart_signatures(row, keys, weight, 2, k=2048)
    every = set(sets[0]) | set(other)
    low = sum(min(sets[0].get(x, 0), other.get(x, 0)) for x in every)
    high = sum(max(sets[0].get(x, 0), other.get(x, 0)) for x in every)
    assert abs((sig[0] == sig[1]).mean() - low / high) < 0.04
    assert np.array_equal(neardup.dart_signatures(row[:1], keys[:1], weight[:1], 1, k=16),
                          neardup.dart_signatures(row[:1], keys[:1], weight[:1], 1, k=16))


def check_classes(rows, got):
    """got: (doc_id, class_id, class_size, kept) against all pairs; ids may repeat or be null."""
    part = classes([(r[0], r[1]) for r in rows])
    named = {}
    for p, r in zip(part, rows):
        named.setdefault(p, []).append(r[0])
    want = sorted((-1 if r[0] is None else r[0], min((i for i in named[p] if i is not None), default=-1), len(named[p]))
                  for p, r in zip(part, rows))
    assert sorted(zip(got.doc_id.fillna(-1), got.class_id.fillna(-1), got.class_size)) == want
    assert got.kept.sum() == len(named)


def test_near_duplicates_against_all_pairs(hard):
    check_classes(hard_rows(), neardup.near_duplicates(hard).toPandas())


def test_family_of_near_copies_loses_no_link(spark):
    base = prose(80, 20)
    family = [(i, edited(base, 20 + i % 31, i)) for i in range(60)]
    family += [(100 + i, edited(family[i][1], 45, 1000 + i)) for i in range(60)]
    rows = [(i, t, None, None, 0, "", "", "") for i, t in family + [(900 + i, prose(70, 50 + i)) for i in range(40)]]
    check_classes(rows, neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).toPandas())


def test_repeated_texts_and_lines_lose_no_link(spark):
    texts = []
    for i in range(12):
        text, words = prose(90, 3000 + i), prose(90, 3000 + i).split(" ")
        line = " ".join(words[30:58])
        texts += [text, *[" ".join([text] * n) for n in (2, 3, 10)],
                  " ".join([*words[:30], *[line] * 50, *words[58:]]), prose(90, 4000 + i)]
    rows = [(i, t, None, None, 0, "", "", "") for i, t in enumerate(texts)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).toPandas()
    check_classes(rows, got)
    assert sorted(got.class_size) == [1] * 12 + [5] * 60


def test_stage_keeps_one_row_of_each_class(hard, none):
    kept = neardup.drop_near_duplicates(hard)
    assert kept.columns == hard.columns
    part = classes([(r[0], r[1]) for r in hard_rows()])
    assert kept.count() == len(set(part))
    assert neardup.drop_near_duplicates(none).count() == 0
    assert neardup.near_duplicates(none).count() == 0
