import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from panelmeter.llm import merkle, tries

from .conftest import hard_rows, prose


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    text = row[1] and "".join(c.lower() if "A" <= c <= "Z" else c for c in row[1]) if lower else row[1]
    fields = [row[0], row[3], row[2], row[4], text]
    return h(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def tree(nodes):
    """(root, siblings of each node left to right and level by level as (left, right))."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, i in zip(paths, at):
            run = i // 16 * 16
            p.append(("".join(nodes[run:i]), "".join(nodes[i + 1:run + 16])))
        nodes = [h(*nodes[k:k + 16]) for k in range(0, len(nodes), 16)]
        at = [i // 16 for i in at]
    return nodes[0], paths


def plain_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((-1 if r[0] is None else r[0], leaf(r), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[1] for x in sorted(by[s], key=lambda x: x[:2])]) for s in sources}
    root, tops = tree([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops):
        for (_, own, r), path in zip(sorted(by[s], key=lambda x: x[:2]), trees[s][1]):
            changed = zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 5 == 0
            node = leaf(r, True) if changed else own
            for left, right in path + top:
                node = h(left, node, right)
            out.append((r[0], s, own, trees[s][0], root, h(*[a + b for a, b in path + top]), node, node == root))
    return out


def spread(n_sources, n):
    rng = random.Random(5)
    rows = [(k, prose(4, k).title() if k % 3 else prose(3, k), "en", f"s{rng.randrange(n_sources)}", k, "x", "y", "z")
            for k in range(n)]
    return rows + [(n + k, f"Hot {k}", None, "hot", None, "x", "y", "z") for k in range(n // 2)]


@pytest.mark.parametrize("rows, levels", [("hard", 2), (spread(40, 700), 1), (spread(3, 900), 2)])
def test_manifest_by_hand(spark, hard, monkeypatch, rows, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 16 ** levels)
    docs = hard if rows == "hard" else spark.createDataFrame(rows, hard.schema).repartition(3)
    rows = hard_rows() if rows == "hard" else rows
    key = lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:]))
    got = sorted((tuple(r) for r in merkle.manifest(docs).collect()), key=key)
    assert got == sorted(plain_manifest(rows), key=key)
    if len(rows) > 100:
        assert {r[-1] for r in got} == {True, False}


def test_manifest_of_one_row_and_none(spark, hard, none):
    one = spark.createDataFrame(hard_rows()[:1], hard.schema)
    r = merkle.manifest(one).collect()[0]
    assert r.leaf == r.subroot == r.root == leaf(hard_rows()[0]) and r.proof_sha256 == h("")
    assert merkle.manifest(none).count() == 0


def plain_trie(rows):
    said = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            said[c].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [t[2:] for t in sorted(v)] for c, v in said.items()}
    built = {}
    for c, own in said.items():
        k = zlib.crc32(str(c).encode()) % 9
        base = c - c % 5 if c >= 0 else c + -c % 5
        built[c] = tuple(said.get(base, [])[:k] + own[k:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(list)
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in kids[n]) or 1
        saved[n] = sum(saved[k] for k in kids[n]) + ((len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0)
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n],
                   h(",".join(map(str, sorted(c for c in m if built[c] == n))))) for n, m in members.items())


SAID = "conv_id long, turn long, role string, text string, h1 string, `CONV_ID` string, place long"


def talks(seed, convs, low=0):
    """Shared beginnings, a hot first turn, a long conversation, copies, nulls, missing bases."""
    rng = random.Random(seed)
    rows = []
    for c in range(low, low + convs):
        if c % 10 == 5:
            continue                                          # its four followers have no base
        for t in range(rng.randint(1, 9) if c != 7 else 60):
            text = "hello" if t == 0 and c % 3 else rng.choice(["yes", "no", None, "Größe"])
            rows.append((c, t, rng.choice(["user", None]) if t % 2 else "assistant", text, "x", "y", 1))
    copy = [r[1:] for r in rows if r[0] == 7]
    rows += [(5 * c, *r) for c in range(1000, 1030) for r in copy]   # copies that own their whole text
    return rows + [(None, 1, "user", "lost", "x", "y", 1), (low, None, "user", "first", "x", "y", 1), (3, 0, None, None, "x", "y", 1)]


@pytest.mark.parametrize("seed, least, room", [(1, 3, 2), (2, 30, 5), (3, 2048, 1 << 20)])
def test_trie_by_hand(spark, seed, least, room):
    rows = talks(seed, 60, -12)
    got = tries.trie(spark.createDataFrame(rows, SAID).repartition(5), least_shard=least, room=room).collect()
    assert sorted(tuple(r) for r in got) == plain_trie(rows)


def test_trie_without_rows(spark):
    assert tries.trie(spark.createDataFrame([], SAID)).count() == 0
    only = tries.trie(spark.createDataFrame([(None, 1, "user", "x", "", "", 1)], SAID))
    assert only.count() == 0


def test_queue_spills_in_order(tmp_path):
    rng = random.Random(1)
    queue, want, got = tries.Queue(2, f"file://{tmp_path}/q", room=10), [], []
    for k in range(2000):
        item = (rng.randrange(10**6), -k)
        want.append(item)
        queue.push(item)
        if k % 3 == 0:
            got.append(queue.pop())
            assert got[-1] == min(want)
            want.remove(got[-1])
        assert len(queue.heap) <= 10 + len(queue.runs)
    rest = []
    while queue.head():
        rest.append(queue.pop())
    assert rest == sorted(want) and queue.runs
    queue.close()
    assert not list((tmp_path / "q").iterdir())


def test_long_endings_are_hashed_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(tries, "CHUNK", 64)
    ends = spark.range(5000).selectExpr("id % 3 = 0 AS hot", "id").selectExpr(
        "CAST(IF(hot, 1, id) AS long) AS e1", "0L AS e2", "id AS conv_id").repartition(7)
    got = {r.e1: r.ends_sha256 for r in tries.endings(ends).collect()}
    want = defaultdict(list)
    for i in range(5000):
        want[1 if i % 3 == 0 else i].append(i)
    assert got == {k: h(",".join(map(str, sorted(v)))) for k, v in want.items()}
