import json
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from panelmeter.llm import byteids, packing

from .conftest import hard_rows, prose


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(packing.vocabulary_file())


def plain_bins(lengths, capacity):
    """Items one at a time: large ones matched longest first, the others to the least room."""
    large = sorted((x for x in lengths if 3 * x > capacity), reverse=True)
    room = []
    while large:
        x = large.pop(0)
        fits = [i for i, y in enumerate(large) if x + y <= capacity]
        room.append(capacity - x - (large.pop(fits[0]) if fits else 0))
    for x in sorted((x for x in lengths if 3 * x <= capacity), reverse=True):
        fits = [r for r in room if r >= x]
        if fits:
            room.remove(min(fits))
        room.append((min(fits) if fits else capacity) - x)
    return len(room)


def laid(steps):
    """Sequence: its (offset, length) pairs, as the steps put them."""
    out = {}
    for length, _, copies, n, first, offset in steps:
        for s in range(first, first + n):
            out.setdefault(s, []).extend((offset + k * length, length) for k in range(copies))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_plan_packs_like_one_item_at_a_time(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 30, 100, 2048])
    high = rng.choice([capacity, capacity // 2, capacity // 3 + 2])
    lengths = [min(capacity, 1 + int(rng.random() ** rng.choice([1, 3]) * high)) for _ in range(rng.choice([1, 40, 400]))]
    lengths += [rng.choice(lengths)] * rng.choice([0, 200])              # one length has a third
    steps = packing.plan(Counter(lengths), capacity)
    found = laid(steps)
    assert Counter(x for own in found.values() for _, x in own) == Counter(lengths)
    for own in found.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0] + [x for _, x in own])[:-1])
        assert sum(x for _, x in own) <= capacity
        assert sum(3 * x > capacity for _, x in own) <= 2
    assert len(found) == plain_bins(lengths, capacity)
    ranks = {}
    for length, rank, copies, n, _, _ in steps:                          # ranks of a length without gaps
        assert ranks.get(length, 0) == rank
        ranks[length] = rank + copies * n


def test_plan_size_is_bounded():
    steps = packing.plan({x: 10**9 + x * 7919 for x in range(1, 2049)})
    assert len(steps) < 200_000 and packing.plan({}) == []


def test_packed_pieces(spark, hard, none, library):
    capacity = 100
    got = packing.pack(hard, capacity=capacity, with_ids=True).toPandas()
    want = {}
    for k, r in enumerate(hard_rows()):
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [packing.END]
        cuts = [0] + list(range(len(ids) % capacity or capacity, len(ids) + 1, capacity))
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            key = (r[0], piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
            want[key] = want.get(key, 0) + 1
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = [tuple(None if x != x else int(x) for x in r) for r in got[cols].itertuples(index=False)]
    assert Counter(rows) == Counter(want)
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert list(own.offset) == list(np.cumsum([0, *own.length])[:-1]) and own.length.sum() <= capacity
    assert got.sequence_id.nunique() == plain_bins(list(got.length), capacity)
    full = packing.sequences(packing.pack(hard, capacity=capacity, with_ids=True)).toPandas()
    assert full.n_tokens.sum() == got.length.sum() and full.n_tokens.max() <= capacity
    first = full.iloc[0]
    own = got[got.sequence_id == first.sequence_id].sort_values("offset")
    assert bytes(first.ids) == b"".join(map(bytes, own.ids)) and list(first.starts) == list(own.offset)
    assert packing.pack(none).count() == 0
    assert packing.pack(none).columns == [*cols, "sequence_id", "offset"]


def test_ids_are_those_of_the_library(library, monkeypatch):
    rng = random.Random(3)
    signs = list("ab 'stll12.,!\n\t\r\x0b\x1c\x85\xa0 ​　᠎﻿éß日́\U0001f600") + [
        "<|endoftext|>", " don't", " we'LL", "  "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x1FFFF), 32, 97])) for _ in range(30))
              for _ in range(300)]
    texts += ["q" * 60_000, " " * 60_000, "x\n" * 40_000, prose(3000, 1)]
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    encoder = byteids.ByteIds(packing.vocabulary_file())
    assert encoder.fast is not None and encoder.encode(texts) == want
    assert not encoder._plain("a<|endoftext|>") and not encoder._plain("q" * 60_000)
    encoder.odd.add("é")                                            # a sign on which tables differ
    encoder.same.discard("é")
    assert not encoder._plain("café") and encoder.encode(texts) == want


def test_ranks_refuse_other_vocabularies():
    with open(packing.vocabulary_file(), encoding="utf-8") as f:
        spec = json.load(f)
    assert len(byteids.ranks(spec)) == 50_256
    joins = spec["model"]["merges"]
    assert byteids.ranks(spec | {"model": spec["model"] | {"merges": [joins[1], joins[0], *joins[2:]]}}) is None
    assert byteids.ranks(spec | {"pre_tokenizer": {"type": "Whitespace"}}) is None
