import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, h1 string, `TEXT` string"
VOCAB = [a + b for a in "ba ke li mo nu ra si to".split() for b in "dan fer gol hin jas kum lor".split()]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def edited(text, every, seed):
    rng = random.Random(seed)
    words = text.split(" ")
    for i in range(every // 2, len(words), every):
        words[i] = rng.choice(VOCAB) + "x"
    return " ".join(words)


def hard_rows():
    """Nulls, empty and long texts, ties, repeated rows, copies and near copies."""
    a, b = prose(120, 1), prose(90, 2)
    texts = [(1, a), (2, a), (2, a), (3, edited(a, 60, 3)), (4, b), (5, b.replace(" ", "\t\n")), (6, ""), (7, None),
             (8, " \t\n"), (9, prose(20_000, 4)), (None, a), (None, prose(30, 5)), (11, "ba"), (12, "ba ke"),
             (13, "ba"), (14, edited(b, 7, 6)), (15, prose(60, 7)), (16, prose(60, 7) + " extra"), (15, prose(60, 7))]
    return [(i, t, "en", f"s{k % 4}" if k % 5 else None, len(t or ""), "x", "y", "z")
            for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, int(i % 7 != 0), int(i % 5 == 0)) for i in range(400)] + [(None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
