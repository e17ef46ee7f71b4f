import random

import pytest

WORDS = [a + b + c for a in ("th", "er", "on", "in", "re", "st") for b in ("a", "e", "o", "an", "ti") for c in ("n", "sh", "nd", "ble", "ing")]


def prose(rng, n):
    out = []
    for _ in range(n):
        w = rng.choice(WORDS) + (rng.choice(WORDS) if rng.random() < 0.6 else "")
        out.append(w.capitalize() + "," if rng.random() < 0.05 else w + "." if rng.random() < 0.1 else w)
    return " ".join(out)


#: Rows that every operator must take: null id, null and empty and blank text, repeated rows, a long word, a long text, odd characters.
def odd_rows():
    return [(None, "a text without an id"), (900, None), (901, ""), (902, " \n\t "), (903, "twice the same row"), (903, "twice the same row"), (904, "x" * 30_000), (905, "one two three " * 4000), (906, "é日本 \x00\x1f �"), (907, "one")]


@pytest.fixture
def odd(spark):
    """The odd rows in a table with more columns, whose names clash with those that operators use."""
    rows = [(i, t, 1.0, "x", 7, [1], "n", None) for i, t in odd_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, score double, digest string, n long, spans array<int>, node string, quality int")


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def table(spark, rows):
    return spark.createDataFrame(list(rows), "doc_id long, text string")


def rng(seed=0):
    return random.Random(seed)
