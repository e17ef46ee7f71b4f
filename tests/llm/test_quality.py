"""The classifier against held-out labels, and its parts against plain versions."""

import zlib

import numpy as np
from tests.llm.conftest import odd_rows, prose, rng, table

from twinsift.llm import quality as Q
from twinsift.llm._util import pieces_of


def corpus(seed=3, n=900):
    r, rows, labels = rng(seed), [], []
    for i in range(n):
        good = r.random() < 0.7
        text = prose(r, r.randrange(20, 200))
        if not good:
            w = text.split()
            text = [lambda: " ".join(x.upper() + "!!" for x in w), lambda: " | ".join(w), lambda: " ".join(x for x in w[:12] for _ in range(15))][i % 3]()
        rows.append((i, text))
        labels.append((i, int(good)))
    return rows, labels


def model(**options):
    return Q.QualityModel(buckets=2048, dims=16, **options)


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    got = Q.classify(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int"), model=model()).collect()
    truth = dict(labels)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_held_out_labels_are_not_read(spark):
    rows, labels = corpus(n=300)
    other = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, q in labels]
    a, b = (Q.classify(table(spark, rows), spark.createDataFrame(x, "doc_id long, quality int"), model=model()).collect() for x in (labels, other))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(903, 1), (903, 0), (None, 1), (904, None), (907, 0), (1, 1)], "doc_id long, quality int")
    got = Q.classify(odd, labels, model=model()).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == sorted(i or 0 for i, _ in odd_rows())
    blank = {r["score"] for r in got if r["doc_id"] in (900, 901, 902)}
    assert len(blank) == 1 and all(0 <= r["score"] <= 1 for r in got)
    assert Q.keep_good(odd, labels, threshold=0.0, model=model()).columns == odd.columns
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.classify(nothing, labels, model=model()).count() == 0
    assert {r["score"] for r in Q.classify(odd, none, model=model()).collect()} == {0.5}
    assert Q.keep_good(odd, none, model=model()).count() == 0 and Q.keep_good(nothing, labels, model=model()).count() == 0


def test_contexts_are_the_neighbours():
    index = Q.index_vectors(64, 8)
    r = np.random.default_rng(1)
    lens = np.array([5, 0, 1, 9])
    ids = r.integers(0, 64, lens.sum())
    want = np.zeros((64, 8), np.int64)
    start = 0
    for n in lens:
        doc = ids[start : start + n]
        for i in range(n):
            for j in range(max(0, i - 2), min(n, i + 3)):
                if i != j:
                    want[doc[i]] += index[doc[j]]
        start += n
    assert np.array_equal(Q.context_sums(ids, lens, index), want)


def test_features_of_a_batch_are_those_of_each_text():
    m = model()
    m.vectors = np.random.default_rng(0).normal(size=(2048, 16)).astype(np.float32)
    texts = ["one two two two", "", "a !! b !!", "x"]
    assert np.allclose(m.features(texts), np.vstack([m.features([t]) for t in texts]), atol=1e-5)
    assert not m.features([""]).any()


def test_long_texts_in_parts(monkeypatch):
    """What a text gives doesn't depend on the parts that it is worked on in."""
    r = rng(12)
    texts = [prose(r, 3000), "", prose(r, 40), prose(r, 1000) + "!!" * 2000]
    m = model()
    m.vectors = np.random.default_rng(0).normal(size=(2048, 16)).astype(np.float32)
    index = Q.index_vectors(2048, 16)
    ids, lens = Q.bucket_ids(texts, 2048)
    sums, rows = Q.context_sums(ids, lens, index), m.features(texts)
    monkeypatch.setattr(Q, "_PART", 97)
    monkeypatch.setattr(Q, "pieces_of", lambda t, blank: pieces_of(t, blank, 500))
    again, counts = Q.bucket_ids(texts, 2048)
    assert np.array_equal(ids, again) and np.array_equal(lens, counts)
    assert np.array_equal(Q.context_sums(ids, lens, index), sums) and np.allclose(m.features(texts), rows, atol=1e-4)


def test_ten_megabytes(spark):
    rows, labels = corpus(n=120)
    rows += [(5000, prose(rng(1), 200) * 8000), (5001, "x" * 10_000_000)]
    got = {x["doc_id"]: x["score"] for x in Q.classify(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int"), model=model()).collect()}
    assert len(got) == 122 and 0 <= got[5000] <= 1 and 0 <= got[5001] <= 1
