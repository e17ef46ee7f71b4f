"""Clustering against a plain version in whole numbers."""

import hashlib
import math
import os
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.conftest import DATA

from twinsift.llm import clustering as C
from twinsift.llm import queries

KIND = "vec_id long, embedding array<float>, cluster string, x int"


def plain(rows, k=8, rounds=10, dims=64, seed=3):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, _, v in sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), np.array(v, "<i8").tobytes(), v) for i, v in kept)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        at = [min((far(v, c), n) for n, c in enumerate(centroids)) for _, v in kept]
        if turn < rounds:
            for n in range(len(centroids)):
                mine = [v for (_, v), (_, m) in zip(kept, at, strict=True) if m == n]
                if mine:
                    centroids[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    own = [sum(d for d, m in at if m == n) for n in range(len(centroids))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, own[n], sum(own), names[n]) for (i, _), (d, n) in zip(kept, at, strict=True)), key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "name", 1) for i, v in rows], KIND)
    return sorted((tuple(r) for r in C.cluster(df, **options).collect()), key=repr)


def vectors(seed, n, dims=64):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    as_float = lambda x: float(np.float32(x))
    return [(k, [as_float(c + r.gauss(0, 0.4)) for c in r.choice(centres)]) for k in range(n)]


def test_plain(spark):
    rows = vectors(1, 150)
    rows += [(1000 + k, rows[0][1]) for k in range(75)]  # a third are copies
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows, k=3, rounds=0, segments=16) == plain(rows, 3, 0)


def test_odd_rows(spark):
    rows = vectors(2, 12)
    bad = rows[0][1][:63]
    rows += [(50, None), (51, []), (52, bad), (53, [*bad, None]), (54, [*bad, float("nan")]), (55, [*bad, float("inf")]), (56, [0.0] * 65), (None, rows[1][1]), (60, rows[2][1]), (60, rows[2][1])]
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows[:3]) == plain(rows[:3])  # fewer vectors than centroids
    assert run(spark, []) == [] and run(spark, [(1, None)]) == []
    assert run(spark, [(1, [0.5] * 64), (2, [3e38] * 64)]) == plain([(1, [0.5] * 64)])  # too large for exact distances


def test_ties_and_empty_clusters(spark):
    rows = [(k, [float(k % 3)] + [0.0] * 63) for k in range(30)]
    assert run(spark, rows) == plain(rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 30, 10_000, C.LARGEST - 1]), st.sampled_from([1, 4, 8, 64]))
def test_screening_keeps_the_nearest(seed, large, segments):
    r = np.random.default_rng(seed)
    x = r.integers(-large, large, (40, 64), endpoint=True)
    c = np.vstack([x[:3], x[:1], r.integers(-large, large, (4, 64), endpoint=True)])
    at, best, done = C.nearest(x, *C.compressed(x, segments), c, segments)
    d = ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(2)
    assert at.tolist() == [min(range(8), key=lambda k: (row[k], k)) for row in d] and best.tolist() == d.min(1).tolist() and done <= 320


def test_screening_saves_distances():
    rows = np.array([[math.floor(1024 * x) for x in v] for _, v in vectors(3, 400)])
    _, _, done = C.nearest(rows, *C.compressed(rows, 8), rows[:8], 8)
    assert done < 0.3 * 400 * 8


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = con.sql(queries.oracle_sql()["op13_clustering"])
    got = queries.op13_clustering(spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
