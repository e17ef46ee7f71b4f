"""The n-gram join against all pairs of a small table."""

import os

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.conftest import DATA
from tests.llm.conftest import odd_rows, prose, rng, table

from twinsift.llm import jaccard_join as J
from twinsift.llm import queries
from twinsift.llm._util import pieces_of
from twinsift.llm.components import connected_components, stars


def brute(rows, n, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            linked = both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)
            if rows[i][0] is not None and rows[j][0] is not None and (linked or rows[i][0] == rows[j][0]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(s), None if d is None else low[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def near_copies(seed, groups, size, words, edits):
    r, rows = rng(seed), []
    for _ in range(groups):
        base = prose(r, r.randrange(5, words)).split()
        for _ in range(r.randrange(1, size)):
            w = list(base)
            for _ in range(r.randrange(edits)):
                w[r.randrange(len(w))] = r.choice(["edit", "other", prose(r, 1)])
            rows.append((len(rows), " ".join(w)))
    return rows


def run(spark, rows, n, percent, **options):
    return sorted((tuple(x) for x in J.jaccard_components(table(spark, rows), n, percent, **options).collect()), key=repr)


def test_near_copies(spark):
    rows = near_copies(1, 25, 12, 150, 6) + [(1000 + i, t) for i, t in near_copies(2, 8, 5, 30, 2)]
    assert run(spark, rows, 3, 90) == brute(rows, 3, 90)


def test_five_words_and_tiles(spark):
    rows = near_copies(3, 12, 14, 120, 5)
    assert run(spark, rows, 5, 80, tile_docs=3) == brute(rows, 5, 80)


def test_shared_lines(spark):
    r = rng(9)
    line = prose(r, 40)
    rows = [(i, f"{line} {prose(r, 30)} {line}") for i in range(40)] + [(100 + i, f"{line} {i}") for i in range(6)]
    assert run(spark, rows, 3, 90) == brute(rows, 3, 90)


def test_odd_rows(spark, odd):
    got = sorted((tuple(x) for x in J.jaccard_components(odd).collect()), key=repr)
    assert got == brute(odd_rows(), 3, 90)


def test_no_rows(spark, nothing):
    assert J.jaccard_components(nothing).count() == 0 and J.one_of_each(nothing).count() == 0


def test_one_of_each_keeps_columns(spark, odd):
    out = J.one_of_each(odd)
    assert out.columns == odd.columns and sorted(r["doc_id"] or 0 for r in out.collect()) == sorted(i or 0 for i, _ in odd_rows())
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "other words than those of the first")]
    assert sorted(r["doc_id"] for r in J.one_of_each(table(spark, rows)).collect()) == [1, 3]


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_linked_sets_share_a_signature(data):
    """Whatever is common, and at every size, sets at the bound of similarity share a signature."""
    import numpy as np

    percent = data.draw(st.sampled_from([80, 90]))
    b = J.Bounds(percent)
    r = np.random.default_rng(data.draw(st.integers(0, 2**32)))
    size = data.draw(st.integers(9, 400))
    x = np.unique(J._mix(r.integers(0, 2**63, size).astype(np.uint64)))
    y = x.copy()
    while True:  # drop and add while still linked
        z = np.delete(y, r.integers(len(y))) if r.random() < 0.5 else np.unique(np.append(y, J._mix(r.integers(0, 2**63, 1).astype(np.uint64))))
        both = len(np.intersect1d(x, z))
        if 100 * both < percent * (len(x) + len(z) - both):
            break
        y = z
    common = np.sort(r.choice(x, data.draw(st.integers(0, len(x))), replace=False))
    assert np.array_equal(x, y) or set(b.signatures(x, common)) & set(b.signatures(y, common))
    assert J.product_links([x], [y], b)[0, 0] and J.product_links([x, y], None, b, columns=7)[0, 1]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.sets(st.integers(-20, 20), max_size=8)), max_size=25), st.sampled_from([2, 4, 1024]))
def test_holders_lose_no_agreement(rows, slots):
    holders, passed = J.Holders(slots), []
    links = []
    for doc, signatures in rows:
        fresh, near = holders.meet(doc, np.array(sorted(signatures), np.int64))
        passed += [(doc, ("s", x)) for x in fresh.tolist()]
        links += [(doc, d) for d in near.tolist()]
        assert len(fresh) <= len(signatures) and all(any(d == e for e, _ in passed) for d in near.tolist())

    def classes(edges):
        root: dict = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in edges:
            root[find(a)] = find(b)
        docs = sorted({d for d, _ in rows})
        return {frozenset(e for e in docs if find(e) == find(d)) for d in docs}

    assert classes(passed + links) == classes([(doc, ("s", x)) for doc, signatures in rows for x in signatures])


def test_hot_signatures_leave_a_task_once():
    holders = J.Holders()
    told = [len(holders.meet(doc, np.array([7, 9, 100 + doc], np.int64))[0]) for doc in range(5000)]
    assert told == [3] + [1] * 4999


def test_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.sql(queries.oracle_sql()["op8_ngram_join"])
    assert sorted(map(tuple, queries.op8_ngram_join(spark, DATA).select(*want.columns).collect())) == sorted(want.fetchall())


def test_components(spark):
    edges = [(5, 3), (3, 9), (9, 1), (7, 8), (8, 7), (4, 4), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25)]
    out = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in out.collect()} == {1: 1, 3: 1, 5: 1, 9: 1, 7: 7, 8: 7, **{k: 20 for k in range(20, 26)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_many_different_near_copies(spark, monkeypatch):
    """A group of near copies is compared with pivots: the rows that the products take grow with the group, not with its square."""
    r, placed = rng(21), {}
    base = prose(r, 60).split()
    for n in (60, 240):
        rows, taken = [], []
        for k in range(n):
            w = list(base)
            w[r.randrange(len(w))] = f"edit{k}"
            rows.append((k, " ".join(w)))
        monkeypatch.setattr(J, "connected_components", lambda edges, taken=taken: (taken.append(edges.count()), connected_components(edges))[1])
        assert {x[2] for x in run(spark, rows, 3, 80, tile_docs=16)} == {0}
        placed[n] = sum(taken)
    assert placed[240] < 6 * placed[60]


def test_agreements_join_all_rows_of_a_signature(spark):
    r = rng(22)
    rows = [(k, 7) for k in range(500)] + [(r.randrange(300), r.randrange(-40, 40)) for _ in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, signature long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = J.agreements(df)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for d, s in rows:
        root[find(("s", s))] = find(("d", d))
    want = {frozenset(d for d, _ in rows if find(("d", d)) == c) for c in {find(("d", d)) for d, _ in rows}}
    root.clear()
    for x in got.collect():
        root[find(x["doc_id"])] = find(x["low"])
    assert {frozenset(d for d, _ in rows if find(d) == c) for c in {find(d) for d, _ in rows}} == want
    assert J.agreements(df.limit(0)).count() == 0


def test_long_texts_in_pieces(monkeypatch):
    text = (prose(rng(2), 4000) + "\x0b\x0c " + "y" * 900).encode()
    whole = J.shingle_set(text, 3)
    monkeypatch.setattr(J, "pieces_of", lambda t, blank: pieces_of(t, blank, 333))
    assert np.array_equal(J.shingle_set(text, 3), whole)


def test_ten_megabytes(spark):
    long = prose(rng(3), 500) + " "
    rows = [(1, "".join(f"{k} {long}" for k in range(2200))), (2, "".join(f"{k} {long}" for k in range(2200)) + " end"), (3, "z" * 10_000_000), (4, "short text")]
    assert len(rows[0][1]) > 9_000_000
    assert [x[2] for x in sorted(run(spark, rows, 3, 90))] == [1, 1, 3, 4]


def test_components_of_random_graphs(spark):
    r = rng(40)
    edges = [(r.randrange(-400, 400), r.randrange(-400, 400)) for _ in range(500)] + [(1000 + k, 1001 + k) for k in range(700)] + [(None, 3)]
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges[:-1]:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    linked = {x for a, b in edges[:-1] if a != b for x in (a, b)}
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = connected_components(df).collect()
    assert {x["node"]: x["component"] for x in got} == {x: find(x) for x in linked} and len(got) == len(linked)


def test_stars():
    r = rng(41)
    for _ in range(200):
        a, b = (np.array([r.randrange(-9, 9) for _ in range(r.randrange(20))] or [0], np.int64) for _ in range(2))
        a, b = a[: min(len(a), len(b))], b[: min(len(a), len(b))]
        low = {int(x): int(x) for x in (*a, *b)}
        for _ in range(len(low)):
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                low[x] = low[y] = min(low[x], low[y])
        u, v = stars(a, b)
        assert dict(zip(u.tolist(), v.tolist(), strict=True)) == {x: y for x, y in low.items() if x != y}


def test_sets_are_shuffled_once_however_many_tiles(spark, monkeypatch):
    """Rows of one block that are not linked: four times the rows make 16 times the pairs of tiles, but sets leave for their tiles once."""
    kind, seen = type(spark.range(0)), []

    def counted(self, *args, repartition=kind.repartition):
        seen.extend([self.count()] if "hashes" in self.columns else [])
        return repartition(self, *args)

    monkeypatch.setattr(kind, "repartition", counted)
    shuffled = []
    for rows in (40, 160):
        seen.clear()
        half = [f"c{k}" for k in range(200)]
        data = [(i, " ".join([*half, *(f"w{i}x{k}" for k in range(200))])) for i in range(rows)]
        got = J.jaccard_components(table(spark, data), n=1, percent=60, tile_docs=8, tile_shingles=3200).collect()
        assert {r["component_id"] for r in got} == set(range(rows)) and {r["n_shingles"] for r in got} == {400}
        shuffled.append(sum(seen))
    assert shuffled[0] >= 40 and shuffled[1] < 5 * shuffled[0]
