import numpy as np
import pytest
from tests.llm.conftest import prose, rng, table

from twinsift.llm import _util as U
from twinsift.llm import decontaminate as D


def items_table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_leaks_are_found(spark):
    r = rng(4)
    items = [(j, prose(r, r.randrange(14, 60))) for j in range(12)]
    rows, want, reworded = [], set(), set()
    for i in range(240):
        text = prose(r, r.randrange(1, 400))
        if i % 12 == 0:
            j, cut = (i // 12) % 12, r.randrange(len(text))
            w = items[j][1].split()
            if i % 24 == 0 and len(w) > 25:  # reworded here and there
                for k in range(3, len(w), 9):
                    w[k] = "reworded"
                reworded.add((i, j))
            text = f"{text[:cut]} {' '.join(w).upper() if i % 36 == 0 else ' '.join(w)} {text[cut:]}"
            want.add((i, j))
        rows.append((i, text))
    got = D.find_contamination(table(spark, rows), items_table(spark, items), block=5).collect()
    pairs = {(x["doc_id"], x["item_id"]) for x in got}
    assert pairs <= want and want - reworded <= pairs and len(pairs & reworded) >= 0.7 * len(reworded)
    assert all(x["lcs_share"] >= 0.6 for x in got)
    kept = D.without_contamination(table(spark, rows), items_table(spark, items))
    assert {x["doc_id"] for x in kept.collect()} == {i for i, _ in rows} - {i for i, _ in pairs}


def test_answers(spark):
    item = "what is the capital of the country by the great river it is the old town".split()
    text = " ".join([*item[:-4], "nobody", "knows", "this", "now"])
    items = spark.createDataFrame([(1, " ".join(item), "the old town")], "item_id long, text string, answer string")
    docs = table(spark, [(1, text), (2, " ".join(item)), *((k, f"filler {k}") for k in range(3, 9))])
    assert [x["doc_id"] for x in D.find_contamination(docs, items, answer_col="answer", share=0.5).collect()] == [2]


def test_odd_rows(spark, odd, nothing):
    items = items_table(spark, [(1, None), (2, ""), (3, "some words of an item that no document has at all"), (None, "a text without an id")])
    assert D.find_contamination(odd, items).count() == 0
    assert D.without_contamination(odd, items).columns == odd.columns and D.without_contamination(odd, items).count() == odd.count()
    assert D.find_contamination(nothing, items).count() == 0
    assert D.find_contamination(odd, items_table(spark, [])).count() == 0


def test_repeated_rows_and_null_ids(spark):
    item = prose(rng(6), 30)
    rows = [(None, item), (1, item), (1, item), (2, "nothing of it"), *((k, prose(rng(k), 50)) for k in range(10, 30))]
    got = D.find_contamination(table(spark, rows), items_table(spark, [(7, item)])).collect()
    assert sorted(x["doc_id"] or 0 for x in got) == [0, 1]
    assert D.without_contamination(table(spark, rows), items_table(spark, [(7, item)])).count() == len(rows) - 2


def test_subsequences():
    r = rng(1)
    for _ in range(200):
        a, b = ([r.randrange(6) for _ in range(r.randrange(1, 20))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert D.lcs(a, b) == t[-1][-1]


def plain_hashes(text):
    out = []
    for w in text.lower().encode().split():
        h, p = 0, 1
        for c in w.strip(b".,;:!?\"'()[]{}"):
            h, p = (h + (c + 1) * p) % 2**64, p * 0x9E3779B97F4A7C15 % 2**64
        out.append((h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64 >> 32)
    return out


def test_word_hashes():
    r = rng(2)
    for _ in range(300):
        texts = ["".join(r.choice("ab.,é \n\t(") for _ in range(r.randrange(14))) for _ in range(r.randrange(1, 6))]
        ids, lens = D.word_ids(texts)
        want = [plain_hashes(t) for t in texts]
        assert lens.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def held(items, rows):
    """The pairs that the checks accept around any window, by trying all items at all windows."""
    out = set()
    for i, text in rows:
        d = plain_hashes(text)
        for j, item in items:
            w = plain_hashes(item)
            n, answer = len(w), w[-max(3, len(w) // 4) :]
            size, step = (16, 8) if n <= 24 else (32, 16)
            for lo in range(0, len(d), step):
                region = d[max(0, lo - n) : min(lo + size, len(d)) + n]
                if D.lcs(w, region) >= 0.6 * n and D.lcs(answer, region) >= 0.6 * len(answer):
                    out.add((i, j))
                    break
    return out


@pytest.mark.parametrize(("every", "least"), [(0, 1.0), (6, 0.97), (4, 0.97), (3, 0.95)])
def test_reworded_items_against_brute_force(spark, every, least):
    """What the latent search proposes, of what the checks accept around any window of any document."""
    r = rng(31)
    items = [(j, prose(r, 15 + j * 3 // 2)) for j in range(30)]
    rows = []
    for i in range(150):
        w = items[i % 30][1].split()
        if every:
            for k in range(r.randrange(every), len(w), every):
                w[k] = prose(r, 1)
        rows.append((i, f"{prose(r, r.randrange(60, 200))} {' '.join(w)} {prose(r, r.randrange(60, 200))}"))
    got = {(x["doc_id"], x["item_id"]) for x in D.find_contamination(table(spark, rows), items_table(spark, items), block=20).collect()}
    want = held(items, rows)
    assert got <= want and len(got) >= least * len(want) and len(want) >= 100


def test_the_search_selects(spark):
    """Without near windows nothing is found: the rows come through the latent search."""
    item = prose(rng(7), 40)
    rows = [(1, item), *((k, prose(rng(k), 50)) for k in range(10, 30))]
    assert D.find_contamination(table(spark, rows), items_table(spark, [(7, item)])).count() == 1
    assert D.find_contamination(table(spark, rows), items_table(spark, [(7, item)]), cosine=2.0).count() == 0


def test_ten_megabytes(spark):
    item = prose(rng(8), 40)
    long = prose(rng(9), 300)
    rows = [(1, f"{long} " * 2500 + item + f" {long}" * 2500), (2, "x" * 10_000_000), (3, "short")]
    assert [x["doc_id"] for x in D.find_contamination(table(spark, rows), items_table(spark, [(7, item)])).collect()] == [1]


def test_subsequences_from_a_least_length_on():
    r = rng(3)
    for _ in range(300):
        a, b = ([r.randrange(9) for _ in range(r.randrange(1, 30))] for _ in range(2))
        least, n = r.choice([0, 0.6 * len(a), len(a)]), D.lcs(a, b)
        assert D.lcs(a, b, least, D.places(a)) == (n if n >= least else 0)


class Counted(np.ndarray):
    """Counts the weights that are looked up."""

    looked_up = 0

    def take(self, indices, *args, **options):
        Counted.looked_up += np.size(indices)
        return super().take(indices, *args, **options)


@pytest.mark.parametrize("coverage", [0.0, 0.1, 0.25, 0.6])
def test_windows_that_cannot_cover_an_item_are_not_looked_up(coverage):
    """All windows are near here, and all that cover an item are found; of the others few words are looked up."""
    r, rank = rng(12), 8
    items = [(j, prose(r, 10 + 4 * j)) for j in range(12)]
    texts = [*(prose(r, r.randrange(1, 300)) for _ in range(60)), *(f"{prose(r, 40)} {t} {prose(r, 9)}" for _, t in items)]
    ids, lens = D.word_ids(texts)
    g = np.random.default_rng(5)
    idf = g.uniform(0, 4, 1024).astype(np.float32)
    idf[g.random(1024) < 0.2] = 0
    project = np.vstack([g.normal(size=(1024, rank)), np.zeros((1, rank))]).astype(np.float32)
    bench = D.Benchmark(items, project, idf, coverage=coverage)
    bench.weights = bench.weights.view(Counted)
    Counted.looked_up = 0
    got = {x[:4] for x in D._near(ids, lens, project, bench, -1.0)}
    want, words = set(), 0
    starts, doc = (x.tolist() for x in D.cuts(lens, 8))
    ends = np.cumsum(lens).tolist()
    for j, w in enumerate(bench.words):
        size, step = (16, 1) if len(w) <= 24 else (32, 2)
        weights = idf[np.array(w) % 1024]
        weight = dict(zip((x % 4096 for x in w), weights.tolist(), strict=True))
        need = coverage * weights.sum() * min(1, 32 / len(w))
        for lo, d in zip(starts[::step], doc[::step], strict=True):
            hi = min(lo + size, ends[d])
            words += size
            if sum(weight.get(x % 4096, 0) for x in ids[lo:hi].tolist()) >= need - 1e-4:
                want.add((d, j, lo, hi))
    assert got <= want and len(want - got) <= 0.001 * len(want) and len(got) >= len(items)
    assert coverage < 0.6 or Counted.looked_up * 20 <= words


def test_keys_with_one_sum_are_done(monkeypatch):
    """One frequent word makes its own sums long, not those of all the others."""
    g = np.random.default_rng(2)
    keys = np.sort(np.concatenate([np.zeros(20_000, np.int64), g.integers(1, 3000, 6000)]))
    rows = g.integers(0, 500, len(keys))
    table = np.vstack([g.integers(-9, 9, (500, 4)), np.zeros((1, 4))]).astype(np.float32)
    read, plain = [], U.summed
    monkeypatch.setattr(U, "summed", lambda t, r: (read.append(r.size), plain(t, r))[1])
    got, sums = U.summed_by_key(table, rows, keys)
    want = np.zeros((3000, 4))
    np.add.at(want, keys, table[rows])
    assert got.tolist() == sorted(set(keys.tolist())) and np.array_equal(sums, want[got])
    assert sum(read) <= 2 * (len(keys) + 8 * len(got))
    none = U.summed_by_key(table, rows[:0], keys[:0])
    assert len(none[0]) == 0 and none[1].shape == (0, 4)


def test_items_of_one_text_are_compared_once(spark, monkeypatch):
    """A benchmark whose rows come again under other ids costs what its texts cost, and every id gets its pairs."""
    import pickle

    r, blocks, put = rng(41), [], D.put_file
    texts = [prose(r, 30) for _ in range(5)]
    monkeypatch.setattr(D, "put_file", lambda folder, name, raw: (blocks.append(len(pickle.loads(raw))), put(folder, name, raw))[1])
    items = items_table(spark, [(100 * j + k, t) for k in range(20) for j, t in enumerate(texts)])
    docs = table(spark, [(j, f"{prose(r, 50)} {t} {prose(r, 40)}") for j, t in enumerate(texts)] + [(k, prose(r, 60)) for k in range(10, 30)])
    got = {(x["doc_id"], x["item_id"]) for x in D.find_contamination(docs, items, block=10).collect()}
    assert got == {(j, 100 * j + k) for j in range(5) for k in range(20)} and blocks == [5]


def test_groups_of_like_items_are_bounded_together(monkeypatch):
    """Windows are compared with items one by one only in groups that they may cover; sums grow by group, not by item."""
    r, summed, plain = rng(42), [], D.cover_bounds
    monkeypatch.setattr(D, "cover_bounds", lambda bound, segments: (summed.append(bound.shape[1] * len(segments)), plain(bound, segments))[1])
    kinds = [[f"{k}{w}" for w in prose(r, 60).split()] for k in "abcdefghij"]  # ten languages
    items = [(j, " ".join(r.choice(kinds[j % 10]) for _ in range(30))) for j in range(400)]
    texts = [" ".join(r.choice(kinds[i % 10]) for _ in range(100)) for i in range(30)] + [f"other words {t} and others" for _, t in items[::40]]
    ids, lens = D.word_ids(texts)
    g = np.random.default_rng(7)
    idf, project = np.ones(1024, np.float32), np.vstack([g.normal(size=(1024, 8)), np.zeros((1, 8))]).astype(np.float32)
    bench = D.Benchmark(items, project, idf, coverage=0.6)
    got = {x[:4] for x in D._near(ids, lens, project, bench, -1.0)}
    starts, doc = (x.tolist() for x in D.cuts(lens, 8))
    ends, want = np.cumsum(lens).tolist(), set()
    for j, w in enumerate(bench.words):
        weight = dict.fromkeys((x % 4096 for x in w), 1.0)
        for lo, d in zip(starts[::2], doc[::2], strict=True):
            hi = min(lo + 32, ends[d])
            if sum(weight.get(x % 4096, 0) for x in ids[lo:hi].tolist()) >= float(bench.need[j]):
                want.add((d, j, lo, hi))
    assert got == want and len(want) >= 100
    assert sum(summed) * 4 <= len(starts) * len(items)
