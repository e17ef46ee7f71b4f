import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.conftest import odd_rows, prose, rng, table

from twinsift.llm import chunks as C


def test_repeated_passages(spark):
    r = rng(5)
    passage, line = prose(r, 90), prose(r, 25)
    rows = [(i, prose(r, r.randrange(50, 300))) for i in range(60)]
    for i in range(0, 60, 3):  # the passage anywhere; the line is too short to count
        d, t = rows[i]
        cut = r.randrange(len(t))
        rows[i] = (d, f"{t[:cut]} {passage if i % 6 == 0 else line} {t[cut:]}")
    got = C.repeated_passages(table(spark, rows)).collect()
    assert {x["doc_id"] for x in got} == set(range(0, 60, 6))
    texts = dict(rows)
    for x in got:
        found = texts[x["doc_id"]].encode()[x["start"] : x["end"]].decode()
        assert x["first_doc_id"] == 0 and x["is_first"] == (x["doc_id"] == 0) and len(set(found.split()) & set(passage.split())) > 20


def test_copies_and_removal(spark):
    r = rng(6)
    a = prose(r, 120)
    rows = [(3, a), (1, a), (1, a), (2, prose(r, 100)), (None, a), (4, f"{prose(r, 20)} {a}")]
    assert {(x["doc_id"], x["first_doc_id"], x["is_first"]) for x in C.repeated_passages(table(spark, rows)).collect()} == {(1, 1, True), (3, 1, False), (4, 1, False)}
    out = sorted((tuple(x) for x in C.without_repeats(table(spark, rows)).collect()), key=repr)
    assert [t for i, t in out if i in (1, 2, None)] == [t for i, t in sorted(rows, key=repr) if i in (1, 2, None)]
    assert all(len(t) < 0.4 * len(a) + 200 for i, t in out if i in (3, 4))


def test_words_over_and_over(spark):
    rows = [(1, prose(rng(1), 60) + " so it" * 90), (2, prose(rng(2), 60) + " so it" * 200), (3, "so it " * 4), (4, "z" * 5000)]
    assert {x["doc_id"] for x in C.repeated_passages(table(spark, rows)).collect()} <= {1, 2}


def test_blanks_do_not_matter(spark):
    a = prose(rng(11), 90)
    rows = [(1, a), (2, a.replace(". ", ".\n")), (3, a.replace(" ", "  \t")), (4, prose(rng(12), 90))]
    assert {x["doc_id"] for x in C.repeated_passages(table(spark, rows)).collect()} == {1, 2, 3}


def test_repeats_inside_one_document_do_not_count(spark):
    a = prose(rng(7), 80)
    assert C.repeated_passages(table(spark, [(1, f"{a} {a}"), (2, "other words")])).count() == 0


def test_odd_rows(spark, odd, nothing):
    assert C.repeated_passages(odd).count() == 0 and C.repeated_passages(nothing).count() == 0
    out = C.without_repeats(odd)
    assert out.columns == odd.columns and sorted((r["doc_id"] or 0) for r in out.collect()) == sorted((i or 0) for i, _ in odd_rows())


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=400), st.binary(min_size=400, max_size=600), st.binary(max_size=40))
def test_cuts_resist_shifts(head, body, inserted):
    """Past the reach of the hash and of the comparison, an insertion moves no cut."""
    a = C.cut_points(np.frombuffer(head + body, np.uint8)) - len(head)
    b = C.cut_points(np.frombuffer(head + inserted + body, np.uint8)) - len(head) - len(inserted)
    far = C._REACH + 15 + C._CLOSE
    assert {x for x in a.tolist() if x > far} == {x for x in b.tolist() if x > far}


def test_cuts_are_the_local_tops():
    data = np.frombuffer(prose(rng(1), 60).encode(), np.uint8)
    h = [sum(int(C._GEAR[data[i - k]]) << k for k in range(min(C._REACH, i + 1))) % 65536 for i in range(len(data))]
    want = [i + 1 for i in range(15, len(data) - 1) if h[i] >= max(h[i - 15 : i]) and h[i] >= max(h[i + 1 : i + 16], default=0)]
    want = [x for k, x in enumerate(want) if not k or x - want[k - 1] >= 8]
    assert C.cut_points(data).tolist() == [*want, len(data)]


@given(st.text(max_size=200))
def test_chunks_cover_the_text(text):
    raw = text.encode("utf-8", "replace")
    (digest, start, end, words), docs = C.chunk_rows([7], [raw])
    assert b"".join(raw[a:b] for a, b in zip(start, end, strict=True)) == raw and words.sum() == len(raw.split()) and docs == [7] * len(digest)
    for a in start:
        raw[a:].decode()


def test_copies_with_a_chance_chunk_keep_one_whole_text(spark):
    r = rng(21)
    a, b = prose(r, 120), prose(r, 130)
    shared = " ".join(a.split()[40:60])  # a few words that an earlier document has too: no passage
    rows = [(1, f"{prose(r, 40)} {shared} {prose(r, 40)}"), (5, a), (7, a), (8, f"{b} {a}"), (9, b), (10, f"{prose(r, 9)} {b}")]
    got = {(x["doc_id"], x["first_doc_id"], x["is_first"]) for x in C.repeated_passages(table(spark, rows)).collect()}
    assert got == {(5, 5, True), (7, 5, False), (8, 5, False), (8, 8, True), (9, 8, False), (10, 8, False)}
    out = {i: t.split() for i, t in C.without_repeats(table(spark, rows)).collect()}
    assert out == {1: rows[0][1].split(), 5: a.split(), 7: [], 8: b.split(), 9: [], 10: rows[5][1].split()[:9]}


def plain_passages(texts, n):
    """doc_id, words, first and is_first, by a table of all windows."""
    at, out = {}, []
    words = {i: t.split() for i, t in texts.items()}
    for i, w in words.items():
        for k in range(len(w) - n + 1):
            at.setdefault(tuple(w[k : k + n]), set()).add(i)
    for i, w in words.items():
        before = None
        for k in range(len(w) - n + 1):
            holders = at[tuple(w[k : k + n])]
            low = min(holders) if len(holders) > 1 else None
            if low is not None and low == before:
                out[-1][2] += 1
            elif low is not None:
                out.append([i, k, n, low])
            before = low
    return sorted(map(tuple, out))


def test_the_bound_is_exact(spark):
    """Passages of 45 to 60 words, of usual and of very short words, and copies that overlap, against all windows."""
    r, rows = rng(22), []
    for k in range(96):
        shared = " ".join(r.choice("abcde") for _ in range(45 + k % 16)) if k % 6 == 0 else prose(r, 45 + k % 16)
        rows += [(2 * k, f"{prose(r, r.randrange(60))} {shared} {prose(r, r.randrange(60))}"), (2 * k + 1, f"{prose(r, r.randrange(60))}\n{shared}  {prose(r, r.randrange(60))}")]
    long = prose(r, 400).split()
    rows += [(1000 + k, " ".join(long[lo:hi])) for k, (lo, hi) in enumerate([(0, 200), (150, 400), (0, 400), (149, 201), (150, 200)])]
    rows += [(2000, " so it" * 90), (2001, " so it" * 60)]
    got = []
    for x in C.repeated_passages(table(spark, rows)).collect():
        raw = dict(rows)[x["doc_id"]].encode()
        assert len(raw[x["start"] : x["end"]].split()) == x["words"]
        got.append((x["doc_id"], len(raw[: x["start"]].split()), x["words"], x["first_doc_id"]))
    assert sorted(got) == plain_passages(dict(rows), 51)


def test_windows_are_matched_in_shares(spark, monkeypatch):
    """No share has most of the windows in the shuffle at once, and shares change no passage."""
    from twinsift.llm import chunks

    words = [" ".join(f"w{k}x{i}" for i in range(400)) for k in range(4)]
    docs = spark.createDataFrame([(2 * k + c, w) for k, w in enumerate(words) for c in (0, 1)], "doc_id long, text string")
    seen = []
    whole = chunks._held_by_several
    monkeypatch.setattr(chunks, "_held_by_several", lambda rows, *key: (seen.append(rows.count()) if "hash" in key else None, whole(rows, *key))[1])
    want = sorted(tuple(r) for r in chunks.repeated_passages(docs, shares=1).collect())
    assert len(want) == 8 and seen == [8 * 350]
    seen.clear()
    assert sorted(tuple(r) for r in chunks.repeated_passages(docs).collect()) == want
    assert sum(seen) == 8 * 350 and max(seen) < 0.5 * sum(seen)
