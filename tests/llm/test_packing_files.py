"""Packing and token files against the tokenizers library."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.conftest import odd_rows, prose, rng, table
from tokenizers import Tokenizer

from twinsift.llm import packing, token_files
from twinsift.llm._util import scratch

BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def ids_of(path, text):
    return np.array([*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check_packs(rows, got, window):
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(ids_of(BYTE, t))
    fill, cover = defaultdict(int), defaultdict(int)
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert fill[r["sequence_id"]] == r["offset"] and r["length"] > 0
        fill[r["sequence_id"]] += r["length"]
        assert any(len(w) == r["doc_tokens"] and zlib.crc32(w[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for w in want[r["doc_id"]])
        cover[r["doc_id"]] += r["length"]
    assert max(fill.values()) <= window
    assert {k: sum(map(len, v)) for k, v in want.items()} == dict(cover)
    return fill


def test_packs_cover_every_token(spark, odd):
    check_packs(odd_rows(), packing.pack(odd, BYTE, window=64).collect(), 64)


def test_little_padding(spark):
    r = rng(1)
    rows = [(i, prose(r, r.randrange(1, 900))) for i in range(300)]
    fill = check_packs(rows, packing.pack(table(spark, rows).coalesce(1), BYTE).collect(), 2048)
    assert sum(fill.values()) > 0.99 * 2048 * len(fill)


def test_short_partitions_make_long_streams(spark):
    """What short tasks leave open is packed by the same rule once more, so little is laid end to end and cut."""
    r = rng(2)
    rows = [(i, prose(r, r.randrange(1, 400))) for i in range(640)]
    got = packing.pack(table(spark, rows).repartition(16), BYTE).collect()
    fill = check_packs(rows, got, 2048)
    assert sum(fill.values()) > 0.98 * 2048 * len(fill) and any(r["sequence_id"] >= packing._AGAIN for r in got)
    cut = {r["doc_id"] for r in got if r["start"] % 2048}
    assert len(cut) < 0.35 * len(rows)


def test_texts_with_added_tokens(spark):
    rows = [(i, f"{prose(rng(i), 20)} <|endoftext|> {prose(rng(i + 50), 9)}") for i in range(20)]
    check_packs(rows, packing.pack(table(spark, rows), BYTE, window=128).collect(), 128)


def test_no_rows(spark, nothing):
    assert packing.pack(nothing, BYTE).count() == 0


@settings(max_examples=60, deadline=None)
@given(sizes=st.lists(st.integers(1, 40), max_size=60), window=st.integers(4, 16), most=st.integers(1, 6))
def test_the_level_is_the_best(sizes, window, most):
    p = packing.SumOfSquares(window, most)
    out = []
    for i, n in enumerate(sizes):
        before = p.levels.copy()
        if n < window:
            costs = {}
            for h in range(0, window - n + 1):
                if h == 0 or before[h]:
                    after = before.copy()
                    after[h] -= h > 0
                    after[h + n] += h + n < window
                    costs[h] = int((after**2).sum())
            assert costs[p.best(n)] == min(costs.values())
        out += p.put(i, np.arange(n))
        assert len(p.open) <= most and p.levels.sum() == len(p.open)
    out += p.flush()
    assert not p.open and not p.levels.any()
    fill, got = defaultdict(int), defaultdict(list)
    for key, start, ids, total, k, offset in sorted(out, key=lambda x: (x[4], x[5])):
        assert fill[k] == offset and total == sizes[key] and ids[0] == start
        fill[k] += len(ids)
        got[key] += ids.tolist()
    assert all(n <= window for n in fill.values()) and {k: sorted(v) for k, v in got.items()} == {i: list(range(n)) for i, n in enumerate(sizes)}


def test_files_round_trip(spark, odd):
    folder = scratch(spark, "files")
    manifest = token_files.write_token_files(odd, WORD, folder, file_ids=50)
    got = token_files.read_token_files(manifest, folder).collect()
    want = sorted(((i, ids_of(WORD, t)) for i, t in odd_rows()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert len(got) == len(want) and manifest.count() > 3
    start = 0
    for r, (i, _) in zip(sorted(got, key=lambda r: r["start"]), want, strict=True):
        assert r["doc_id"] == i and r["start"] == start
        assert any(bytes(r["ids"]) == w.tobytes() for k, w in want if k == i)
        start += r["n_tokens"]
    assert start == sum(len(w) for _, w in want)


def test_files_of_no_rows(spark, nothing):
    folder = scratch(spark, "files")
    manifest = token_files.write_token_files(nothing, WORD, folder)
    assert token_files.read_token_files(manifest, folder).count() == 0


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=50))
def test_code_round_trip(ranks):
    control, data = token_files.encode_ranks(np.array(ranks, np.uint32))
    assert len(control) == -(-len(ranks) // 4)
    assert token_files.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(ranks)).tolist() == ranks
