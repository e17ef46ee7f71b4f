"""A text of ten megabytes beside short ones, and one word of that length, through the operators whose own tests have none."""

import zlib

import pytest
from tests.llm.conftest import prose, rng, table

from twinsift.llm import chunks, fingerprints, packing, secrets, token_files
from twinsift.llm.queries import tokenizer_file

SIZE = 10_000_000


@pytest.fixture(scope="module")
def rows():
    part = prose(rng(60), 400) + " "
    return [(1, part * (SIZE // len(part))), (2, "y" * SIZE), (3, "short text"), (4, prose(rng(61), 60))]


def test_passages(spark, rows):
    passage = " ".join(rows[3][1].split())
    got = chunks.repeated_passages(table(spark, [*rows[1:], (5, f"{rows[0][1]} {passage}")])).collect()
    assert {x["doc_id"] for x in got} >= {4, 5}


def test_token_files(spark, rows):
    folder = token_files.new_folder(spark)
    manifest = token_files.write_token_files(table(spark, rows), tokenizer_file("word_bpe_49k.json"), folder)
    got = {x["doc_id"]: x for x in token_files.token_digest(token_files.read_token_files(manifest, folder)).collect()}
    assert sorted(got) == [1, 2, 3, 4] and got[1]["n_tokens"] > 10**6 and got[2]["start"] == got[1]["n_tokens"]


def test_packing(spark, rows):
    got = packing.pack(table(spark, rows), tokenizer_file("byte_bpe_50k.json")).collect()
    for i, _ in rows:
        mine = sorted((x["start"], x["length"], x["doc_tokens"]) for x in got if x["doc_id"] == i)
        assert mine[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(mine, mine[1:], strict=False)) and sum(m[1] for m in mine) == mine[0][2]


def test_secrets(spark, rows):
    hidden = rows[0][1] + 'token = "abcdef123456" ' + rows[0][1][:100]
    got = {x["doc_id"]: x for x in secrets.scan_digest(secrets.scan(table(spark, [(1, hidden), *rows[1:]]))).collect()}
    assert sorted(got) == [1, 2, 3, 4] and got[1]["n_assign"] == 1 and got[2]["n_assign"] == 0


def test_fingerprints(spark, rows):
    got = {x["doc_id"]: x for x in fingerprints.edit_digest(table(spark, rows)).collect()}
    assert [got[i]["n_chars"] for i in (1, 2, 3, 4)] == [len(t) for _, t in rows] and all(0 <= x["near_edited"] <= 1 for x in got.values())
    assert zlib.crc32(got[1]["fingerprint"].encode()) and got[1]["near_edited"] > 0.5
