"""Histogram sort against a plain sort."""

import hashlib
import os
import zlib
from itertools import accumulate

import duckdb
import pytest
from tests.conftest import DATA
from tests.llm.conftest import odd_rows, prose, rng, table

from twinsift.llm import queries
from twinsift.llm import sharding as S


def plain(rows, shards):
    data = lambda t: (t or "").encode()
    order = sorted(rows, key=lambda r: (hashlib.md5(data(r[1])).hexdigest()[:15], r[0] is not None, r[0] or 0))
    sizes = [len(data(t)) + 8 for _, t in order]
    ends = [0, *accumulate(sizes)]
    cuts = [min(ends, key=lambda e: (abs(shards * e - j * ends[-1]), e)) for j in range(1, shards)]
    out, seen = [], {}
    for (i, t), n, at in zip(order, sizes, ends, strict=False):
        s = sum(c <= at for c in cuts)
        seen[s] = seen.get(s, -1) + 1
        out.append((i, n, zlib.crc32(data(t)), "bytes", s, seen[s], None))
    return sorted(out, key=repr)


def run(df, shards, **options):
    return sorted((tuple(r) for r in S.shard(df, shards, **options).collect()), key=repr)


@pytest.mark.parametrize("shards", [1, 2, 24])
def test_plain(spark, shards):
    r = rng(4)
    rows = [(k * 7919, prose(r, r.randrange(0, 200))) for k in range(150)] + [(10**15 + k, "a copy of the same text") for k in range(80)]
    assert run(table(spark, rows).repartition(5), shards) == plain(rows, shards)


def test_ranges_and_equal_rows(spark):
    """A third of the rows are one row; shards have several ranges each, and slots still count on."""
    r = rng(5)
    rows = [(k, prose(r, 20)) for k in range(120)] + [(7, "the same row")] * 60
    spark.conf.set("spark.sql.shuffle.partitions", 12)
    try:
        assert run(table(spark, rows), 4) == plain(rows, 4)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_tolerance(spark):
    r = rng(6)
    rows = [(k, prose(r, r.randrange(1, 60))) for k in range(2000)]
    got = run(table(spark, rows), 8, tolerance=0.05)
    total = sum(g[1] for g in got)
    for s in range(8):
        mine = [g for g in got if g[4] == s]
        assert abs(sum(g[1] for g in mine) - total / 8) <= 0.1 * total / 8 and sorted(g[5] for g in mine) == list(range(len(mine)))


def test_odd_tables(spark, odd, nothing):
    assert run(odd, 3) == plain(odd_rows(), 3)
    assert run(nothing, 3) == []
    assert run(table(spark, [(1, "alone")]), 24) == plain([(1, "alone")], 24)


def test_long_text(spark):
    rows = [(1, "x" * 12_000_000), *((k, "short") for k in range(2, 40))]
    assert run(table(spark, rows), 4) == plain(rows, 4)


def test_whole_rows(spark, odd, tmp_path):
    clash = odd.selectExpr("*", "n as shard", "digest as range", "n as size")
    whole = S.shard(clash, 3, carry=True)
    assert whole.columns == [*clash.columns, "_size", "text_crc32", "law", "_shard", "slot", "grown_shard"]
    assert sorted(map(repr, whole.select(*clash.columns).collect())) == sorted(map(repr, clash.collect()))
    r = rng(7)
    rows = [(k, prose(r, 20)) for k in range(100)]
    S.write_shards(table(spark, rows), str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    want = {(i, s, n) for i, _, _, _, s, n, _ in plain(rows, 5)}
    assert {(x["doc_id"], x["shard"], x["slot"]) for x in back.collect()} == want and sorted(os.listdir(tmp_path / "out"))[-5:] == [f"shard={k}" for k in range(5)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.sql(queries.oracle_sql()["op12_sharding"])
    got = queries.op12_sharding(spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)
